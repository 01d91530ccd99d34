"""Further queries with SQL: generators, paths, files in and out, databases, streams and the facade.

They are part of the same catalog; SQL restates what each means.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil import api
from veil.catalog import _MAIL, _SSN_SQL, ORACLE_SQL, _digits, _fake_sql, _folder, _luhn_total, _mail, _num, _pick, _ssn, query, table
from veil.functions import codecs, fakes, finders
from veil.functions.strategies import replaced
from veil.operators import detect
from veil.operators.audit import audited
from veil.operators.privacy import Budget, Gaussian, Laplace, Parameters, Private
from veil.operators.values import Patterns
from veil.plans.nested import get_nested, rewrite_json_text, set_nested
from veil.plans.policy import Policy, merge
from veil.sources import databases, files, sheets
from veil.streaming import runs

# --- generators -----------------------------------------------------------

_V = "s_name"
_FIRST, _LAST = _pick(fakes.FIRST, _num("s", _V, 1)), _pick(fakes.LAST, _num("s", _V, 2))
_HEX = lambda n, salt: f"substr(md5('0|s|{salt}|' || {_V}), 1, {n})"
_MORE = {
    "full_name": f"{_FIRST} || ' ' || {_LAST}",
    "first_name": _FIRST,
    "last_name": _LAST,
    "uuid": f"substr({_HEX(32, 10)}, 1, 8) || '-' || substr({_HEX(32, 10)}, 9, 4) || '-4' || substr({_HEX(32, 10)}, 14, 3) || '-a' || substr({_HEX(32, 10)}, 18, 3) || '-' || substr({_HEX(32, 10)}, 21, 12)",
    "hostname": f"'host-' || {_digits('s', _V, 4, 16)} || '.' || {_fake_sql('domain', 's', _V)}",
    "password": f"{_pick(fakes.WORDS, _num('s', _V, 18))} || '-' || {_HEX(10, 19)}",
    "user_agent": _pick(fakes.AGENTS, _num("s", _V, 40)),
    "tld": _pick(fakes.TLDS, _num("s", _V, 46)),
    "ssn": f"lpad(CAST({_num('s', _V, 50)} % 898 + 1 + CASE WHEN {_num('s', _V, 50)} % 898 + 1 >= 666 THEN 1 ELSE 0 END AS VARCHAR), 3, '0') || '-' || lpad(CAST({_num('s', _V, 51)} % 99 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST({_num('s', _V, 52)} % 9999 + 1 AS VARCHAR), 4, '0')",
    "address": f"CAST({_num('s', _V, 47)} % 999 + 1 AS VARCHAR) || ' ' || {_pick(fakes.STREETS, _num('s', _V, 48))}",
    "country": _pick(fakes.COUNTRIES, _num("s", _V, 55)),
    "company": f"{_LAST} || ' ' || {_pick(fakes.COMPANIES, _num('s', _V, 57))}",
    "ip_address": _fake_sql("ipv4", "s", _V),
    "date_of_birth": f"CAST(CAST(DATE '1940-01-01' + CAST({_num('s', _V, 54)} % 23000 AS INT) AS DATE) AS VARCHAR)",
}


@query("SELECT s_suppkey, " + ", ".join(f'{sql} AS "{k}"' for k, sql in _MORE.items()) + " FROM supplier")
def replace_more_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", *(replaced(F.col("s_name"), k, domain="s").alias(k) for k in _MORE))


_KEYED = "CAST(p_partkey AS VARCHAR)"


@query(f"""
WITH t AS (SELECT p_partkey, '35' || {_digits('p', _KEYED, 12, 42)} AS imei, '4' || {_digits('p', _KEYED, 14, 53)} AS card FROM part),
u AS (SELECT p_partkey, imei || CAST((10 - {_luhn_total("(imei || '0')")} % 10) % 10 AS VARCHAR) AS imei, card || CAST((10 - {_luhn_total("(card || '0')")} % 10) % 10 AS VARCHAR) AS c FROM t)
SELECT p_partkey, imei, substr(c, 1, 4) || '-' || substr(c, 5, 4) || '-' || substr(c, 9, 4) || '-' || substr(c, 13, 4) AS card FROM u
""")
def replace_luhn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", replaced(key, "imei", domain="p").alias("imei"), replaced(key, "credit_card", domain="p").alias("card"))


_VIN_LETTERS = f"[{', '.join(f'''substr('{fakes.VIN_LETTERS}', CAST({_num('p', _KEYED, 20 + i)} % {len(fakes.VIN_LETTERS)} AS INT) + 1, 1)''' for i in range(16))}]"
_VIN_VALUES = f"MAP {{{', '.join(f'{k!r}: {v}' for k, v in fakes.VIN_VALUES.items())}}}"
_VIN_WEIGHTS = [w for i, w in enumerate(fakes.VIN_WEIGHTS) if i != 8]


@query(f"""
WITH t AS (SELECT p_partkey, {_VIN_LETTERS} AS l FROM part),
u AS (SELECT p_partkey, l, list_sum(list_transform(range(1, 17), lambda i: {_VIN_VALUES}[l[i]] * {_VIN_WEIGHTS}[i])) % 11 AS c FROM t)
SELECT p_partkey, array_to_string(l[1:8], '') || CASE WHEN c = 10 THEN 'X' ELSE CAST(CAST(c AS INT) AS VARCHAR) END || array_to_string(l[9:16], '') AS vin FROM u
""")
def replace_vin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", replaced(F.col("p_partkey"), "vin", domain="p").alias("vin"))


# --- policies -------------------------------------------------------------


@query("SELECT o_orderkey, upper(o_orderpriority) AS note, o_orderpriority AS kept, CAST(o_custkey AS BIGINT) AS deep FROM orders")
def nested_get_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.struct(F.struct("o_orderpriority").alias("to")).alias("doc"))
    out = set_nested(set_nested(doc, "doc.to.note", F.upper("doc.to.o_orderpriority")), "new.a.b", F.col("o_custkey").cast("long"))
    return out.select("o_orderkey", get_nested("doc.to.note").alias("note"), get_nested("doc.to.o_orderpriority").alias("kept"), get_nested("new.a.b").alias("deep"))


@query("SELECT c_custkey AS col_1_a_b, c_name AS name___x FROM customer")
def sanitized_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sanitize_columns(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("1 A-b"), F.col("c_name").alias("Name (%x")))


@query("SELECT c_custkey, sha256('t:' || c_name) AS c_name, repeat('#', length(c_mktsegment) - 2) || right(c_mktsegment, 2) AS c_mktsegment FROM customer")
def merged_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {"c_name": {"strategy": "hash", "salt": "s"}, "c_mktsegment": {"strategy": "mask", "mask_char": "#"}}
    policy = Policy.of(merge(base, {"c_name": {"salt": "t"}, "c_mktsegment": {"preserve_last": 2}})).configure(seed=5).configure(locale="en_US")
    return policy.apply(table(spark, sf_dir, "customer")).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT count(*) AS records_processed, count(*) FILTER (c_mktsegment <> repeat('*', length(c_mktsegment) - 9) || right(c_mktsegment, 9)) + count(*) FILTER (c_name <> '') AS values_changed FROM customer")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = Policy.of({"c_name": {"strategy": "hash"}, "c_mktsegment": {"strategy": "mask", "preserve_last": 9, "mask_char": "*"}})
    rows = table(spark, sf_dir, "customer").where(F.length("c_mktsegment") > 9)
    rest = table(spark, sf_dir, "customer").where(F.length("c_mktsegment") <= 9).withColumn("c_mktsegment", F.lit(""))
    out, seen = files.changed_counts(rows.unionByName(rest), policy)
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["records_processed"], seen.get["values_changed"])], "records_processed long, values_changed long")


@query("SELECT 'orders' AS dataset, count(*) AS records_processed, count(*) FILTER (o_orderpriority <> '') AS values_changed, 'o_orderpriority' AS fields, 'hash' AS strategies FROM orders")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "audit")
    audited(table(spark, sf_dir, "orders"), Policy.of({"o_orderpriority": {"strategy": "hash"}, "absent": {"strategy": "mask"}}), lambda d: d.write.format("noop").mode("overwrite").save(), "orders", f"{at}/log")
    return spark.read.parquet(f"{at}/log").select("dataset", "records_processed", "values_changed", F.array_join("fields", ",").alias("fields"), F.array_join("strategies", ",").alias("strategies"))


# --- detection ------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN regexp_full_match(c_name, 'Customer#[0-9]*[02468]') THEN 'even' WHEN regexp_full_match(c_name, 'Customer#[0-9]+') THEN 'client' END AS kind FROM customer")
def detect_own_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = Patterns().with_pattern("even", r"^Customer#\d*[02468]$", 0.9).with_pattern("client", r"^Customer#\d+$")
    return table(spark, sf_dir, "customer").select("c_custkey", patterns.value_type(F.col("c_name")).alias("kind"))


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN md5(p_name) WHEN 1 THEN p_name ELSE 'aaab' END AS v FROM part),
l AS (SELECT p_partkey, v, list_filter(string_split(v, ''), lambda c: c <> '') AS l FROM t),
b AS (SELECT p_partkey, v, -list_sum(list_transform(list_transform(list_distinct(l), lambda c: CAST(len(list_filter(l, lambda d: d = c)) AS DOUBLE) / len(l)), lambda p: p * log2(p))) AS bits FROM l)
SELECT p_partkey, round(greatest(0.7, CASE WHEN bits > 3.5 THEN least(bits / 5, 0.85) ELSE 0 END, CASE WHEN regexp_full_match(v, '[0-9a-f]{32,64}') THEN 0.85 WHEN regexp_full_match(v, '[a-zA-Z0-9]{20,}') THEN 0.75 ELSE 0 END), 6) AS confidence FROM b
""")
def heuristics_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column name keyword, entropy and format of each value."""
    k = F.col("p_partkey")
    v = F.when(k % 3 == 0, F.md5("p_name")).when(k % 3 == 1, F.col("p_name")).otherwise("aaab")
    return detect.row_heuristics(table(spark, sf_dir, "part").select("p_partkey", v.alias("my_name")), "my_name").select("p_partkey", F.round("confidence", 6).alias("confidence"))


_SSN_RANGES = r"\b(?:00[1-9]|0[1-9]\d|[1-5]\d{2}|6[0-5]\d|66[0-57-9]|6[7-9]\d|[78]\d{2})-?(?:0[1-9]|[1-9]\d)-?(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"
ORACLE_SQL["find_ssns_in_text"] = f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_SSN_RANGES}'), '|') AS ssns FROM documents"


@query(f"""
SELECT kind, value, count(*) AS times FROM (
  SELECT 'email' AS kind, unnest(regexp_extract_all(text, '{finders.EMAIL}')) AS value FROM documents UNION ALL
  SELECT 'ssn', unnest(regexp_extract_all(text, '{_SSN_RANGES}')) FROM documents UNION ALL
  SELECT 'ip_address', unnest(regexp_extract_all(text, '{finders.IPV4}')) FROM documents) GROUP BY ALL
""")
def finds_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = finders.finds(table(spark, sf_dir, "documents"), "text", "doc_id", kinds=("email", "ssn", "ip_address"))
    return found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("times"))


def _redact_sql() -> str:
    out = "text"
    for pattern, mark in ((finders.EMAIL, "[EMAIL]"), *((p, "[CARD]") for p in finders.CARDS.values()), *((p, "[PHONE]") for p in (finders.PHONES[4], *finders.PHONES[:4])), (_SSN_RANGES, "[SSN]"), (finders.IPV4, "[IP]")):
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    return out


ORACLE_SQL["redact_text"] = f"SELECT doc_id, sha256(r) AS text_sha256, r <> text AS changed FROM (SELECT doc_id, text, {_redact_sql()} AS r FROM documents)"


_PHONE_SQL = "CASE c_custkey % 6 WHEN 0 THEN '(212) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN '+44 20 7946 0958' WHEN 2 THEN 'call me' WHEN 3 THEN '12' WHEN 4 THEN '+49 30 123456' ELSE c_name END"


@query(f"SELECT c_custkey, c_custkey % 6 IN (0, 1, 4) AS valid, CASE c_custkey % 6 WHEN 1 THEN '44' WHEN 4 THEN '49' ELSE '' END AS code FROM (SELECT c_custkey, {_PHONE_SQL} AS p FROM customer)")
def validate_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = F.when(k % 6 == 0, F.concat(F.lit("(212) 555-"), F.lpad((k % 10_000).cast("string"), 4, "0"))).when(k % 6 == 1, "+44 20 7946 0958").when(k % 6 == 2, "call me").when(k % 6 == 3, "12").when(k % 6 == 4, "+49 30 123456").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", codecs.valid_phone(p).alias("valid"), codecs.country_code(p).alias("code"))


@query("SELECT c_custkey, c_nationkey % 2 = 0 AS disposable FROM customer")
def disposable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, "@Mailinator.com").otherwise("@mail.com"))
    return table(spark, sf_dir, "customer").select("c_custkey", codecs.is_disposable(mail).alias("disposable"))


# --- codecs ---------------------------------------------------------------


@query(f"""
WITH t AS (SELECT c_custkey, {_MAIL} AS m FROM customer)
SELECT c_custkey, {_fake_sql('username', 'email', 'm')} || '@' || CASE WHEN m LIKE '%@%' THEN split_part(m, '@', 2) ELSE 'example.com' END AS own_domain,
  {_fake_sql('username', 'email', 'm')} || '@' || {_pick(fakes.FREE_DOMAINS, _num('email', 'm', 7))} AS free, '' AS removed, sha256('z:' || m) AS hashed FROM t
""")
def rich_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich, m = codecs.codec("email"), _mail()
    return table(spark, sf_dir, "customer").select("c_custkey", rich.replace(m, preserve_domain=True).alias("own_domain"), rich.replace(m).alias("free"), rich.remove(m).alias("removed"), rich.hash(m, salt="z").alias("hashed"))


_US = "'+1 (212) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"


@query(f"""
WITH t AS (SELECT c_custkey, {_US} AS p FROM customer), u AS (SELECT c_custkey, p, {_digits('phone', 'p', 24, 0)} AS s, {_digits('phone', 'p', 10, 0)} AS d FROM t)
SELECT c_custkey, '+' || substr(s, 1, 1) || ' (' || substr(s, 2, 3) || ') ' || substr(s, 5, 3) || '-' || substr(s, 8, 4) AS formatted,
  '+1 (' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) AS replaced FROM u
""")
def rich_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich, p = codecs.codec("phone"), F.concat(F.lit("+1 (212) 555-"), F.lpad((F.col("c_custkey") % 10_000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", rich.replace(p).alias("formatted"), rich.replace(p, preserve_country=True).alias("replaced"))


_SSN_MADE = _MORE["ssn"].replace("'0|s|", "'0|ssn|").replace(f"|' || {_V}", "|' || s")


@query(f"SELECT p_partkey, {_SSN_MADE} AS replaced FROM (SELECT p_partkey, {_SSN_SQL} AS s FROM part)")
def rich_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", codecs.codec("ssn").replace(_ssn()).alias("replaced"))


# --- differential privacy -------------------------------------------------


@query("SELECT event_type, round(n + 2.0 * ln(0.1), 6) AS low, round(n - 2.0 * ln(0.1), 6) AS high, round(sqrt(2 * ln(1.25 / 0.01)) / 0.5 * 1.6448536269514722, 6) AS gaussian_margin FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def dp_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = Laplace(Parameters(0.5)).interval(0.0, 0.9)
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    margin = Gaussian(Parameters(0.5, 0.01)).margin(0.9)
    return n.select("event_type", F.round(F.col("n") + F.lit(low), 6).alias("low"), F.round(F.col("n") + F.lit(high), 6).alias("high"), F.round(F.lit(margin), 6).alias("gaussian_margin"))


_UNIFORM = f"((CAST({_num('laplace|20.0|price', 'CAST(o_orderkey AS VARCHAR)', 0, 3)} AS DOUBLE) + 0.5) / 4503599627370496.0 - 0.5)"


@query(f"SELECT o_orderkey, round(o_totalprice - 20.0 * sign({_UNIFORM}) * ln(1 - 2 * abs({_UNIFORM})), 4) AS noisy FROM orders")
def dp_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    private = Private(Budget(1.0), seed=3)
    noisy = private.numeric(F.col("o_totalprice"), F.col("o_orderkey"), "price", 10.0, epsilon=0.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(noisy, 4).alias("noisy"))


# --- files ----------------------------------------------------------------

_MONEY = "CAST(c_acctbal AS DECIMAL(15, 2))"


@query(f"SELECT c_custkey, sha256(c_name) AS c_name, {_MONEY} AS money, c_custkey % 2 = 0 AS even FROM customer")
def file_avro(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, even = _folder(spark, "avro"), (F.col("c_custkey") % 2 == 0).alias("even")
    files.write(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(15,2)").alias("money"), even), f"{at}/in.avro")
    files.anonymize_file(spark, f"{at}/in.avro", f"{at}/out.avro", {"c_name": {"strategy": "hash"}})
    return files.read(spark, f"{at}/out.avro").select("c_custkey", "c_name", "money", "even")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, sha256(s_name) AS s_name, 'suppliers,nations' AS sheets FROM supplier")
def file_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "excel")
    sheets.write_sheets({"suppliers": table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "nations": table(spark, sf_dir, "nation").select("n_name")}, f"{at}-in.xlsx")
    files.anonymize_file(spark, f"{at}-in.xlsx", f"{at}-out.xlsx", {"s_name": {"strategy": "hash"}})
    return files.read(spark, f"{at}-out.xlsx").select("s_suppkey", "s_name", F.lit(",".join(sheets.sheet_names(f"{at}-in.xlsx"))).alias("sheets"))


_HASHED = "SELECT CAST(c_custkey AS {kind}) AS c_custkey, sha256(c_name) AS c_name FROM customer"


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name")


@query(_HASHED.format(kind="VARCHAR"))
def file_in_file_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file in, one out, by a column mapping."""
    at = _folder(spark, "one")
    files.write(_customer(spark, sf_dir), f"{at}/in.csv", options=files.FormatOptions(single_file=True))
    files.anonymize_file(spark, f"{at}/in.csv", f"{at}/out.csv", {"who": {"strategy": "hash"}}, mapping={"c_name": "who"})
    return files.read(spark, f"{at}/out.csv").select("c_custkey", "c_name")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, sha256(sha256(c_name)) AS c_name FROM customer")
def file_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document rewritten in place, twice."""
    at = f"{_folder(spark, 'place')}/in.json"
    files.write(_customer(spark, sf_dir), at, options=files.FormatOptions(single_file=True))
    for _ in range(2):
        files.anonymize_in_place(spark, at, {"c_name": {"strategy": "hash"}})
    return files.read(spark, at).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")


@query("SELECT c_custkey, c_name AS original, sha256(c_name) AS anonymized FROM customer ORDER BY c_custkey LIMIT 5")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = files.preview(_customer(spark, sf_dir).orderBy("c_custkey"), Policy.of({"c_name": {"strategy": "hash"}}), 5)
    return spark.createDataFrame([(r["original"]["c_custkey"], r["original"]["c_name"], r["anonymized"]["c_name"]) for r in shown], "c_custkey long, original string, anonymized string")


@query("SELECT codec, count(*) AS n, sum(c_custkey) AS keys FROM customer, (VALUES ('none'), ('snappy'), ('gzip'), ('zstd'), ('lz4')) t(codec) GROUP BY codec")
def parquet_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, out = _folder(spark, "codecs"), None
    for codec in ("none", "snappy", "gzip", "zstd", "lz4"):
        files.write(_customer(spark, sf_dir), f"{at}/{codec}", "parquet", files.FormatOptions(compression=codec))
        one = files.read(spark, f"{at}/{codec}", "parquet").agg(F.lit(codec).alias("codec"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT count(*) AS num_rows, 3 AS num_columns, 'p_partkey,p_name,p_size' AS columns FROM part")
def parquet_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "facts")
    files.write(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit(1).alias("p_size")), f"{at}/p", "parquet")
    facts = files.parquet_metadata(f"{at}/p")
    return spark.createDataFrame([(facts["num_rows"], facts["num_columns"], ",".join(facts["columns"]))], "num_rows long, num_columns int, columns string")


@query("""SELECT o_orderkey, '{"user": {"name": "' || sha256(o_orderpriority) || '", "n": 1}, "tags": ["' || repeat('*', length(o_orderpriority) - 2) || right(o_orderpriority, 2) || '", null], "kept": true}' AS doc FROM orders""")
def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in JSON texts without a schema."""
    name = F.col("o_orderpriority")
    doc = F.concat(F.lit('{"user": {"name": "'), name, F.lit('", "n": 1}, "tags": ["'), name, F.lit('", null], "kept": true}'))
    policy = {"user.name": {"strategy": "hash"}, "tags.*": {"strategy": "mask", "preserve_last": 2}}
    return table(spark, sf_dir, "orders").select("o_orderkey", rewrite_json_text(doc, policy).alias("doc"))


# --- databases and streams ------------------------------------------------


def _sqlite(spark: SparkSession, name: str) -> str:
    import os

    at = _folder(spark, name).removeprefix("file://")
    os.makedirs(at, exist_ok=True)
    return f"sqlite:///{at}/x.db"


@query("SELECT c_custkey, sha256(c_name) AS c_name, 'c_custkey,c_name' AS columns FROM customer")
def database_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to a database, rewritten by policy into another, and read back."""
    source, target = _sqlite(spark, "source"), _sqlite(spark, "target")
    databases.write_table(_customer(spark, sf_dir), source, "customer", mode="overwrite")
    databases.anonymize_tables(spark, source, target, {"customer": {"c_name": {"strategy": "hash"}}})
    names = ",".join(n for n, *_ in databases.columns_of(spark, target, "customer"))
    return databases.read_table(spark, target, "customer").select("c_custkey", "c_name", F.lit(names).alias("columns"))


@query("SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def database_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in ranges of the key, with a checkpoint."""
    source, target = _sqlite(spark, "source"), _sqlite(spark, "target")
    databases.write_table(_customer(spark, sf_dir), source, "customer", mode="overwrite")
    databases.process_database(spark, source, "customer", target, {"c_name": {"strategy": "hash"}}, f"{_folder(spark, 'mark')}.json", key="c_custkey", batches=4)
    return databases.read_table(spark, target, "customer").select("c_custkey", "c_name")


@query("SELECT count(*) AS rows_processed, 1 AS batches_processed FROM events")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "totals")
    got = runs.process_large_file(spark, f"{sf_dir}/events.parquet", f"{at}/out", Policy.of({"user_id": {"strategy": "hash"}}), f"{at}/checkpoint")
    return spark.createDataFrame([(got["rows_processed"], got["batches_processed"])], "rows_processed long, batches_processed int")


@query("SELECT event_id, event_type FROM events")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy that fails on every batch: the source rows are kept aside."""
    at, options = _folder(spark, "quarantine"), runs.StreamOptions(tries=1, continue_on_error=True)
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    events.write.parquet(f"{at}/in")
    bad = Policy.of({"event_type": {"strategy": "hash", "where": F.col("no_such_column") > 0}})
    runs.finish(runs.anonymize_stream(runs.stream(spark, f"{at}/in", events.schema, options=options), bad, f"{at}/out", f"{at}/checkpoint", options=options, quarantine=f"{at}/aside"))
    return spark.read.schema(events.schema).json(f"{at}/aside").select("event_id", "event_type")


# --- facade ---------------------------------------------------------------


@query("SELECT c_custkey, sha256(c_name) AS c_name, c_mktsegment FROM customer")
def facade_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and one strategy; names alone are detected here."""
    return api.anonymize(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), strategy="hash", spark=spark)


@query(_HASHED.format(kind="VARCHAR"))
def facade_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "facade")
    files.write(_customer(spark, sf_dir), f"{at}/c.csv", options=files.FormatOptions(single_file=True))
    done = api.anonymize(f"{at}/c.csv", strategy="hash", spark=spark)
    return files.read(spark, done["output"]).select("c_custkey", "c_name")


@query("SELECT 'c_name' AS field, 'name' AS type, 'hash' AS strategy")
def facade_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dry = api.anonymize(_customer(spark, sf_dir), strategy="hash", dry_run=True, spark=spark)
    return spark.createDataFrame([(f, r["type"], r["strategy"]) for f, r in json.loads(json.dumps(dry["policy"])).items()], "field string, type string, strategy string")
