"""Queries over the engine's own operators, with the same queries as SQL.

SQL here restates what an operator means; it is not made from the operator's
code.  Values that both sides need (word lists) are read from one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions import codecs, fakes, finders
from veil.functions.strategies import hashed, masked, partial_email, replaced, truncated
from veil.operators import detect
from veil.operators.privacy import Budget, Private, k_anonymous
from veil.operators.values import Patterns
from veil.plans.nested import apply_nested
from veil.plans.policy import Policy, apply_tables, erase
from veil.sources import databases, files
from veil.streaming import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL building blocks --------------------------------------------------


def _num(domain: str, value: str, salt: int = 0, seed: object = 0) -> str:
    return f"CAST('0x' || substr(md5('{seed}|{domain}|{salt}|' || {value}), 1, 13) AS BIGINT)"


def _pick(words: tuple[str, ...], index: str) -> str:
    return f"list_extract({list(words)!r}, CAST(({index}) % {len(words)} + 1 AS INT))"


def _digits(domain: str, value: str, n: int, salt: int) -> str:
    parts = [(i, min(12, n - i)) for i in range(0, n, 12)]
    return "(" + " || ".join(f"lpad(CAST({_num(domain, value, salt * 100 + i)} % {10**size} AS VARCHAR), {size}, '0')" for i, size in parts) + ")"


def _fake_sql(kind: str, domain: str, v: str) -> str:
    first, last = _pick(fakes.FIRST, _num(domain, v, 1)), _pick(fakes.LAST, _num(domain, v, 2))
    word = lambda salt: _pick(fakes.WORDS, _num(domain, v, salt))
    site = f"{word(4)} || '-' || {word(5)} || '.' || {_pick(fakes.TLDS, _num(domain, v, 6))}"
    hexes = lambda n, salt: f"substr(md5('0|{domain}|{salt}|' || {v}), 1, {n})"
    return {
        "name": f"{first} || ' ' || {last}",
        "email": f"lower({first}) || '.' || lower({last}) || {_digits(domain, v, 6, 3)} || '@' || {_pick(fakes.FREE_DOMAINS, _num(domain, v, 7))}",
        "phone": f"'(' || CAST({_num(domain, v, 8)} % 800 + 200 AS VARCHAR) || ') 555-' || {_digits(domain, v, 4, 9)}",
        "username": f"lower({first}) || '_' || {_digits(domain, v, 6, 3)}",
        "domain": site,
        "url": f"'https://' || {site} || '/' || {word(17)}",
        "ipv4": "'10.' || " + " || '.' || ".join(f"CAST({_num(domain, v, 11 + i)} % 256 AS VARCHAR)" for i in range(3)),
        "ipv6": "'2001:0db8:' || " + " || ':' || ".join(f"substr({hexes(24, 14)}, {1 + 4 * i}, 4)" for i in range(6)),
        "mac": "'02:' || " + " || ':' || ".join(f"substr({hexes(10, 15)}, {1 + 2 * i}, 2)" for i in range(5)),
        "job_title": _pick(fakes.JOBS, _num(domain, v, 41)),
        "city": _pick(fakes.CITIES, _num(domain, v, 49)),
        "zip": _digits(domain, v, 5, 56),
        "none": f"'anon_' || CAST({_num(domain, v)} % 9000 + 1000 AS VARCHAR)",
    }[kind]


def _ean(body: str, n: int) -> str:
    total = f"list_sum(list_transform(range(1, {n + 1}), lambda i: CAST(substr({body}, i, 1) AS INT) * CASE WHEN ({n} - i) % 2 = 0 THEN 3 ELSE 1 END))"
    return f"({body} || CAST((10 - {total} % 10) % 10 AS VARCHAR))"


def _luhn_total(number: str) -> str:
    return f"list_sum(list_transform(range(0, length({number})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({number}, length({number}) - i, 1) AS INT) WHEN CAST(substr({number}, length({number}) - i, 1) AS INT) > 4 THEN 2 * CAST(substr({number}, length({number}) - i, 1) AS INT) - 9 ELSE 2 * CAST(substr({number}, length({number}) - i, 1) AS INT) END))"


# --- strategies -----------------------------------------------------------

CUSTOMER = {
    "c_name": {"strategy": "hash", "salt": "pepper"},
    "c_mktsegment": {"strategy": "mask", "preserve_last": 3, "mask_char": "#"},
    "c_acctbal": {"strategy": "remove"},
}


@query("SELECT c_custkey, sha256('pepper:' || c_name) AS c_name, repeat('#', length(c_mktsegment) - 3) || right(c_mktsegment, 3) AS c_mktsegment, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
def policy_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Policy.of(CUSTOMER).apply(table(spark, sf_dir, "customer")).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, sha256(CAST(l_partkey AS VARCHAR)) AS l_partkey, md5('s:' || CAST(l_suppkey AS VARCHAR)) AS l_suppkey, '*' AS l_returnflag, CAST(NULL AS DOUBLE) AS l_tax, l_quantity FROM lineitem")
def policy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"l_partkey": {"strategy": "hash"}, "l_suppkey": {"strategy": "hash", "algorithm": "md5", "salt": "s"}, "l_returnflag": {"strategy": "mask"}, "l_tax": {"strategy": "remove"}}
    return Policy.of(config).apply(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_tax", "l_quantity")


_REPLACED = ("name", "email", "phone", "username", "domain", "url", "ipv4", "ipv6", "mac", "job_title", "city", "zip")


@query("SELECT c_custkey, " + ", ".join(f"{_fake_sql(k, 'c_name', 'c_name')} AS \"{k}\"" for k in _REPLACED) + f", {_fake_sql('none', 'c_name', 'c_name')} AS anon FROM customer")
def replace_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", *(replaced(v, k, domain="c_name").alias(k) for k in _REPLACED), replaced(v, "nothing known", domain="c_name").alias("anon"))


_KEY = "CAST(p_partkey AS VARCHAR)"


@query(
    f"SELECT p_partkey, {_ean("('2' || " + _digits('p', _KEY, 11, 43) + ')', 12)} AS ean13, {_ean("('978' || " + _digits('p', _KEY, 9, 44) + ')', 12)} AS isbn13, {_ean(_digits('p', _KEY, 11, 45), 11)} AS upca, true AS imei_ok, true AS card_ok, true AS vin_ok FROM part"
)
def replace_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_partkey")
    made = {k: replaced(v, k, domain="p") for k in ("ean13", "isbn13", "upca", "imei", "credit_card", "vin")}
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        *(made[k].alias(k) for k in ("ean13", "isbn13", "upca")),
        (codecs.luhn(made["imei"]) & (F.length(made["imei"]) == 15)).alias("imei_ok"),
        codecs.luhn(F.replace(made["credit_card"], F.lit("-"), F.lit(""))).alias("card_ok"),
        made["vin"].rlike("^[A-HJ-NPR-Z0-9]{8}[0-9X][A-HJ-NPR-Z0-9]{8}$").alias("vin_ok"),
    )


@query()
def replace_all_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", *(fakes.fake(k, 7, "s", v).alias(k) for k in sorted(fakes.GENERATORS)))


@query()
def replace_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = Policy.of({"c_mktsegment": {"strategy": "replace", "type": "uuid"}}).configure(preserve_relationships=False)
    return policy.apply(table(spark, sf_dir, "customer")).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c, sha256('x:' || CAST(c_custkey AS VARCHAR)) AS d FROM customer")
def hash_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", hashed(v, "md5").alias("a"), hashed(v, "sha1").alias("b"), hashed(v).alias("c"), hashed(F.col("c_custkey"), salt="x").alias("d"))


@query()
def hash_other_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", hashed(v, "sha512").alias("a"), hashed(v, "sha3_256").alias("b"), hashed(v, "blake2b").alias("c"))


@query("SELECT c_custkey, repeat('*', length(c_name)) AS none_kept, CASE WHEN length(c_mktsegment) <= 9 THEN repeat('x', length(c_mktsegment)) ELSE repeat('x', length(c_mktsegment) - 9) || right(c_mktsegment, 9) END AS short, left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) AS ends FROM customer")
def mask_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", masked(c, preserve_last=0).alias("none_kept"), masked(F.col("c_mktsegment"), "x", 9).alias("short"), masked(c, preserve_last=2, preserve_first=2).alias("ends"))


_MAIL = "CASE WHEN c_custkey % 7 = 0 THEN c_name WHEN c_custkey % 5 = 0 THEN 'ab@x.org' ELSE lower(replace(c_name, '#', '.')) || '@mail' || CAST(c_nationkey AS VARCHAR) || '.com' END"


def _mail() -> Column:
    key = F.col("c_custkey")
    made = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@mail"), F.col("c_nationkey").cast("string"), F.lit(".com"))
    return F.when(key % 7 == 0, F.col("c_name")).when(key % 5 == 0, "ab@x.org").otherwise(made)


@query(f"""
WITH t AS (SELECT c_custkey, {_MAIL} AS m FROM customer), u AS (SELECT *, split_part(m, '@', 1) AS l, split_part(m, '@', 2) AS d FROM t)
SELECT c_custkey, CASE WHEN m NOT LIKE '%@%' THEN repeat('*', length(m) - 3) || right(m, 3) WHEN length(l) <= 2 THEN repeat('*', length(l)) || '@' || d
  ELSE left(l, 1) || repeat('*', length(l) - 2) || right(l, 1) || '@' || d END AS partial,
  CASE WHEN length(m) > 12 THEN left(m, 9) || '...' ELSE m END AS short FROM u
""")
def mask_partial_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mail()
    return table(spark, sf_dir, "customer").select("c_custkey", partial_email(m).alias("partial"), truncated(m, 12).alias("short"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN sha256(c_name) ELSE c_name END AS c_name FROM customer")
def conditional_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Policy.of({"c_name": {"strategy": "hash", "where": F.col("c_mktsegment") == "BUILDING"}}).apply(table(spark, sf_dir, "customer")).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 7 THEN sha256('7:' || o_orderpriority) ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_custkey = 7 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders")
def right_to_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erase(table(spark, sf_dir, "orders"), "o_custkey", 7, hashed_fields=("o_orderpriority",), removed_fields=("o_totalprice",)).select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


@query("SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def relationships_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys hashed in both tables still join."""
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    out = apply_tables(tables, {"customer": {"c_custkey": {"strategy": "hash", "salt": "k"}}, "orders": {"o_custkey": {"strategy": "hash", "salt": "k"}}})
    return out["customer"].join(out["orders"], F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query(f"SELECT o.o_orderkey, string_agg(upper(substr(sha256(l.l_shipmode), 1, 8)), ',' ORDER BY l.l_linenumber, l.l_shipmode) AS modes, {_fake_sql('city', 'value', 'o.o_orderpriority')} AS place FROM orders o JOIN (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) l ON l_orderkey = o_orderkey GROUP BY o.o_orderkey, o.o_orderpriority")
def nested_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by path inside structs and arrays."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("mode")))).alias("items"))
    doc = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.struct(F.struct("o_orderpriority").alias("to"), "items").alias("doc"))
    out = apply_nested(doc, {"doc.items.*.mode": {"strategy": "hash"}, "doc.to.o_orderpriority": {"strategy": "replace", "type": "city"}})
    return out.select("o_orderkey", F.array_join(F.transform("doc.items", lambda x: F.upper(F.left(x["mode"], F.lit(8)))), ",").alias("modes"), F.col("doc.to.o_orderpriority").alias("place"))


# --- detection ------------------------------------------------------------

_CASES = (
    ("'user' || {k} || '@mail.com'", lambda k: F.concat(F.lit("user"), k, F.lit("@mail.com"))),
    ("'+1 (212) 555-' || lpad({k}, 4, '0')", lambda k: F.concat(F.lit("+1 (212) 555-"), F.lpad(k, 4, "0"))),
    ("lpad({k}, 3, '9') || '-12-' || lpad({k}, 4, '0')", lambda k: F.concat(F.lpad(k, 3, "9"), F.lit("-12-"), F.lpad(k, 4, "0"))),
    ("'4' || lpad({k}, 15, '7')", lambda k: F.concat(F.lit("4"), F.lpad(k, 15, "7"))),
    ("'10.0.' || right({k}, 2) || '.300'", lambda k: F.concat(F.lit("10.0."), F.right(k, F.lit(2)), F.lit(".300"))),
    ("'192.168.1.' || right({k}, 2)", lambda k: F.concat(F.lit("192.168.1."), F.right(k, F.lit(2)))),
    ("'fe80::' || right({k}, 4)", lambda k: F.concat(F.lit("fe80::"), F.right(k, F.lit(4)))),
    ("'https://x.org/' || {k} || '?a=1'", lambda k: F.concat(F.lit("https://x.org/"), k, F.lit("?a=1"))),
    ("'12345678-1234-1234-1234-' || lpad({k}, 12, '0')", lambda k: F.concat(F.lit("12345678-1234-1234-1234-"), F.lpad(k, 12, "0"))),
    ("'nothing ' || {k}", lambda k: F.concat(F.lit("nothing "), k)),
)
_CASE_SQL = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {sql.format(k='CAST(p_partkey AS VARCHAR)')}" for i, (sql, _) in enumerate(_CASES)) + " END"


def _cases() -> Column:
    key = F.col("p_partkey").cast("string")
    out = F.lit(None).cast("string")
    for i, (_, make) in enumerate(_CASES):
        out = F.when(F.col("p_partkey") % 10 == i, make(key)).otherwise(out)
    return out


@query(f"""
WITH t AS (SELECT p_partkey, {_CASE_SQL} AS v FROM part)
SELECT p_partkey, CASE
  WHEN regexp_full_match(v, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') THEN 'email'
  WHEN regexp_full_match(v, '(\\+?1[-.\\s]?)?\\(?([0-9]{{3}})\\)?[-.\\s]?([0-9]{{3}})[-.\\s]?([0-9]{{4}})') THEN 'phone'
  WHEN regexp_full_match(v, '[0-9]{{3}}-?[0-9]{{2}}-?[0-9]{{4}}') AND left(v, 3) NOT IN ('000', '666') AND left(v, 1) <> '9' AND right(v, 4) <> '0000' AND substr(replace(v, '-', ''), 4, 2) <> '00' THEN 'ssn'
  WHEN regexp_full_match(v, '4[0-9]{{12}}(?:[0-9]{{3}})?') THEN 'credit_card'
  WHEN regexp_full_match(v, '192\\.168\\.1\\.[0-9]+') THEN 'ipv4'
  WHEN regexp_full_match(v, 'fe80::[0-9]+') THEN 'ipv6'
  WHEN regexp_full_match(v, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 'uuid'
  WHEN v LIKE 'https://%' THEN 'url' END AS kind FROM t
""")
def detect_value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", Patterns().value_type(_cases()).alias("kind"))


@query("SELECT * FROM (VALUES ('c_name', 'name', CAST(0.7 AS DOUBLE)), ('s_name', 'name', 0.7), ('n_name', 'name', 0.7)) t(field, type, confidence)")
def detect_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [detect.detect(table(spark, sf_dir, t), "regex", order=[k]).select("field", "type", "confidence") for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("""
WITH a AS (SELECT count(*) AS n, count(DISTINCT c_name) AS d FROM customer)
SELECT 'c_name' AS field, 'name' AS type, CAST(greatest(0.7, 0.8 * d / n) AS DOUBLE) AS confidence, n AS sample_size FROM a
""")
def detect_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "heuristic", order=["c_custkey"]).select("field", "type", "confidence", "sample_size")


@query("""
WITH t AS (SELECT p_partkey, list_filter(string_split(p_name, ''), lambda c: c <> '') AS l FROM part),
u AS (SELECT p_partkey, len(l) AS n, list_transform(list_distinct(l), lambda c: len(list_filter(l, lambda d: d = c))) AS k FROM t)
SELECT p_partkey, round(-list_sum(list_transform(k, lambda c: (CAST(c AS DOUBLE) / n) * log2(CAST(c AS DOUBLE) / n))), 6) + 0.0 AS bits FROM u
""")
def string_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(detect.entropy(F.col("p_name")), 6).alias("bits"))


@query("""
SELECT p_partkey, CASE WHEN regexp_full_match(v, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 0.9
  WHEN regexp_full_match(v, '[0-9a-f]{32,64}') THEN 0.85 WHEN regexp_full_match(v, '[a-zA-Z0-9]{20,}') THEN 0.75 ELSE 0.0 END AS score
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN md5(p_name) WHEN 1 THEN '12345678-1234-1234-1234-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') WHEN 2 THEN 'KEY' || upper(md5(p_name)) || 'Z' ELSE p_name END AS v FROM part)
""")
def format_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    v = F.when(k % 4 == 0, F.md5(name)).when(k % 4 == 1, F.concat(F.lit("12345678-1234-1234-1234-"), F.lpad(k.cast("string"), 12, "0"))).when(k % 4 == 2, F.concat(F.lit("KEY"), F.upper(F.md5(name)), F.lit("Z"))).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", detect.format_score(v).alias("score"))


@query()
def heuristics_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.row_heuristics(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name")


@query("""
WITH t AS (SELECT 'c_name' AS field, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)
SELECT field, count(*) AS n_rows, count(*) FILTER (v <> '') AS n_values, round(avg(length(v)), 6) AS mean_length, round(var_pop(length(v)), 6) AS length_variance FROM t GROUP BY field
""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.profile(table(spark, sf_dir, "customer")).select("field", "n_rows", "n_values", F.round("mean_length", 6).alias("mean_length"), F.round("length_variance", 6).alias("length_variance"))


@query("SELECT * FROM (VALUES ('email', 'email'), ('phone_number', 'phone'), ('note', 'url'), ('full_name', 'name')) t(field, type)")
def detect_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    made = table(spark, sf_dir, "customer").select(
        k,
        F.concat(F.lit("u"), k.cast("string"), F.lit("@mail.com")).alias("email"),
        F.lit("555-123-4567").alias("phone_number"),
        F.when(k % 3 == 0, F.concat(F.lit("https://x.org/"), k.cast("string"))).otherwise(F.lit("nothing")).alias("note"),
        F.col("c_name").alias("full_name"),
    )
    return spark.createDataFrame(list(detect.csv_columns(made, order=["c_custkey"]).items()), "field string, type string")


@query("SELECT * FROM (VALUES ('order.lines[].mail', 'email'), ('order.customer', 'email')) t(path, type)")
def detect_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@mail.com"))
    doc = table(spark, sf_dir, "orders").select(F.struct(mail.alias("customer"), F.array(F.struct(mail.alias("mail"), F.lit(1).alias("n"))).alias("lines")).alias("order"))
    return spark.createDataFrame([(p, r["type"]) for p, r in detect.json_fields(doc).items()], "path string, type string")


_PHONES_SQL = "list_concat(" * 4 + "regexp_extract_all(text, '\\b\\d{3}-\\d{3}-\\d{4}\\b'), regexp_extract_all(text, '\\(\\d{3}\\)\\s*\\d{3}-\\d{4}')), regexp_extract_all(text, '\\b\\d{3}\\.\\d{3}\\.\\d{4}\\b')), regexp_extract_all(text, '\\b\\d{10}\\b')), regexp_extract_all(text, '\\+1[-.\\s]?\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}'))"
_CARDS_SQL = "list_concat(" * 3 + "regexp_extract_all(text, '\\b4\\d{3}[-\\s]?\\d{4}[-\\s]?\\d{4}[-\\s]?\\d{4}\\b'), regexp_extract_all(text, '\\b5[1-5]\\d{2}[-\\s]?\\d{4}[-\\s]?\\d{4}[-\\s]?\\d{4}\\b')), regexp_extract_all(text, '\\b3[47]\\d{2}[-\\s]?\\d{6}[-\\s]?\\d{5}\\b')), regexp_extract_all(text, '\\b6(?:011|5\\d{2})[-\\s]?\\d{4}[-\\s]?\\d{4}[-\\s]?\\d{4}\\b'))"


@query(f"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b'), '|') AS emails,
  array_to_string(list_sort(list_distinct({_PHONES_SQL})), '|') AS phones, array_to_string(list_sort(list_distinct({_CARDS_SQL})), '|') AS cards,
  array_to_string(regexp_extract_all(text, '\\b(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){{3}}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\b'), '|') AS ips FROM documents
""")
def find_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(finders.find_emails(t), "|").alias("emails"), F.array_join(finders.find_phones(t), "|").alias("phones"), F.array_join(finders.find_cards(t), "|").alias("cards"), F.array_join(finders.find_ips(t), "|").alias("ips")
    )


@query()
def find_ssns_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(finders.find_ssns(F.col("text")), "|").alias("ssns"))


@query()
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(finders.redacted(F.col("text")), 256).alias("text_sha256"), (finders.redacted(F.col("text")) != F.col("text")).alias("changed"))


@query(f"SELECT p_partkey, {_luhn_total('n')} % 10 = 0 AS ok FROM (SELECT p_partkey, '4' || lpad(CAST(p_partkey * 7919 AS VARCHAR), 15, '3') AS n FROM part)")
def luhn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat(F.lit("4"), F.lpad((F.col("p_partkey") * 7919).cast("string"), 15, "3"))
    return table(spark, sf_dir, "part").select("p_partkey", codecs.luhn(n).alias("ok"))


_SSN_SQL = "lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(p_partkey % 7 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_partkey % 11 AS VARCHAR), 4, '0')"


def _ssn() -> Column:
    part = lambda n, size: F.lpad((F.col("p_partkey") % n).cast("string"), size, "0")
    return F.concat_ws("-", part(1000, 3), part(7, 2), part(11, 4))


@query(f"""
WITH t AS (SELECT p_partkey, {_SSN_SQL} AS s FROM part), u AS (SELECT *, left(s, 3) NOT IN ('000', '666') AND left(s, 1) <> '9' AND substr(s, 5, 2) <> '00' AND right(s, 4) <> '0000' AS ok FROM t)
SELECT p_partkey, ok AND s NOT IN ('078-05-1120', '219-09-9999', '457-55-5462') AS valid, ok AS in_range FROM u
""")
def validate_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", codecs.valid_ssn(_ssn()).alias("valid"), codecs.ssn_in_range(_ssn()).alias("in_range"))


@query(f"""
WITH t AS (SELECT c_custkey, {_MAIL} AS m FROM customer)
SELECT c_custkey, regexp_full_match(m, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') AND NOT contains(split_part(m, '@', 1), '..') AS valid, false AS disposable FROM t
""")
def validate_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", codecs.valid_email(_mail()).alias("valid"), codecs.is_disposable(_mail()).alias("disposable"))


_CARD_SQL = "CASE p_partkey % 5 WHEN 0 THEN '4' WHEN 1 THEN '52' WHEN 2 THEN '34' WHEN 3 THEN '6011' ELSE '9' END || lpad(CAST(p_partkey AS VARCHAR), 11, '2')"


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'amex' WHEN 3 THEN 'discover' ELSE 'unknown' END AS kind, length({_CARD_SQL}) AS n FROM part")
def card_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lead = F.when(k % 5 == 0, "4").when(k % 5 == 1, "52").when(k % 5 == 2, "34").when(k % 5 == 3, "6011").otherwise("9")
    number = F.concat(lead, F.lpad(k.cast("string"), 11, "2"))
    return table(spark, sf_dir, "part").select("p_partkey", codecs.card_type(number).alias("kind"), F.length(number).cast("long").alias("n"))


# --- codecs ---------------------------------------------------------------


@query(f"""
WITH t AS (SELECT c_custkey, {_MAIL} AS m FROM customer), u AS (SELECT *, split_part(m, '@', 1) AS l, split_part(m, '@', 2) AS d, m LIKE '%@%' AS ok FROM t)
SELECT c_custkey, CASE WHEN ok THEN 'user' || CAST(('0x' || md5(l))::UHUGEINT % 10000 AS VARCHAR) || '@example.com' ELSE m END AS replaced,
  CASE WHEN ok THEN left(sha256(m), 16) || '@hashed' ELSE m END AS hashed,
  CASE WHEN NOT ok THEN m WHEN length(l) <= 2 THEN repeat('*', length(l)) || '@' || d ELSE left(l, 1) || repeat('*', length(l) - 1) || '@' || d END AS masked,
  CASE WHEN ok THEN '***@' || d ELSE m END AS domain_only FROM u
""")
def email_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mail()
    return table(spark, sf_dir, "customer").select("c_custkey", *(codecs.email_simple(m, s).alias(n) for s, n in (("replace", "replaced"), ("hash", "hashed"), ("mask", "masked"), ("domain_only", "domain_only"))))


_TEN = "lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '2')"


@query(f"""
WITH t AS (SELECT c_custkey, {_TEN} AS d FROM customer), u AS (SELECT *, '+1 (' || left(d, 3) || ') ' || substr(d, 4, 3) || '-' || right(d, 4) AS p FROM t)
SELECT c_custkey, '(555) ' || CAST(('0x' || md5(d))::UHUGEINT % 900 + 100 AS VARCHAR) || '-' || lpad(CAST(('0x' || md5(d || 'salt'))::UHUGEINT % 10000 AS VARCHAR), 4, '0') AS replaced,
  left(sha256(p), 10) AS hashed, '(***) ***-' || right(d, 4) AS masked, '****-****-' || right(d, 4) AS last4, '+* (***) ***-' || right(d, 4) AS rich FROM u
""")
def phone_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.lpad((F.col("c_custkey") * 7919 % 10_000_000_000).cast("string"), 10, "2")
    p = F.concat(F.lit("+1 ("), F.left(d, F.lit(3)), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.right(d, F.lit(4)))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", *(codecs.phone_simple(p, s).alias(n) for s, n in (("replace", "replaced"), ("hash", "hashed"), ("mask", "masked"), ("last4", "last4"))), codecs.codec("phone").mask(p).alias("rich")
    )


@query(f"""
SELECT p_partkey, 'SSN-' || upper(left(sha256(s), 12)) AS hashed, 'XXX-XX-' || right(s, 4) AS masked, '****-****-' || right(s, 4) AS last4, '000-' || substr(s, 5, 2) || '-' || right(s, 4) AS invalid,
  '***-**-' || right(s, 4) AS rich_mask, sha256('q:ssn:' || s) AS rich_hash FROM (SELECT p_partkey, {_SSN_SQL} AS s FROM part)
""")
def ssn_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = codecs.codec("ssn")
    plain = (codecs.ssn_simple(_ssn(), s).alias(n) for s, n in (("hash", "hashed"), ("mask", "masked"), ("last4", "last4"), ("invalid", "invalid")))
    return table(spark, sf_dir, "part").select("p_partkey", *plain, rich.mask(_ssn()).alias("rich_mask"), rich.hash(_ssn(), salt="q").alias("rich_hash"))


@query()
def seeded_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements that need Python's own generator."""
    card = replaced(F.col("p_partkey"), "credit_card", domain="card")
    return codecs.seeded(codecs.seeded(table(spark, sf_dir, "part").select("p_partkey"), "ssn", _ssn(), "ssn"), "credit_card", card, "card")


_VISA = "'4' || lpad(CAST(p_partkey AS VARCHAR), 14, '1')"


@query(f"""
WITH t AS (SELECT p_partkey, {_VISA} AS b FROM part), u AS (SELECT *, b || CAST((10 - {_luhn_total("(b || '0')")} % 10) % 10 AS VARCHAR) AS n FROM t)
SELECT p_partkey, 'CARD-' || upper(left(sha256(n), 16)) AS hashed, 'XXXX-XXXX-XXXX-' || right(n, 4) AS masked, right(n, 4) AS last4, n AS back, left(b, 11) AS untouched FROM u
""")
def card_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("4"), F.lpad(F.col("p_partkey").cast("string"), 14, "1"))
    n = F.concat(body, fakes.luhn_digit(body, 15))
    key = "0123456789abcdef"
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        *(codecs.card_simple(n, s).alias(a) for s, a in (("hash", "hashed"), ("mask", "masked"), ("last4", "last4"))),
        codecs.card_from_token(codecs.card_simple(n, "token", key=key), key).alias("back"),
        codecs.card_simple(F.left(body, F.lit(11)), "mask").alias("untouched"),
    )


@query("SELECT c_custkey, 'email' AS original_type, 'mask' AS strategy_used, repeat('*', length(split_part(m, '@', 1))) || '@' || split_part(m, '@', 2) AS value, CAST(length(m) AS VARCHAR) AS original_length FROM (SELECT c_custkey, 'u' || CAST(c_custkey AS VARCHAR) || '@mail.com' AS m FROM customer)")
def rich_codec_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.com"))
    made = table(spark, sf_dir, "customer").select("c_custkey", codecs.codec("email").anonymize(m, "mask").alias("r"))
    return made.select("c_custkey", "r.original_type", "r.strategy_used", "r.value", F.col("r.metadata")["original_length"].alias("original_length"))


@query()
def rich_codec_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = _mail(), F.concat(F.lit("+44 20 "), F.lpad(F.col("c_custkey").cast("string"), 8, "3"))
    kinds = ("replace", "hash", "mask", "remove", "preserve_format", "deterministic")
    email, phone = codecs.codec("email", 1), codecs.codec("phone", 1)
    return table(spark, sf_dir, "customer").select("c_custkey", *(email.anonymize(m, s)["value"].alias(f"email_{s}") for s in kinds), *(phone.anonymize(p, s, preserve_country=True)["value"].alias(f"phone_{s}") for s in kinds))


# --- differential privacy -------------------------------------------------


def _u(query_: str, key: str, kind: str, scale: float, salt: int = 0) -> str:
    group = f"(length({key}) || ':' || {key})"
    return f"((CAST({_num(f'{kind}|{scale!r}|{query_}', group, salt, 3)} AS DOUBLE) + 0.5) / 4503599627370496.0)"


def _laplace(scale: float, query_: str, key: str) -> str:
    u = f"({_u(query_, key, 'laplace', scale)} - 0.5)"
    return f"(-{scale} * sign({u}) * ln(1 - 2 * abs({u})))"


@query(f"SELECT event_type, round(n + {_laplace(2.0, 'by_type', 'event_type')}, 6) AS noisy_count FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def dp_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Private(Budget(1.0), seed=3).count(table(spark, sf_dir, "events"), ["event_type"], query="by_type", epsilon=0.5)
    return out.select("event_type", F.round("noisy_count", 6).alias("noisy_count"))


@query(f"SELECT o_orderpriority, round(s + {_laplace(200000.0, 'spend', 'o_orderpriority')}, 2) AS noisy_sum FROM (SELECT o_orderpriority, sum(least(greatest(o_totalprice, 0), 100000)) AS s FROM orders GROUP BY 1)")
def dp_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Private(Budget(1.0), seed=3).sum(table(spark, sf_dir, "orders"), "o_totalprice", (0.0, 100000.0), ["o_orderpriority"], query="spend", epsilon=0.5)
    return out.select("o_orderpriority", F.round("noisy_sum", 2).alias("noisy_sum"))


_SIGMA = math.sqrt(2 * math.log(1.25 / 0.01)) / 0.5


@query(f"SELECT event_type, round(n + sqrt(2 * ln(1.25 / 0.01)) / 0.5 * sqrt(-2 * ln({_u('g', 'event_type', 'gauss', _SIGMA, 1)})) * cos(2 * pi() * {_u('g', 'event_type', 'gauss', _SIGMA, 2)}), 6) AS noisy_count FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def dp_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Private(Budget(1.0, 0.1), "gaussian", seed=3).count(table(spark, sf_dir, "events"), ["event_type"], query="g", epsilon=0.5, delta=0.01)
    return out.select("event_type", F.round("noisy_count", 6).alias("noisy_count"))


@query("SELECT c_custkey FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) >= 12")
def k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k_anonymous(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 12).select("c_custkey")


# --- sources, sinks, streams ----------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or f"{tempfile.gettempdir()}/veil-files"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_MASKED = "SELECT CAST(c_custkey AS {kind}) AS c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS c_name, c_mktsegment FROM customer"


def _through(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    at, df = _folder(spark, format), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files.write(df, f"{at}/in", format)
    files.anonymize_file(spark, f"{at}/in", f"{at}/out", {"c_name": {"strategy": "mask"}}, format=format)
    return files.read(spark, f"{at}/out", format).select("c_custkey", "c_name", "c_mktsegment")


@query(_MASKED.format(kind="VARCHAR"))
def file_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "csv")


@query(_MASKED.format(kind="VARCHAR"))
def file_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "tsv")


@query(_MASKED.format(kind="BIGINT"))
def file_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "jsonl")


@query(_MASKED.format(kind="BIGINT"))
def file_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "parquet")


@query(_MASKED.format(kind="BIGINT"))
def file_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "orc")


@query(_MASKED.format(kind="BIGINT"))
def file_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "xml")


@query("SELECT p_partkey, p_name FROM part")
def parquet_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "optimized")
    files.optimize_parquet(spark, f"{sf_dir}/part.parquet", at, sort_by=["p_partkey"])
    return spark.read.parquet(at).select("p_partkey", "p_name")


@query("SELECT o_orderkey, sha256(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderpriority <> ''")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return databases.changed_rows(table(spark, sf_dir, "orders"), Policy.of({"o_orderpriority": {"strategy": "hash"}}), ["o_orderkey"])


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS user_id, event_type FROM events")
def stream_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "stream")
    runs.process_large_file(spark, f"{sf_dir}/events.parquet", f"{at}/out", Policy.of({"user_id": {"strategy": "hash"}, "props": {"strategy": "remove"}}), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", width="1 hour").select(F.col("window.start").alias("start"), "event_type", "n")
