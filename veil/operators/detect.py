"""Detection of columns that hold personal data.

``detect`` gives a DataFrame (field, type, confidence, detected_by,
sample_size); what it reads is bounded by the sample, except for
``profile``, which measures whole columns in one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from veil.errors import PolicyError
from veil.operators.values import NAME_CONFIDENCE, Keywords, Patterns, inferred_type
from veil.plans.policy import Policy

RESULT = "field string, type string, confidence double, detected_by array<string>, sample_size long"
UUID_LIKE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HASH_LIKE = r"(?i)^[0-9a-f]{32,64}$"
KEY_LIKE = r"^[a-zA-Z0-9]{20,}$"


def entropy(value: Column) -> Column:
    """Shannon entropy of a string's characters, in bits a character."""
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(letters).cast("double")
    shares = F.transform(F.array_sort(F.array_distinct(letters)), lambda c: F.size(F.filter(letters, lambda d: d == c)) / n)
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(-F.aggregate(shares, F.lit(0.0), lambda t, p: t + p * F.log2(p)))


def entropy_score(value: Column, threshold: float = 3.5) -> Column:
    return F.when(entropy(value) > threshold, F.least(entropy(value) / 5, F.lit(0.85))).otherwise(0.0)


def format_score(value: Column) -> Column:
    return F.when(value.rlike(UUID_LIKE), 0.9).when(value.rlike(HASH_LIKE), 0.85).when(value.rlike(KEY_LIKE), 0.75).otherwise(0.0)


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _frame(spark: SparkSession, found: dict[str, dict[str, Any]]) -> DataFrame:
    rows = [(f, r["type"], float(r["confidence"]), r.get("detected_by", [r["pattern"]] if r.get("pattern") else []), r.get("sample_size")) for f, r in found.items()]
    return spark.createDataFrame(rows, RESULT)


def detect_value(spark: SparkSession, value: str, patterns: Patterns | None = None) -> dict[str, dict[str, Any]]:
    """The type of one string; not filtered by confidence."""
    patterns = patterns or Patterns()
    kind = spark.createDataFrame([(value,)], "v string").select(patterns.value_type(F.col("v"))).first()[0]
    return {"value": {"type": kind, "confidence": patterns.confidence(kind)}} if kind else {}


def by_pattern(df: DataFrame, patterns: Patterns | None = None, *, order: list[str] | None = None, mode: str = "first", rows: int = 100) -> dict[str, dict[str, Any]]:
    """Fields by value pattern, else by name.  mode "first" reads the first row; "sample" the first fitting value among some rows."""
    patterns = patterns or Patterns()
    names = _strings(df)
    if not names:
        return {}
    some = (df.orderBy(*order) if order else df).select(*(F.col(f"`{n}`") for n in names)).limit(1 if mode == "first" else rows)
    kinds = [patterns.value_type(F.col(f"`{n}`")).alias(f"k{i}") for i, n in enumerate(names)]
    held = [F.col(f"`{n}`").isNotNull().alias(f"h{i}") for i, n in enumerate(names)]
    got = some.select(*kinds, *held).collect()
    out = {}
    for i, n in enumerate(names):
        if not any(r[f"h{i}"] for r in got):
            continue
        kind = next((r[f"k{i}"] for r in got if r[f"k{i}"]), None)
        if kind:
            out[n] = {"type": kind, "confidence": patterns.confidence(kind), "pattern": "value"}
        elif by_name := patterns.name_type(n):
            out[n] = {"type": by_name, "confidence": NAME_CONFIDENCE, "pattern": "field_name"}
    return {n: r for n, r in out.items() if r["confidence"] >= patterns.threshold}


def by_heuristics(df: DataFrame, keywords: Keywords | None = None, *, order: list[str] | None = None, rows: int | None = None) -> dict[str, dict[str, Any]]:
    """Fields by keyword, uniqueness, mean entropy of the first ten and length spread of the first twenty values.

    rows: how many rows the sample has (all if None: uniqueness then takes one aggregation of each column).
    """
    keywords = keywords or Keywords()
    names = _strings(df)
    if not names:
        return {}
    ordered = df.orderBy(*order) if order else df
    sample = ordered.limit(rows) if rows else df
    sums = []
    for i, n in enumerate(names):
        c = F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`"))
        sums += [F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}")]
    whole = sample.agg(F.count(F.lit(1)).alias("rows"), *sums).first()
    # first values: a bounded head of the order; blanks are rare enough that a few times twenty rows hold twenty values, else more are read, and beyond 10,000 rows the non-blank ones of each column
    head, size = ordered.select(*(F.col(f"`{n}`") for n in names)), 100
    if rows:
        head, size = head.limit(rows), min(size, rows)
    while True:
        got = head.limit(size).collect()
        values = [[r[i] for r in got if r[i]][:20] for i in range(len(names))]
        if len(got) < size or size >= 10_000 or all(len(v) >= min(20, whole[f"n{i}"]) for i, v in enumerate(values)):
            break
        size *= 10
    for i, own in enumerate(values):  # columns with few values or late ones
        if len(own) < min(20, whole[f"n{i}"]):
            c = F.col(f"`{names[i]}`")
            values[i] = [r[0] for r in (head if rows else ordered).where(c != "").select(c).limit(20).collect()]
    flat = [(i, j, v) for i, own in enumerate(values) for j, v in enumerate(own)]
    bits: dict[int, list[float]] = {}
    if flat:
        part = df.sparkSession.createDataFrame([x for x in flat if x[1] < 10], "i int, j int, v string")
        for r in part.select("i", entropy(F.col("v")).alias("e")).collect():
            bits.setdefault(r["i"], []).append(r["e"])
    out = {}
    for i, n in enumerate(names):
        count = whole[f"n{i}"]
        if not count:
            continue
        scores: list[tuple[str, float]] = []
        if word := keywords.score(n):
            scores.append(("keyword_match", word))
        if count > 1 and (ratio := whole[f"d{i}"] / count) > keywords.unique:
            scores.append(("high_uniqueness", ratio * 0.8))
        mean = sum(bits[i]) / len(bits[i]) if bits.get(i) else 0.0
        if mean > keywords.entropy:
            scores.append(("high_entropy", min(mean / 5, 0.9)))
        sizes = [len(v) for v in values[i]]
        if len(sizes) > 1 and sum((s - sum(sizes) / len(sizes)) ** 2 for s in sizes) / len(sizes) < 5:
            scores.append(("consistent_format", 0.6))
        if scores:
            reasons = [r for r, s in scores if s > 0.5]
            out[n] = {"type": inferred_type(n, reasons), "confidence": min(1.0, max(s for _, s in scores)), "detected_by": reasons, "sample_size": whole["rows"]}
    return {n: r for n, r in out.items() if r["confidence"] >= keywords.threshold}


def row_heuristics(df: DataFrame, field: str, keywords: Keywords | None = None) -> DataFrame:
    """The single-value heuristics of one column for every row: confidence and detected_by."""
    keywords = keywords or Keywords()
    v = F.col(f"`{field}`")
    names = ("keyword_match", "high_entropy", "format")
    scores = F.array(F.lit(keywords.score(field)), F.round(entropy_score(v, keywords.entropy), 12), format_score(v))
    most = F.array_max("scores")
    reasons = F.filter(F.array(*(F.when((F.col("scores")[i] == most) & (most > 0), F.lit(n)) for i, n in enumerate(names))), lambda r: r.isNotNull())
    return df.withColumn("scores", scores).withColumn("confidence", F.least(most, F.lit(1.0))).withColumn("detected_by", reasons).drop("scores")


def detect(df: DataFrame, method: str = "combined", *, patterns: Patterns | None = None, keywords: Keywords | None = None, order: list[str] | None = None, mode: str = "first", rows: int | None = None) -> DataFrame:
    """regex, heuristic, or combined (heuristics, overruled by patterns)."""
    if method not in ("regex", "heuristic", "combined"):
        raise PolicyError(f"unknown detection method {method!r}", "Methods: regex, heuristic, combined.")
    found = by_heuristics(df, keywords, order=order, rows=rows) if method != "regex" else {}
    if method != "heuristic":
        found |= by_pattern(df, patterns, order=order, mode=mode)
    return _frame(df.sparkSession, found)


def automatic_policy(df: DataFrame, strategy: str = "replace", *, patterns: Patterns | None = None, order: list[str] | None = None, mode: str = "first", **options: Any) -> Policy:
    """What is used without a policy: every detected field with one strategy."""
    found = by_pattern(df, patterns, order=order, mode=mode)
    return Policy.of({n: {"strategy": strategy, "type": r["type"]} for n, r in found.items()}, **options)


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def csv_columns(df: DataFrame, patterns: Patterns | None = None, *, order: list[str] | None = None, rows: int = 100) -> dict[str, str]:
    """Column types of a table of strings: the first value's type, else the name's, else that of the first later value that fits."""
    patterns = patterns or Patterns()
    names = _strings(df)
    got = (df.orderBy(*order) if order else df).select(*(F.col(f"`{n}`") for n in names)).limit(rows)
    kinds = got.select(*(F.struct(F.col(f"`{n}`").alias("v"), patterns.value_type(F.col(f"`{n}`")).alias("k")).alias(f"c{i}") for i, n in enumerate(names))).collect()
    out = {}
    for i, n in enumerate(names):
        own = [r[i]["k"] for r in kinds if r[i]["v"]]
        kind = (own[0] or patterns.name_type(n) or next((k for k in own[1:] if k), None)) if own else None
        if kind:
            out[n] = kind
    return out


def json_fields(df: DataFrame, patterns: Patterns | None = None, *, rows: int = 100, items: int = 5) -> dict[str, dict[str, Any]]:
    """Detected paths of nested data (``[]`` for array items), from some rows and the first items of arrays; of several types for a path the last holds."""
    patterns = patterns or Patterns()
    leaves: list[tuple[str, Column]] = []

    def walk(kind: Any, value: Column, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(f.dataType, value[f.name], f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            for f in kind.elementType.fields:
                walk(ArrayType(f.dataType), F.transform(F.slice(value, 1, items), _field(f.name)), f"{path}[].{f.name}")
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType):
            walk(kind.elementType, F.flatten(F.slice(value, 1, items)), path)
        elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
            leaves.append((path, F.filter(F.transform(F.slice(value, 1, items), patterns.value_type), lambda k: k.isNotNull())))
        elif isinstance(kind, StringType):
            leaves.append((path, F.filter(F.array(patterns.value_type(value)), lambda k: k.isNotNull())))

    for f in df.schema.fields:
        walk(f.dataType, F.col(f"`{f.name}`"), f.name)
    got = df.limit(rows).select(*(c.alias(f"c{i}") for i, (_, c) in enumerate(leaves))).collect() if leaves else []
    out = {}
    for i, (path, _) in enumerate(leaves):
        kinds = [k for r in got for k in (r[i] or [])]
        kind = kinds[-1] if kinds else None
        if kind:
            out[path] = {"type": kind, "confidence": patterns.confidence(kind)}
        elif by_name := patterns.name_type(path.split(".")[-1]):
            out[path] = {"type": by_name, "confidence": NAME_CONFIDENCE}
    return out


def profile(df: DataFrame, fields: list[str] | None = None, patterns: Patterns | None = None) -> DataFrame:
    """For each string column over all rows, in one aggregation: rows, blanks, distinct values (approximate), length mean and variance, and matches by type."""
    patterns = patterns or Patterns()
    names = fields or _strings(df)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("v")) for n in names))).alias("x")).select("x.*")
    held = F.col("v").isNotNull() & (F.col("v") != "")
    kind = patterns.value_type(F.col("v"))
    return (
        long.withColumn("kind", kind)
        .groupBy("field")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(held).alias("n_values"),
            F.approx_count_distinct(F.when(held, F.col("v"))).alias("n_distinct"),
            F.avg(F.when(held, F.length("v"))).alias("mean_length"),
            F.var_pop(F.when(held, F.length("v"))).alias("length_variance"),
            *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, _, _ in patterns.values),
        )
    )
