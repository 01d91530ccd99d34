"""Policies over nested data: paths into structs, arrays and maps.

The schema is walked once on the driver; the result is one expression a
top-level column.  Paths are dotted, ``*`` (or ``[]``) is any one segment or
array item.  mode="fnmatch" lets ``*`` cross dots.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from veil.plans.policy import Policy, Rule


def _segments(pattern: str) -> list[str]:
    return pattern.replace("[]", ".*").strip(".").split(".")


def matches(path: str, pattern: str, mode: str = "segments") -> bool:
    """path has ``*`` for array items."""
    if mode == "fnmatch":
        return fnmatch.fnmatchcase(path, ".".join(_segments(pattern)))
    have, want = path.split("."), _segments(pattern)
    return len(have) == len(want) and all(w in ("*", h) for h, w in zip(have, want, strict=True))


def paths(schema: DataType, at: str = "") -> Iterator[tuple[str, DataType]]:
    """Every path of a schema with its type; array items and map values are ``*``."""
    if isinstance(schema, StructType):
        for f in schema.fields:
            here = f"{at}.{f.name}" if at else f.name
            yield here, f.dataType
            yield from paths(f.dataType, here)
    elif isinstance(schema, ArrayType | MapType):
        inner = schema.elementType if isinstance(schema, ArrayType) else schema.valueType
        yield f"{at}.*", inner
        yield from paths(inner, f"{at}.*")


def _rule(policy: Policy, path: str, mode: str) -> Rule | None:
    exact = policy.rules.get(path)
    return exact or next((r for p, r in policy.rules.items() if matches(path, p, mode)), None)


def _touched(policy: Policy, kind: DataType, path: str, mode: str) -> bool:
    return _rule(policy, path, mode) is not None or any(_rule(policy, p, mode) for p, _ in paths(kind, path))


def _rewrite(policy: Policy, value: Column, kind: DataType, path: str, mode: str) -> Column:
    rule = _rule(policy, path, mode)
    if rule is not None:
        body = F.to_json(value) if isinstance(kind, StructType | ArrayType | MapType) and rule.strategy != "remove" else value
        return policy.value(rule, body, "value", kind)
    if not _touched(policy, kind, path, mode):
        return value
    if isinstance(kind, StructType):
        made = F.struct(*(_rewrite(policy, value[f.name], f.dataType, f"{path}.{f.name}", mode).alias(f.name) for f in kind.fields))
        return F.when(value.isNull(), F.lit(None)).otherwise(made)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _rewrite(policy, x, kind.elementType, f"{path}.*", mode))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _rewrite(policy, x, kind.valueType, f"{path}.*", mode))
    return value


def apply_nested(df: DataFrame, policy: Policy | dict[str, Any], mode: str = "segments", **options: Any) -> DataFrame:
    """The policy's paths rewritten, other fields as they are; one value has one replacement under all paths."""
    policy = policy if isinstance(policy, Policy) else Policy.of(policy, domain="value", **options)
    out = {f.name: _rewrite(policy, F.col(f"`{f.name}`"), f.dataType, f.name, mode) for f in df.schema.fields if _touched(policy, f.dataType, f.name, mode)}
    return df.withColumns(out) if out else df


def get_nested(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def set_nested(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Writes a dotted path; parents that are missing are made."""
    head, *rest = path.split(".")

    def put(kind: DataType | None, at: Column | None, parts: list[str]) -> Column:
        if not parts:
            return value
        name, *more = parts
        fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, StructType) else {}
        inner = put(fields.get(name), at[name] if name in fields and at is not None else None, more)
        if not fields or at is None:
            return F.struct(inner.alias(name))
        return F.struct(*((inner if n == name else at[n]).alias(n) for n in fields), *([] if name in fields else [inner.alias(name)]))

    own = head in df.columns
    return df.withColumn(head, put(df.schema[head].dataType if own else None, F.col(f"`{head}`") if own else None, rest))


def rewrite_json_text(text: Column, policy: Policy | dict[str, Any], mode: str = "segments") -> Column:
    """Policy paths inside JSON texts of any shape, row by row in Arrow batches: for documents that share no schema.

    Replacements are ``anon_`` values, the same as those of the column form; texts that aren't JSON stay.
    """
    policy = policy if isinstance(policy, Policy) else Policy.of(policy, domain="value")
    rules = {p: (r.strategy, dict(r.options)) for p, r in policy.rules.items()}
    seed = policy.seed

    def one(value: Any, strategy: str, o: dict[str, Any]) -> Any:
        if value is None or value == "" or strategy == "remove":
            return value if value == "" else None
        body = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
        if strategy == "hash":
            return hashlib.new(o.get("algorithm", "sha256"), (f"{o['salt']}:{body}" if o.get("salt") else body).encode()).hexdigest()
        if strategy == "mask":
            keep, char = o.get("preserve_last", 4), o.get("mask_char", "*")
            return char * len(body) if len(body) <= keep else char * (len(body) - keep) + (body[-keep:] if keep else "")
        if strategy == "replace":
            return f"anon_{int(hashlib.md5(f'{seed}|value|0|{body}'.encode()).hexdigest()[:13], 16) % 9000 + 1000}"
        return value

    def walk(value: Any, path: str) -> Any:
        rule = rules.get(path) or next((r for p, r in rules.items() if path and matches(path, p, mode)), None)
        if rule:
            return one(value, *rule)
        if isinstance(value, dict):
            return {k: walk(v, f"{path}.{k}" if path else k) for k, v in value.items()}
        return [walk(v, f"{path}.*" if path else "*") for v in value] if isinstance(value, list) else value

    def rewrite(body: str | None) -> str | None:
        try:
            return None if body is None else json.dumps(walk(json.loads(body), ""), ensure_ascii=False)
        except ValueError:
            return body

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(rewrite, na_action=None)

    return run(text)
