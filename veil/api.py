"""The short way: anonymize, detect and preview by path or DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from veil.errors import NoPersonalDataError
from veil.operators.detect import by_pattern, csv_columns, json_fields
from veil.plans.policy import Policy, Rule
from veil.sources.files import FormatOptions, anonymize_file, file_type, read, split_extension
from veil.sources.files import preview as preview_rows


def detect_pii(data: DataFrame | str, spark: SparkSession | None = None, **options: Any) -> dict[str, str]:
    """{field: type}; nested fields by path."""
    df = read(spark or SparkSession.getActiveSession(), data) if isinstance(data, str) else data
    if isinstance(data, str) and file_type(data) in ("json", "jsonl"):
        return {p: r["type"] for p, r in json_fields(df, **options).items()}
    if isinstance(data, str) and file_type(data) in ("csv", "tsv"):
        return csv_columns(df, **options)
    return {f: r["type"] for f, r in by_pattern(df, mode="sample", **options).items()}


def plan(found: dict[str, str], strategy: str = "replace", *, columns: list[str] | None = None, pii_types: list[str] | None = None, seed: object = 0, locale: str = "en_US", preserve_relationships: bool = True) -> Policy:
    """A policy for detected fields, narrowed to columns and types."""
    chosen = {f: k for f, k in found.items() if (not columns or f in columns) and (not pii_types or k in pii_types)}
    return Policy({f.replace("[]", ".*"): Rule(strategy, k) for f, k in chosen.items()}, seed=seed, locale=locale, consistent=preserve_relationships)


def anonymize(data: DataFrame | str, output: str | None = None, strategy: str = "replace", *, dry_run: bool = False, spark: SparkSession | None = None, format_options: FormatOptions | None = None, **options: Any) -> DataFrame | dict[str, Any]:
    """A DataFrame rewritten, or a file rewritten to output (x.anonymized.ext if none is named).

    dry_run: the fields, the policy and three previewed rows instead.
    """
    found = detect_pii(data, spark)
    policy = plan(found, strategy, **options)
    if dry_run:
        df = read(spark or SparkSession.getActiveSession(), data) if isinstance(data, str) else data
        return {"dry_run": True, "fields": found, "policy": {f: {"strategy": r.strategy, "type": r.type} for f, r in policy.rules.items()}, "preview": preview_rows(df, policy, 3)}
    if isinstance(data, DataFrame):
        return policy.apply(data)
    if not found:
        raise NoPersonalDataError(f"no personal data found in {data}")
    target = output or split_extension(data, "anonymized")
    return anonymize_file(spark or SparkSession.getActiveSession(), data, target, policy, format=file_type(data), options=format_options) | {"output": target, "fields": list(policy.rules)}


def preview(data: DataFrame | str, rows: int = 5, strategy: str = "replace", *, spark: SparkSession | None = None, **options: Any) -> list[dict[str, Any]]:
    df = read(spark or SparkSession.getActiveSession(), data) if isinstance(data, str) else data
    return preview_rows(df, plan(detect_pii(data, spark), strategy, **options), rows)
