"""An audit row for each run: what was rewritten, how much, when."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame

from veil.plans.policy import Policy

SCHEMA = "at timestamp, seconds double, dataset string, records_processed long, values_changed long, fields array<string>, strategies array<string>"


def audited(df: DataFrame, policy: Policy, write: Callable[[DataFrame], None], dataset: str, log_path: str | None = None) -> dict[str, Any]:
    """Runs write on the rewritten rows, counting them on the way; appends the entry to a table if one is named."""
    from veil.sources.files import changed_counts

    out, seen = changed_counts(df, policy)
    began = time.monotonic()
    write(out)
    got = seen.get
    fields = [f for f in policy.rules if f in df.columns]
    entry = {
        "at": datetime.now(timezone.utc),
        "seconds": time.monotonic() - began,
        "dataset": dataset,
        "records_processed": got["records_processed"],
        "values_changed": got["values_changed"],
        "fields": fields,
        "strategies": [policy.rules[f].strategy for f in fields],
    }
    if log_path:
        df.sparkSession.createDataFrame([tuple(entry.values())], SCHEMA).write.mode("append").parquet(log_path)
    return entry
