"""A policy over a stream of files.

Rules are functions of the row, so a stream needs no state and no order.
Offsets and commits in the checkpoint folder make restarts exactly-once for file
sinks.  The source rows of batches that fail go to a quarantine folder, if one is
named, and the run goes on.
"""

from __future__ import annotations

import re
import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from veil.plans.policy import Policy


@dataclass(frozen=True)
class StreamOptions:
    files_per_batch: int = 64
    #: Wait for more files with this pause; None: take what is there and end.
    every: str | None = None
    tries: int = 3
    continue_on_error: bool = False


def stream(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", options: StreamOptions | None = None, **reader: Any) -> DataFrame:
    o = options or StreamOptions()
    if "." in path.rpartition("/")[2] and not re.search(r"[*?{\[]", path):
        path = f"{path[:-1]}[{path[-1]}]"  # a stream's path is a folder or a pattern; this pattern fits that name alone
    return spark.readStream.format(format).schema(schema).options(maxFilesPerTrigger=o.files_per_batch, **reader).load(path)


@dataclass
class Totals:
    """What a run has done so far, over all of its batches."""

    rows: int = 0
    batches: int = 0
    seconds: float = 0.0
    ended: bool = False

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0

    def seconds_left(self, rows: int) -> float | None:
        """By the pace so far, for a run over so many rows."""
        return (rows - self.rows) / self.rows_per_second if self.rows else None


class _Watch(StreamingQueryListener):
    """Adds up every batch of every run: a run itself remembers its last hundred only."""

    def __init__(self) -> None:
        self.runs: dict[str, Totals] = defaultdict(Totals)

    def onQueryStarted(self, event: Any) -> None:
        self.runs[str(event.runId)]

    def onQueryProgress(self, event: Any) -> None:
        if event.progress.numInputRows:
            own = self.runs[str(event.progress.runId)]
            own.rows, own.batches, own.seconds = own.rows + event.progress.numInputRows, own.batches + 1, own.seconds + event.progress.batchDuration / 1000

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.runs[str(event.runId)].ended = True


_watches: dict[str, _Watch] = {}


def _watch(spark: SparkSession) -> _Watch:
    name = spark.sparkContext.applicationId
    if name not in _watches:
        _watches[name] = _Watch()
        spark.streams.addListener(_watches[name])
    return _watches[name]


def progress(query: StreamingQuery, spark: SparkSession | None = None) -> Totals:
    """The run's totals up to now."""
    return _watch(spark or SparkSession.getActiveSession()).runs[str(query.runId)]


def anonymize_stream(source: DataFrame, policy: Policy, target: str, checkpoint: str, *, format: str = "parquet", options: StreamOptions | None = None, quarantine: str | None = None, on_batch: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Starts a run; wait for it with ``finish``.

    quarantine: a folder for the source rows, as JSON, of batches that fail at every try.  on_batch: called with the number and rows of each written batch.
    """
    o, spark = options or StreamOptions(), source.sparkSession
    _watch(spark)
    plain = quarantine is None and on_batch is None and not o.continue_on_error
    writer = (policy.apply(source) if plain else source).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(processingTime=o.every) if o.every else writer.trigger(availableNow=True)
    if plain:
        return writer.format(format).option("path", target).start()

    def put(batch: DataFrame, number: int) -> None:
        # a batch has a folder of its own, written over if it is run again
        for attempt in range(o.tries):
            try:
                seen = Observation()
                policy.apply(batch).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(format).save(f"{target}/batch={number}")
            except Exception:
                if attempt + 1 < o.tries:
                    continue
                if not o.continue_on_error or quarantine is None:
                    raise
                batch.withColumn("veil_batch", F.lit(number)).write.mode("overwrite").json(f"{quarantine}/batch={number}")
                return
            if on_batch:
                on_batch(number, seen.get["rows"])
            return

    return writer.foreachBatch(put).start()


def finish(query: StreamingQuery, wait: float = 30.0) -> dict[str, Any]:
    """Waits for the run's end; rows, batches, seconds and rows a second of all its batches."""
    query.awaitTermination()
    own, end = progress(query), time.monotonic() + wait
    while not own.ended and time.monotonic() < end:  # the last events may still be on their way
        time.sleep(0.02)
    return {"rows_processed": own.rows, "batches_processed": own.batches, "seconds": own.seconds, "rows_per_second": own.rows_per_second}


def process_large_file(spark: SparkSession, source: str, target: str, policy: Policy, checkpoint: str, *, format: str = "parquet", options: StreamOptions | None = None) -> dict[str, Any]:
    """A file or folder of files through a policy, to its end; run again with the same checkpoint, it takes new files only."""
    schema = spark.read.format(format).load(source).schema
    return finish(anonymize_stream(stream(spark, source, schema, format, options), policy, target, checkpoint, format=format, options=options))


def windowed_counts(source: DataFrame, time: str, key: str, *, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows by window and key; rows later than ``late`` are dropped (streams only)."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return source.withWatermark(time, late).groupBy(window.alias("window"), key).agg(F.count(F.lit(1)).alias("n"))
