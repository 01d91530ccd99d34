"""Resharding by minimum-cost flow: equal row counts at the fewest bytes moved.

Rows of an old shard are classed by size (eight classes to a doubling).  A
network carries the rows of each block (old shard, class) either to the shard of
the same number at no cost, or through a pool to any shard at the block's mean
bytes a row.  Shards take floor(rows / shards) each, and as many as needed take
one more.  Successive shortest paths solve it on the driver; the network has a
few thousand nodes at any number of rows.

The bytes of a block's rows are counted at the block's mean, so the cost is least
for sizes within a class (they differ by a tenth at most), not for single rows.
Capacities other than equal shares can be given as rows by shard.

Of a block that gives rows away, the first go, by their rank in it: a row's place
among its block's rows in its partition, plus what the partitions before hold of
the block.  Places are written with the rows, so a task that is run again has
those that count.  No row is shuffled, and no block meets in one task, however
many rows share a size, a key or an old shard.

Old shards are files, a folder for each.  The affected shards are written as
files of a new version, straight from the old ones without a shuffle, and a
manifest that is replaced as a whole says which version holds a shard; a run that
ends early leaves the old manifest, and ``tidied`` deletes versions that none names.

Law kept: ``rows``, the shards' row counts differ by one at most.

Cases: null texts have no bytes and crc 0; sizes are bytes plus a constant for
each row; repeated rows, equal sizes and null keys are rows like any others; a null old
shard is shard 0; old shards beyond the new number give all their rows away; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veil.llm._shared import bounded_batches, filesystem, shared_dir, through_table

CLASSES = 8
BROADCAST_ROWS = 500_000
_CLASS = 1 << 20


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, source: int, sink: int) -> int:
        """Sends as much as fits at least cost.  Costs of arcs with room may not be negative."""
        high: dict[int, float] = defaultdict(float)
        sent = 0
        while True:
            far, by, heap = {source: 0.0}, {}, [(0.0, source)]
            closed = set()
            while heap:
                d, a = heapq.heappop(heap)
                if a in closed:
                    continue
                closed.add(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and b not in closed:
                        n = d + max(0.0, self.cost[e] + high[a] - high[b])
                        if n < far.get(b, float("inf")) - 1e-9:
                            far[b], by[b] = n, e
                            heapq.heappush(heap, (n, b))
            if sink not in far:
                return sent
            most = max(far.values())
            for a in list(self.out):
                high[a] += far.get(a, most)
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = self.to[by[at] ^ 1]
            n = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= n
                self.room[e ^ 1] += n
            sent += n

    def carried(self, arc: int) -> int:
        return self.room[arc ^ 1]


@dataclass(frozen=True)
class Transfer:
    """Ranks [low, high) of a block go to a shard, to slots from ``slot`` on."""

    block: int
    low: int
    high: int
    shard: int
    slot: int


def solve(blocks: dict[int, tuple[int, int]], shards: int, room: Sequence[int] | None = None) -> list[Transfer]:
    """Transfers for blocks {old shard * _CLASS + class: (rows, bytes)} at the least bytes moved.

    room: the most rows of each shard; without it, each gets floor or ceil of its share.
    """
    rows = sum(n for n, _ in blocks.values())
    if room is not None and (len(room) != shards or min(room, default=0) < 0 or sum(room) < rows):
        raise ValueError(f"{rows} rows don't fit the capacities of {shards} shards")
    if not rows:
        return []
    base, extra = divmod(rows, shards)
    flow, kept, given, taken = Flow(), {}, {}, {}
    source, sink, pool, spare = -1, -2, -3, -4
    unfilled = 2.0 * max(b / n for n, b in blocks.values()) + 1
    for i in range(shards):
        flow.arc(i, sink, base if room is None else room[i], 0.0)
        if room is None:
            flow.arc(i, spare, 1, unfilled)  # dearer than any move: the equal shares fill first
        taken[i] = flow.arc(pool, i, rows, 0.0)
    flow.arc(spare, sink, extra, 0.0)
    for at, (block, (n, size)) in enumerate(sorted(blocks.items())):
        node = shards + at
        flow.arc(source, node, n, 0.0)
        if block // _CLASS < shards:
            kept[block] = flow.arc(node, block // _CLASS, n, 0.0)
        given[block] = flow.arc(node, pool, n, size / n)
    if flow.send(source, sink) != rows:
        raise AssertionError("the shards' room is the rows' number")
    need = [[i, flow.carried(taken[i])] for i in range(shards) if flow.carried(taken[i])]
    used, out = [0] * shards, []

    def give(block: int, low: int, high: int, shard: int) -> None:
        out.append(Transfer(block, low, high, shard, used[shard]))
        used[shard] += high - low

    for block in sorted(blocks):
        n, moved = blocks[block][0], flow.carried(given[block])
        if n > moved:
            give(block, moved, n, block // _CLASS)
        low = 0
        while low < moved:
            shard, room = need[-1]
            high = min(moved, low + room)
            give(block, low, high, shard)
            need[-1][1] -= high - low
            if not need[-1][1]:
                need.pop()
            low = high
    return out


def reshard(docs: DataFrame, old_shard: Column, shards: int, *, key: str = "doc_id", text: str = "text", row_bytes: int = 16, carry: tuple[str, ...] = (), room: Sequence[int] | None = None) -> tuple[DataFrame, list[Transfer]]:
    """(doc_id, size, text_crc32, old_shard, shard, slot and the carried columns; the transfers)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
        *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)),
    )
    block = F.col("old_shard").cast("long") * _CLASS + F.floor(F.log2(F.col("size") + F.lit(1)) * CLASSES)
    rows = rows.withColumn("block", block)
    placed = rows.mapInArrow(_nth, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "part int", "nth long"]))
    path = shared_dir(spark, "old-shards")
    placed.write.partitionBy("old_shard").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    by_part = through_table(spark, placed.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "blocks")
    totals = by_part.groupBy("block").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()
    transfers = solve({r["block"]: (r["n"], r["bytes"]) for r in totals}, shards, room)
    before = F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("part", "block", F.coalesce(before, F.lit(0)).alias("before"))
    if by_part.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = placed.join(offsets, ["part", "block"])
    kept = ["doc_id", "size", "text_crc32", "old_shard", *(f"carried_{i}" for i in range(len(carry)))]
    fields = [*(f"`{n}` {ranked.schema[n].dataType.simpleString()}" for n in kept), "shard int", "slot long"]
    out = ranked.select(*kept, "block", (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(_place(transfers, kept), ", ".join(fields))
    return out.withColumnsRenamed({f"carried_{i}": c for i, c in enumerate(carry)}), transfers


def _nth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number, and each row's place among its block's rows there."""
    part, met = TaskContext.get().partitionId(), defaultdict(int)
    for batch in batches:
        own = batch.column("block").to_numpy()
        order = np.argsort(own, kind="stable")
        block, first, many = np.unique(own[order], return_index=True, return_counts=True)
        nth = np.empty(len(own), np.int64)
        nth[order] = np.arange(len(own)) + np.repeat(np.array([met[b] for b in block.tolist()], np.int64) - first, many)
        for b, n in zip(block.tolist(), many.tolist(), strict=True):
            met[b] += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(nth)], names=[*batch.schema.names, "part", "nth"])


def _place(transfers: list[Transfer], kept: list[str]):
    table = np.array(sorted((t.block, t.low, t.shard, t.slot) for t in transfers), np.int64).reshape(-1, 4)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.unique(table[:, 0])
        begin = np.append(np.searchsorted(table[:, 0], first), len(table))
        for batch in batches:
            block, rank = batch.column("block").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(block), np.int64)
            for b in np.unique(block):
                own, i = block == b, int(np.searchsorted(first, b))
                at[own] = begin[i] + np.searchsorted(table[begin[i] : begin[i + 1], 1], rank[own], "right") - 1
            shard, slot = table[at, 2].astype(np.int32), table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(shard), pa.array(slot)], names=[*kept, "shard", "slot"])

    return place


def affected(transfers: list[Transfer]) -> set[int]:
    """Shards whose files change: those that take or lose rows."""
    moved = [t for t in transfers if t.block // _CLASS != t.shard]
    return {t.shard for t in moved} | {t.block // _CLASS for t in moved}


def rewritten(docs: DataFrame, old_shard: Column, shards: int, *, key: str = "doc_id", text: str = "text", row_bytes: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) of every row after the move, size and crc from the text as it stands then.

    The affected shards are written in the shared folder and read back; rows of the others, whose files stay, are read where they are.
    """
    spark = docs.sparkSession
    placed, transfers = reshard(docs, old_shard, shards, key=key, text=text, row_bytes=row_bytes, carry=(text,))
    placed = placed.withColumnRenamed(text, "body").select("doc_id", "body", "old_shard", "slot", "shard")
    path = shared_dir(spark, "shards")
    new = rewrite(placed, transfers, path)
    stay = placed.where(~F.col("shard").isin(sorted(affected(transfers))))
    rows = stay.unionByName(read_shards(spark, path, placed.schema)) if new else stay
    body = F.coalesce("body", F.lit(""))
    return rows.select("doc_id", (F.octet_length(body) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), "old_shard", "shard", "slot")


def rewrite(placed: DataFrame, transfers: list[Transfer], path: str, rows_a_file: int = 1 << 16) -> list[int]:
    """Writes the affected shards as files of a new version (``version=V/shard=N`` below path), and then the manifest; returns the shards written.

    A task writes the rows that it has read, ordered by slot within a file; old files stay for those who read them.
    """
    changed, version = affected(transfers), uuid.uuid4().hex
    new = sorted(changed & {t.shard for t in transfers})
    rows = placed.where(F.col("shard").isin(new)).sortWithinPartitions("shard", "slot")
    rows.write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(f"{path}/version={version}")
    fs, at = filesystem(path)
    now = {s: v for s, v in manifest(path).items() if s not in changed} | dict.fromkeys(new, version)
    with fs.open_output_stream(f"{at}/_manifest-{version}") as f:
        f.write(json.dumps(now).encode())
    fs.move(f"{at}/_manifest-{version}", f"{at}/_manifest.json")
    return new


def manifest(path: str) -> dict[int, str]:
    """The version that holds each rewritten shard."""
    fs, at = filesystem(path)
    if fs.get_file_info(f"{at}/_manifest.json").type.name != "File":
        return {}
    with fs.open_input_stream(f"{at}/_manifest.json") as f:
        return {int(s): v for s, v in json.loads(f.read()).items()}


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all shards as the manifest has them."""
    now = manifest(path)
    out = spark.createDataFrame([], schema)
    for version in sorted(set(now.values())):
        rows = spark.read.schema(schema).parquet(f"{path}/version={version}")
        out = out.unionByName(rows.where(F.col("shard").isin([s for s, v in now.items() if v == version])))
    return out


def tidied(path: str) -> int:
    """Deletes versions that the manifest doesn't name; returns how many."""
    fs, at = filesystem(path)
    held = {f"version={v}" for v in manifest(path).values()}
    gone = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("version=") and f.base_name not in held]
    for folder in gone:
        fs.delete_dir(folder)
    return len(gone)
