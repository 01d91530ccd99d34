"""Exact top-k inner-product search by histograms of scores.

All rows are scored against the queries, block by block.  A pass counts each
query's scores in equal buckets of the range that still holds its kth value;
summing the counts over all partitions tells the one bucket that holds it, which
is the next pass's range.  When buckets are one integer wide, the kth value is
known.  A last pass keeps the scores that reach it, and ties go to the smaller
id.

A partition sends the counts of its own best buckets only, down to the one in
which it has met k scores: the global kth value is no less than any partition's,
so lower buckets can't hold it.  Likewise it sends at most its k best rows for a
query, however many tie.  What a query costs in shuffled rows is k for each
partition, not the number of rows.

Queries are taken in blocks of bounded bytes, and ``WAVE`` blocks share each pass
over the rows; a wave is broadcast, at most 16 MB of it.  The queries' block table
is written once, and each wave's results are written as they come.

Scores are integer inner products of floor(scale * x), exact: in doubles as long
as every sum stays below 2**53, in Python integers beyond (held at the ends of
64 bits).

Cases: null vectors, empty ones and those with a null or non-finite component
take no part; vectors of another length than the query's aren't scored against
it; null ids take no part; each repeated query row has its own results, and no
row with the query's id is its candidate; with fewer than k candidates all are
returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.llm._shared import kept, through_table, tidy

#: Bytes of one block of queries, and rows scored at once.
BLOCK_BYTES, ROWS = 2 << 20, 2048
BUCKETS = 512
#: Blocks of queries that a pass over the rows serves.
WAVE = 8
_MOST = np.iinfo(np.int64).max


def integer_vectors(ids: pa.Array, lists: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of floor(scale * x) as doubles) for each length of the vectors that take part."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values
    numbers = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    ok = (size > 0) & ~np.asarray(lists.is_null()) & ~np.asarray(ids.is_null())
    key = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(size[ok]):
        row = np.flatnonzero(ok & (size == d))
        matrix = numbers[offsets[row][:, None] + np.arange(d)]
        whole = np.isfinite(matrix).all(1)
        if whole.any():
            with np.errstate(over="ignore"):  # finite components take part however large
                yield key[row[whole]], np.nan_to_num(np.floor(scale * matrix[whole]))


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, rows by queries."""
    with np.errstate(over="ignore"):
        reach = np.sqrt((rows * rows).sum(1).max()) * np.sqrt((queries * queries).sum(1).max())
    if reach < 2**52:
        return (rows @ queries.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(rows) @ whole(queries).T, -(2**63), 2**63 - 1).astype(np.int64)


class _Block:
    """A block of queries of one length with the range that holds each one's kth value."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        self.low = np.zeros(len(ids), np.int64)
        self.width = np.ones(len(ids), np.uint64)
        self.done = False

    def scored(self, batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row ids, scores by query) in parts of ROWS rows; the query's own rows score the least."""
        for ids, matrix in integer_vectors(batch.column(0), batch.column(1), scale):
            if matrix.shape[1] == self.matrix.shape[1]:
                for at in range(0, len(ids), ROWS):
                    yield ids[at : at + ROWS], scores(matrix[at : at + ROWS], self.matrix)


def _counts(wave: Broadcast, k: int, scale: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("top k")
        blocks = wave.value
        totals = [None if b.done else np.zeros((len(b.ids), BUCKETS + 1), np.int64) for b in blocks]
        for batch in batches:
            for block, total in zip(blocks, totals, strict=True):
                if total is None:
                    continue
                base = np.arange(len(block.ids)) * (BUCKETS + 1)
                for ids, got in block.scored(batch, scale):
                    # as unsigned numbers the difference is exact wherever the score reaches the range
                    bucket = np.minimum((got.view(np.uint64) - block.low.view(np.uint64)) // block.width, np.uint64(BUCKETS)).astype(np.int64)
                    valid = (got >= block.low) & (ids[:, None] != block.ids)
                    total += np.bincount((bucket + base)[valid], minlength=total.size).reshape(total.shape)
        for number, total in enumerate(totals):
            if total is not None:
                above = np.cumsum(total[:, ::-1], 1)[:, ::-1] - total
                query, bucket = np.nonzero((total > 0) & (above < k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), number)), pa.array(query), pa.array(bucket), pa.array(total[query, bucket])], names=["block", "query", "bucket", "n"])
        tidy()

    return count


def _best(wave: Broadcast, k: int, scale: float):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("top k")
        blocks = wave.value
        held = [(np.zeros(0, np.int64),) * 3 for _ in blocks]
        for batch in batches:
            for number, block in enumerate(blocks):
                for ids, got in block.scored(batch, scale):
                    row, query = np.nonzero((got >= block.low) & (ids[:, None] != block.ids))
                    own = tuple(np.concatenate(x) for x in zip(held[number], (query, ids[row], got[row, query]), strict=True))
                    order = np.lexsort((own[1], ~own[2], own[0]))
                    own = tuple(x[order] for x in own)
                    first = np.searchsorted(own[0], own[0])
                    held[number] = tuple(x[np.arange(len(first)) - first < k] for x in own)
        for number, (block, own) in enumerate(zip(blocks, held, strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[own[0]]), pa.array(np.full(len(own[0]), number)), *map(pa.array, own)], names=["query_id", "block", "query", "vec_id", "score"])
        tidy()

    return best


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, *, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    chosen = vectors.where(is_query).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            found = [(matrix.shape[1], float(np.sqrt((matrix * matrix).sum(1).max())), len(ids)) for ids, matrix in integer_vectors(batch.column(0), batch.column(1), scale)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["d", "reach", "n"])

    kinds = {r["d"]: r["reach"] for r in rows.mapInArrow(reach, "d long, reach double, n long").groupBy("d").agg(F.max("reach").alias("reach")).collect()}
    schema = "query_id long, rank int, vec_id long, score long"
    size = chosen.agg(F.sum(F.coalesce(F.size("vector"), F.lit(0)) * 8 + 64).alias("n")).first()["n"] or 0
    if not kinds or not size:
        return spark.createDataFrame([], schema)
    blocks = -(-size // BLOCK_BYTES)
    dealt = through_table(spark, chosen.repartitionByRange(blocks, "vec_id").withColumn("block", F.spark_partition_id()) if blocks > 1 else chosen.withColumn("block", F.lit(0)), "queries")
    waves = []
    for first in range(0, blocks, WAVE):
        wave = []
        for number in range(first, min(first + WAVE, blocks)):
            table = dealt.where(F.col("block") == number).select("vec_id", "vector").toArrow()
            if table.num_rows:
                wave += [_Block(ids, matrix) for ids, matrix in integer_vectors(table.column(0).combine_chunks(), table.column(1).combine_chunks(), scale)]
        if wave:
            waves.append(through_table(spark, _wave(rows, wave, kinds, k, scale), "best"))
    return reduce(DataFrame.unionAll, waves) if waves else spark.createDataFrame([], schema)


def _wave(rows: DataFrame, wave: list[_Block], kinds: dict[int, float], k: int, scale: float) -> DataFrame:
    """The results of some blocks of queries; kinds: the greatest length of a row by number of components."""
    context = rows.sparkSession.sparkContext
    for block in wave:
        with np.errstate(over="ignore"):
            bound = np.ceil(np.sqrt((block.matrix * block.matrix).sum(1)) * kinds[block.matrix.shape[1]]) + 1
        wide = bound >= 2.0**62
        bound = np.where(wide, 0, bound).astype(np.int64)
        block.bottom = np.where(wide, -_MOST - 1, -bound)
        block.low, block.width = block.bottom.copy(), np.where(wide, np.uint64(_MOST), bound.astype(np.uint64)) * np.uint64(2) // np.uint64(BUCKETS) + np.uint64(1)
    while not all(block.done for block in wave):
        shared = context.broadcast(wave)
        counts = rows.mapInArrow(_counts(shared, k, scale), "block long, query long, bucket long, n long").groupBy("block", "query", "bucket").agg(F.sum("n").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("block", "query").orderBy(F.desc("bucket")))
        at = counts.withColumn("so_far", so_far).where(F.col("so_far") >= k).groupBy("block", "query").agg(F.max("bucket").alias("bucket")).toArrow()
        shared.unpersist()
        number, query, bucket = (at.column(i).to_numpy() for i in range(3))
        for i, block in enumerate(wave):
            if block.done:
                continue
            own, of = query[number == i], bucket[number == i]
            few = np.ones(len(block.ids), bool)
            few[own] = False
            inside = of < BUCKETS
            block.low[own[inside]] += (of[inside].astype(np.uint64) * block.width[own[inside]]).view(np.int64)
            block.low[few] = block.bottom[few]
            done = few | (block.width == 1)
            block.done = bool(done.all())
            block.width = np.where(done, np.uint64(1), block.width // np.uint64(BUCKETS) + (block.width % np.uint64(BUCKETS) > 0).astype(np.uint64))
    found = rows.mapInArrow(_best(context.broadcast(wave), k, scale), "query_id long, block long, query long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
