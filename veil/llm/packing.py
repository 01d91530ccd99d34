"""Best-two-fit packing of token sequences into sequences of bounded length.

A bin is filled greedily: the longest unpacked piece, then again and again the
longest that fits the gap.  Then, as long as it helps, the bin's smallest piece
gives way to two unpacked pieces that fit the gap it leaves more tightly.

Only lengths matter to that, and there are at most ``capacity`` of them.  So the
plan is made over the histogram of lengths, and every bin that would come out
the same is made at once; the plan has a few thousand entries at any input size.
Pieces then find their places by their rank among the pieces of their length:
their rank within their own partition plus the count of such pieces in the
partitions before.  No group of pieces meets in one task, and token ids are
never shuffled.

Cases: null texts are empty (the end id alone, one piece); repeated rows are
packed like any others; an empty table gives no rows; only the key and the text
are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.llm._shared import bounded_batches, through_table
from veil.llm._text import batches
from veil.llm._tokens import tokenizer, with_end

#: Rows of (partition, length) counts up to which the ranks' offsets are broadcast (about 24 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _pair(left: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths still unpacked whose sum is greatest, above more_than and at most room."""
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return None
    other = np.searchsorted(have, room - have, "right") - 1
    ok = other >= 0
    a, b = have[ok], have[other[ok]]
    single = (a == b) & (left[a] < 2)
    b = np.where(single, have[np.maximum(other[ok] - 1, 0)], b)
    total = np.where(single & (other[ok] == 0), 0, a + b)
    total[(a == b) & (left[a] < 2)] = 0
    if not len(total) or total.max() <= more_than:
        return None
    at = int(total.argmax())
    return int(a[at]), int(b[at])


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many bins, their lengths in order of place) for pieces by length; every piece is in one bin."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left[length] += n
    out = []
    while left.any():
        bin_: list[int] = []
        taken = left.copy()
        gap = capacity
        while gap and len(fit := np.flatnonzero(taken[: gap + 1])):
            length = int(fit[-1])
            n = min(int(taken[length]), gap // length)
            bin_ += [length] * n
            taken[length] -= n
            gap -= n * length
        while gap and (pair := _pair(taken, gap + bin_[-1], bin_[-1])):
            gap += bin_[-1] - sum(pair)
            taken[bin_.pop()] += 1
            for length in pair:
                taken[length] -= 1
            bin_ = sorted([*bin_, *pair], reverse=True)
        lengths, uses = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        out.append((times, bin_))
    return out


@dataclass(frozen=True)
class Plan:
    """Places by (length, rank): each entry covers ``times`` bins that hold ``copies`` pieces of the length."""

    key: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    sequences: int

    SHIFT = 1 << 44

    @classmethod
    def of(cls, bins: list[tuple[int, list[int]]]) -> Plan:
        used: dict[int, int] = {}
        rows, offsets, sequence = [], [], 0
        for times, lengths in bins:
            starts = np.cumsum([0, *lengths[:-1]])
            for length in sorted(set(lengths)):
                own = [int(s) for s, x in zip(starts, lengths, strict=True) if x == length]
                rows.append((length * cls.SHIFT + used.get(length, 0), used.get(length, 0), sequence, len(own), len(offsets)))
                offsets += own
                used[length] = used.get(length, 0) + times * len(own)
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return cls(*(np.ascontiguousarray(table[:, i]) for i in range(5)), np.array(offsets, np.int64), sequence)

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * self.SHIFT + rank, "right") - 1
        into = rank - self.rank[at]
        return self.sequence[at] + into // self.copies[at], self.offsets[self.first[at] + into % self.copies[at]]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most capacity ids: part, nth (rank in its part among pieces of its length), doc_id, piece, start, length, ids (little-endian, 2 or 4 bytes each by the vocabulary's size)."""
    bounded_batches(docs.sparkSession)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, met = tokenizer(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        width = 2 if max(encoder.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in rows:
            for a, b, data, offsets in batches(batch.column(1), 1 << 20):
                ids, counts = encoder.encode(data, offsets)
                ids, edge = with_end(ids, counts, end_id)
                size = np.diff(edge)
                n = -(-size // capacity)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                order = np.argsort(length, kind="stable")
                kind, begin, many = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.repeat(begin, many) + np.repeat(met[kind], many)
                met[kind] += many
                body = ids.astype(f"<u{width}").tobytes()
                ends = np.concatenate([[0], np.cumsum(length) * width]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), part, np.int32)), pa.array(nth), batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), binary],
                    names=["part", "nth", "doc_id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "part int, nth long, doc_id long, piece int, start long, length int, ids binary")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Written pieces (see ``token_pieces``) with sequence_id and offset."""
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = through_table(pieces.sparkSession, by_part, "lengths")
    plan = Plan.of(best_two_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            length = batch.column("length").to_numpy().astype(np.int64)
            sequence, offset = plan.places(length, batch.column("nth").to_numpy() + batch.column("before").to_numpy())
            kept = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(length), batch.column("ids"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "nth", "before", "ids")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as packed pieces with their ids; pieces pass through a table in the shared folder."""
    pieces = through_table(docs.sparkSession, token_pieces(docs, tokenizer_path, end_id, capacity, key=key, text=text), "pieces")
    return pack(pieces, capacity)


def ids_of(blob: bytes, n: int) -> np.ndarray:
    """Ids of a piece as unsigned 32-bit integers."""
    return np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4") if n else np.zeros(0, "<u4")


def digests(packed: DataFrame) -> DataFrame:
    """Packed pieces with the crc32 of their ids in place of the ids."""

    def crc(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.column("length").to_pylist()
            sums = [zlib.crc32(ids_of(blob.as_buffer(), k)) for blob, k in zip(batch.column("ids"), n, strict=True)]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "sequence_id", "offset")}
            columns["ids_crc32"] = pa.array(sums, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return packed.mapInArrow(crc, "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids_crc32 long")
