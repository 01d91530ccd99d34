"""Exact removal of byte strings that repeat in a corpus, by column-wise suffix order and common prefixes.

A string of ``length`` bytes is repeated if it starts at any other place too, in
the same text or another.  All of its bytes go.

**Dealing.**  A transform of the whole corpus would need as many rounds over all
of it as its longest text has bytes, so strings that could be equal are first
brought together.  A window's anchor is its k-gram with the least hash, the
leftmost of equals, so equal windows have equal anchors at equal offsets.
Windows that follow each other and have one anchor form a segment; a text has
about one for every 85 bytes.  Anchors that occur once are done with.  Equal
segments of an anchor (by 128 bits) are one document with a count, and two copies
of it stand for any number.

An anchor with more than ``widest`` documents is split by what stands beside it:
a window holds either at least half of its remaining bytes before the anchor, or
more than half behind it.  A document's windows of the first sort go to a part
named by those bytes before the anchor, those of the second to a part named by
the bytes behind, each window to one part, and equal windows to the same one.
Parts are split again until they are narrow, eight times at most, since then all
bytes of a window name its part.

**Collections.**  Documents of whole groups, aligned at their anchors, form a
collection of bounded size.  Its Burrows-Wheeler transform is built by columns
from the right.  A round puts one more symbol before every document's suffix.
That symbol is read from the transform that the round before it wrote, and the new
suffix order follows from the ranks of the transform's symbols; the common
prefix of new neighbours is one more than the least of the old ones between
them.  As equal windows of a group stand in one column, only the suffixes of a
column need to be ordered among themselves.  Order, common prefixes and
transform pass from round to round through a file that is written and read
sequentially; nothing else is kept between rounds.  A last pass over the file
takes the windows whose suffix shares ``length`` bytes with a neighbour.  The
file is scratch of one task attempt, as Spark's own spill files are: no other
task reads it, and it ends with the attempt.

Cases: null texts are empty; texts shorter than ``length`` stay whole; repeated
rows and repeated keys are rows of their own and repeat each other; null keys
stay null, and keys that are no numbers become null in ``doc_id`` (carry the key
with ``keep`` to have it as it is); very long texts are read in overlapping
parts of bounded size; an empty table gives no rows; columns that the caller
carries may have any name.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm._shared import Scratch, bounded_batches, by_likely, kept, release, tidy
from veil.llm._text import batches, chunks, mix, span_keys


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    #: Bytes of an anchor, a multiple of eight.
    gram: int = 32
    #: Documents of a collection (whole groups), and of a group that goes into one.
    collection: int = 8_192
    widest: int = 4_096
    #: Bytes of a text that are read together.
    part: int = 1 << 20


_PLACE = np.uint64((1 << 28) - 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Transform symbols: a byte + 1, or one of these.
NOT_BEGUN, ENDED = 0, 257


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the gram at each place; only which is least counts, so that equal hashes do no harm."""
    eight, n = chunks(data), len(data) - size + 1
    out = np.zeros(n, np.uint64)
    for at in range(0, size, 8):
        out ^= eight[at : at + n]
        out *= _STEP
        out ^= out >> np.uint64(32)
    return mix(out)


def segments(data: np.ndarray, offsets: np.ndarray, rule: Repeats, named: bool = True) -> tuple[np.ndarray, ...]:
    """anchor, text, first window, number of windows, offset of the anchor of each segment of the texts, and its 128-bit name in two parts if named."""
    n, w = len(data), rule.length - rule.gram + 1
    none = (np.zeros(0, np.int64),) * (7 if named else 5)
    if n < rule.length:
        return none
    if n > int(_PLACE):
        raise ValueError("read longer texts in parts")
    own = grams(data, rule.gram)
    packed = (own & ~_PLACE) | np.arange(len(own), dtype=np.uint64)
    blocks = np.full(-(-len(own) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(own)] = packed
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, 1).ravel()
    windows = n - rule.length + 1
    least = np.minimum(ahead[:windows], behind[w - 1 : w - 1 + windows])
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.maximum(offsets[1:] - rule.length + 1, offsets[:-1]), 1)
    np.add.at(crossing, offsets[1:], -1)
    start = np.flatnonzero(np.cumsum(crossing[:windows]) == 0)
    if not len(start):
        return none
    place = (least[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    first, many, place = start[begin], np.diff(np.append(begin, len(start))), place[begin]
    text = np.searchsorted(offsets, first, "right") - 1
    out = own[place].view(np.int64), text, first - offsets[text], many, place - first
    if not named:
        return out
    eight, at = chunks(data), (place - first).astype(np.uint64)
    names = (mix(span_keys(eight, first, first + many + rule.length - 1, lane) + at).view(np.int64) for lane in (1, 2))
    return (*out, *names)


def insert_column(order: np.ndarray, common: np.ndarray, transform: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The next column's suffix order and common prefixes from the last one's order, prefixes and transform.

    A suffix moves to the place that its symbol's rank in the transform gives it, within its group.
    """
    alive = np.flatnonzero(transform != ENDED)
    key = group[order[alive]] * (ENDED + 1) + transform[alive]
    ranks = np.argsort(key, kind="stable")
    place, key = alive[ranks], key[ranks]
    pair = 1 + np.flatnonzero((key[1:] == key[:-1]) & (transform[place[1:]] != NOT_BEGUN))
    prefix = np.zeros(len(place), np.int64)
    if len(pair):
        low, high = place[pair - 1] + 1, place[pair] + 1
        if (high - low == 1).all():
            least = common[low]
        else:
            least = np.minimum.reduceat(np.append(common, 0), np.stack([low, high], 1).ravel())[::2]
        prefix[pair] = np.minimum(least + 1, length)
    return order[place], prefix


def _write(spool: BinaryIO, order: np.ndarray, common: np.ndarray, transform: np.ndarray) -> None:
    spool.write(order.astype(np.int32).tobytes() + common.astype(np.uint16).tobytes() + transform.astype(np.uint16).tobytes())


def _read(spool: BinaryIO, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(spool.read(4 * n), np.int32), np.frombuffer(spool.read(2 * n), np.uint16).astype(np.int64), np.frombuffer(spool.read(2 * n), np.uint16).astype(np.int64)


def repeated_windows(group: np.ndarray, before: np.ndarray, size: np.ndarray, body: np.ndarray, length: int) -> np.ndarray:
    """For documents sorted by group, with their anchor at offset ``before``: which of their windows occur in another document of the group.

    body: all documents' bytes, one after another.  Returns documents x windows.
    """
    m = len(group)
    first, last = -before, size - before
    base, width = int(first.min()), int(last.max() - first.min())
    first, last = first - base, last - base
    lines, at = np.zeros((m, width), np.uint8), 0
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        lines[i, a:b] = body[at : at + b - a]
        at += b - a
    matrix = np.ascontiguousarray(lines.T)
    del lines

    def symbols(column: int, order: np.ndarray) -> np.ndarray:
        """The transform: what stands before each suffix of the order."""
        if column < 0:
            return np.full(len(order), ENDED)
        return np.where(first[order] > column, ENDED, np.where(last[order] > column, matrix[column, order].astype(np.int64) + 1, NOT_BEGUN))

    out = np.zeros((m, int((size - length + 1).max())), bool)
    with tempfile.TemporaryFile() as spool:
        order = np.arange(m)
        _write(spool, order, np.zeros(m, np.int64), symbols(width - 1, order))
        counts, start = [m], 0
        for column in range(width - 1, -1, -1):
            spool.seek(start)
            order, common = insert_column(*_read(spool, counts[-1]), group, length)
            start += 8 * counts[-1]
            _write(spool, order, common, symbols(column - 1, order))
            counts.append(len(order))
        spool.seek(0)
        for column, n in zip(range(width, -1, -1), counts, strict=True):
            order, common, _ = _read(spool, n)
            hit = common >= length
            hit[:-1] |= hit[1:].copy()
            out[order[hit], column - first[order[hit]]] = True
    return out


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end column of the runs of a matrix of flags."""
    wide = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
    wide[:, 1:-1] = hit
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1]


#: A document's name: its group and the 128 bits of its bytes.
NAME = ["anchor", "high", "low"]


def _collections(documents: DataFrame, rule: Repeats) -> DataFrame:
    """(anchor, high, low, begin, end): runs of repeated windows of documents (anchor, high, low, times, before, body) of narrow groups."""

    def finish(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        copies = np.minimum(table["times"].to_numpy(), 2)
        whole = np.repeat(np.arange(len(copies)), copies)
        anchor = table["anchor"].to_numpy()
        group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))[whole]
        bodies = [memoryview(b.as_buffer()) for b in table["body"]]
        size = np.fromiter(map(len, bodies), np.int64, len(bodies))[whole]
        hit = repeated_windows(group, table["before"].to_numpy().astype(np.int64)[whole], size, np.frombuffer(b"".join(bodies[i] for i in whole), np.uint8), rule.length)
        row, low, high = _runs(hit[np.cumsum(copies) - copies])
        return pa.RecordBatch.from_arrays([*(pa.array(table[c].to_numpy()[row]) for c in NAME), pa.array(low), pa.array(high)], names=[*NAME, "begin", "end"])

    def order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("repeats")
        waiting: list[pa.RecordBatch] = []
        held = 0
        for part in parts:
            if not part.num_rows:
                continue
            waiting.append(part)
            held += part.num_rows
            if held >= rule.collection:
                table = pa.Table.from_batches(waiting)
                anchor = table["anchor"].to_numpy()
                end = int(np.searchsorted(anchor, anchor[-1]))
                if end:
                    yield finish(table.slice(0, end))
                    waiting = table.slice(end).to_batches()
                    held = table.num_rows - end
        if held:
            yield finish(pa.Table.from_batches(waiting))
        tidy()

    dealt = documents.select(*NAME, "times", "before", "body").repartition("anchor").sortWithinPartitions(*NAME)
    return dealt.mapInArrow(order, "anchor long, high long, low long, begin long, end long")


def _split(documents: DataFrame, rule: Repeats) -> DataFrame:
    """Parts of the documents of wide groups: whose they are, where their windows begin in it, and the documents that they are."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("repeats")
        for part in parts:
            out: list[tuple] = []
            columns = (part[c].to_pylist() for c in (*NAME, "times", "before", "ahead", "behind"))
            for anchor, high, low, times, before, ahead, behind, blob in zip(*columns, part["body"], strict=True):
                data = np.frombuffer(blob.as_buffer(), np.uint8)
                windows = len(data) - rule.length + 1
                half = ahead + -(-(rule.length - rule.gram - ahead - behind) // 2)
                rest = rule.length - rule.gram - half + 1
                middle = min(max(before - half + 1, 0), windows)  # the windows before it have at least half bytes ahead of the anchor
                sides = ((0, middle, half, behind, before - half, before), (middle, windows, ahead, rest, before + rule.gram, before + rule.gram + rest))
                eight = chunks(data)
                for side, (begin, end, ahead_, behind_, a, b) in enumerate(sides):
                    if begin < end:
                        name = lambda x, y, lane, salt, eight=eight: int(mix(span_keys(eight, np.array([x]), np.array([y]), lane) ^ mix(np.array([salt & (2**64 - 1)], np.uint64))).view(np.int64)[0])
                        at = before - begin
                        own = data[begin : end + rule.length - 1].tobytes()
                        out.append((anchor, high, low, begin, name(a, b, 0, anchor + side + 1), name(begin, end + rule.length - 1, 1, at), name(begin, end + rule.length - 1, 2, at), times, at, ahead_, behind_, own))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
        tidy()

    schema = pa.schema([*((c, pa.int64()) for c in (*NAME, "shift", "part", "part_high", "part_low", "times")), ("before", pa.int16()), ("ahead", pa.int16()), ("behind", pa.int16()), ("body", pa.binary())])
    fields = ", ".join(f"{f.name} {'binary' if f.name == 'body' else 'short' if f.type == pa.int16() else 'long'}" for f in schema)
    return documents.select(*NAME, "times", "before", "ahead", "behind", "body").mapInArrow(split, fields)


def repeated_runs(documents: DataFrame, rule: Repeats, scratch: Scratch) -> DataFrame:
    """(anchor, high, low, begin, end): runs of windows that occur twice, of written documents (anchor, high, low, times, before, ahead, behind, body).

    ahead, behind: how many bytes before and after the anchor are known to be in every window of the document.
    """
    wide = scratch.table(documents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rule.widest).select("anchor"), "wide")
    if wide.isEmpty():
        return _collections(documents, rule)
    narrow = scratch.table(_collections(documents.join(wide, "anchor", "left_anti"), rule), "runs")
    pieces = scratch.table(_split(documents.join(wide, "anchor", "left_semi"), rule), "pieces")
    names = [F.col("part").alias("anchor"), F.col("part_high").alias("high"), F.col("part_low").alias("low")]
    same = [F.first(c).alias(c) for c in ("before", "ahead", "behind", "body")]
    children = scratch.table(pieces.select(*names, "times", "before", "ahead", "behind", "body").groupBy(*NAME).agg(F.sum("times").alias("times"), *same), "documents")
    below = repeated_runs(children, rule, scratch).select(F.col("anchor").alias("part"), F.col("high").alias("part_high"), F.col("low").alias("part_low"), "begin", "end")
    found = pieces.drop("body").join(below, ["part", "part_high", "part_low"]).select(*NAME, (F.col("begin") + F.col("shift")).alias("begin"), (F.col("end") + F.col("shift")).alias("end"))
    return narrow.unionByName(found)


def repeated_spans(rows: DataFrame, rule: Repeats, scratch: Scratch) -> DataFrame:
    """(row, spans): byte spans (low, high) of repeated strings of written rows (row, body), as a set that may overlap; rows without any are left out."""
    spark = rows.sparkSession

    def parts_of(column: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """Runs of texts, and overlapping parts of longer ones with the place where they begin."""
        for a, b, data, offsets in batches(column, 1 << 19):
            if b - a > 1 or len(data) <= rule.part:
                yield a, b, 0, data, offsets
            else:
                for at in range(0, len(data) - rule.length + 1, rule.part):
                    some = data[at : at + rule.part + rule.length - 1]
                    yield a, b, at, some, np.array([0, len(some)])

    def anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("repeats")
        for part in parts:
            for _, _, _, data, offsets in parts_of(part.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(segments(data, offsets, rule, False)[0])], names=["anchor"])
        tidy()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("repeats")
        for part in parts:
            for a, b, at, data, offsets in parts_of(part.column(1)):
                anchor, text, first, many, before, high, low = segments(data, offsets, rule)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(high), pa.array(low), part.column(0).slice(a, b - a).take(pa.array(text)), pa.array(first + at), pa.array(many.astype(np.int16)), pa.array(before.astype(np.int16))], names=[*NAME, "row", "first", "many", "before"])
        tidy()

    # written, so that the join has plain shuffles on both sides and Spark can split an anchor that very many rows share
    often = rows.select("body").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor")
    often = scratch.table(often, "anchors")
    every = rows.select("row", "body").mapInArrow(cut, "anchor long, high long, low long, row long, first long, many short, before short")
    found = scratch.table(every.join(often, "anchor"), "segments")
    release(spark)
    scratch.drop(often)
    kinds = found.groupBy(*NAME).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first")).alias("at"), F.first("many").alias("many"), F.first("before").alias("before"))
    wanted = scratch.table(kinds.select("at.row", "at.first", *NAME, "many", "before", "times"), "kinds")

    def take(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("repeats")
        for part in parts:
            for one, found in zip(part["body"], part["wanted"], strict=True):
                text, segment = memoryview(one.as_buffer()), found.values
                for at in range(0, len(segment), 1 << 13):
                    own = segment.slice(at, 1 << 13)
                    first, many = own.field("first").to_pylist(), own.field("many").to_pylist()
                    bodies = [text[f : f + k + rule.length - 1].tobytes() for f, k in zip(first, many, strict=True)]
                    none = pa.array(np.zeros(len(own), np.int16))
                    yield pa.RecordBatch.from_arrays([*(own.field(c) for c in (*NAME, "times", "before")), none, none, pa.array(bodies, pa.binary())], names=[*NAME, "times", "before", "ahead", "behind", "body"])
        tidy()

    texts = by_likely(rows.select("row", "body"), "row", wanted.select("row"))[0]
    schema = "anchor long, high long, low long, times long, before short, ahead short, behind short, body binary"
    # a text's segments in one list, no longer than the text: each text goes to a worker once
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("first", "many", *NAME, "times", "before")).alias("wanted"))
    documents = scratch.table(texts.join(lists, "row").select("body", "wanted").mapInArrow(take, schema), "documents")
    release(spark)
    scratch.drop(wanted)
    runs = scratch.table(repeated_runs(documents, rule, scratch), "runs")
    release(spark)
    scratch.drop(documents)
    low = F.col("first") + F.col("begin")
    spans = found.join(runs, NAME).select("row", low.alias("from"), (low + F.col("end") - F.col("begin") + F.lit(rule.length - 1)).alias("to"))
    spans = scratch.table(spans.groupBy("row").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "spans")
    release(spark)
    scratch.drop(found, runs)
    return spans


def remove_repeats(docs: DataFrame, rule: Repeats | None = None, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """The key, the kept columns (as kept_0, kept_1, ...), n_bytes, n_removed, n_spans and body (the bytes that stay), a row for each row.

    whole_characters: characters of which some byte isn't repeated stay whole, so that body is UTF-8.
    """
    rule, spark = rule or Repeats(), docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "repeats")
    carried = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"), *carried)
    rows = scratch.table(rows, "rows")  # the rows' numbers are as written, however often they are read
    spans = repeated_spans(rows, rule, scratch)

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("repeats")
        for part in parts:
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "cut": []}
            for one, found in zip(part["body"], part["spans"], strict=True):
                data = np.frombuffer(one.as_buffer(), np.uint8)
                depth = np.zeros(len(data) + 1, np.int32)
                if found.is_valid:
                    np.add.at(depth, found.values.field("from").to_numpy(), 1)
                    np.add.at(depth, found.values.field("to").to_numpy(), -1)
                gone = np.cumsum(depth)[:-1] > 0
                if whole_characters:
                    begin = np.flatnonzero((data & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, begin), np.diff(np.append(begin, len(data)))) if len(begin) else gone
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                out["cut"].append(data[~gone].tobytes())
            kinds = {"n_removed": pa.int64(), "n_spans": pa.int64(), "cut": pa.binary()}
            size = pa.array(np.diff(np.frombuffer(part["body"].buffers()[1], np.int32)[part["body"].offset : part["body"].offset + part.num_rows + 1]).astype(np.int64))
            columns = {c: part[c] for c in left} | {"n_bytes": size}
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(v, kinds[c]) for c, v in out.items()})
        tidy()

    left = [c for c in rows.columns if c not in ("row", "body")]
    fields = [*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in left), "n_bytes long, n_removed long, n_spans long, cut binary"]
    some, others = by_likely(rows, "row", spans)
    changed = some.join(spans, "row", "left").mapInArrow(remove, ", ".join(fields)).withColumnRenamed("cut", "body")
    zero = F.lit(0).cast("long")
    same = others.select(*left, F.octet_length("body").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("body").cast("binary").alias("body"))
    return changed.unionByName(same)
