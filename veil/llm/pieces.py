"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

A text's segmentations are the paths of a lattice: nodes are byte positions,
edges are pieces of the model's vocabulary.  Forward filtering adds up, node by
node, the weight of all paths that reach it; backward sampling starts at the end
and draws each piece in proportion to what stands before it, so a whole path has
its exact share of chance.  Draws are hashes of seed, row key and byte position:
a row has the same segmentation in any partition, batch or run.

No piece reaches across the start of a word (its space belongs to the piece) or
a byte that no piece holds, so spans between these cuts are sampled on their
own, and equal spans of a batch share one lattice.  A piece of rank r in the
model weighs (r + 2) ** -sharpness; its order is all that the model file, which
holds merges, tells of pieces.

A text gets the model's leading space.  Characters without a piece, and the
letter U+2581 that stands for spaces in piece names, are written as byte pieces.
Decoding joins the pieces' bytes and drops that space, so it gives back every
text as it was.

Cases: null and empty texts have no pieces and decode to the empty text; rows
with a null key draw as with key 0; repeated rows have one segmentation; an
empty table gives no rows; only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm._shared import bounded_batches, kept
from veil.llm._text import batches, chunks, mix, span_keys

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64((1 << 20) - 1)


class Pieces:
    """The pieces of a model file as bytes, by length and hash."""

    def __init__(self, path: str, sharpness: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        names: list[bytes] = []
        weight = np.full(count, -np.inf)
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(count):
            name = model.id_to_piece(i)
            score = model.get_score(i)
            if model.is_byte(i):
                names.append(bytes([int(name[3:5], 16)]))
                self.byte_ids[names[-1][0]] = i
                weight[i] = -sharpness * np.log(count + 2)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or score < -1e8:
                names.append(b"")
            else:
                names.append(name.replace("▁", " ").encode())
                weight[i] = -sharpness * np.log(2 - score)
        self.weight, self.names = weight, names
        self.size = np.fromiter(map(len, names), np.int64, count)
        self.begin = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(names), np.uint8)
        own = np.array([i for i in range(count) if np.isfinite(weight[i]) and i not in set(self.byte_ids.tolist())], np.int64)
        hashes = span_keys(chunks(self.body), self.begin[own], self.begin[own] + self.size[own])
        #: Flags by the last bits of hashes: most byte strings are told from pieces by these.
        self.near = np.zeros(1 << 20, bool)
        self.near[(hashes & _LAST).astype(np.int64)] = True
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.size[own]).tolist():
            of = self.size[own] == n
            order = np.argsort(hashes[of])
            self.by_size[n] = hashes[of][order], own[of][order]
        held = np.zeros(256, bool)
        held[self.body[np.repeat(np.isin(np.arange(count), own), self.size)]] = True
        #: Bytes that no piece holds stand alone; no piece holds a space but at its start.
        self.alone = ~held
        self.alone[0x80:] = False

    def edges(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, piece) of all edges inside the spans; end: the end of each byte's span."""
        eight = chunks(data)
        head = (data & 0xC0) != 0x80
        lead = np.flatnonzero(head)
        size = np.diff(np.append(lead, len(data)))
        single, one = np.zeros(len(data), bool), np.zeros(len(data), np.int64)
        one[lead] = size
        first, piece = [], []
        for n, (hashes, ids) in self.by_size.items():
            at = lead[lead + n <= end[lead]]
            got = span_keys(eight, at, at + n)
            maybe = np.flatnonzero(self.near[(got & _LAST).astype(np.int64)])
            at, got = at[maybe], got[maybe]
            place = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            hit = hashes[place] == got
            first.append(at[hit])
            piece.append(ids[place[hit]])
            if n <= 4:
                single[at[hit][one[at[hit]] == n]] = True
        lone = np.flatnonzero(np.repeat(~single[lead], size))
        return np.concatenate([*first, lone]), np.concatenate([*piece, self.byte_ids[data[lone]]])


def pieces_of(path: str, sharpness: float) -> Pieces:
    have = kept(f"pieces {path}")
    if sharpness not in have:
        have[sharpness] = Pieces(path, sharpness)
    return have[sharpness]


class Lattice:
    """The lattices of some spans; nodes are numbered byte + span, one more than bytes for each."""

    def __init__(self, pieces: Pieces, data: np.ndarray, size: np.ndarray) -> None:
        stop = np.cumsum(size)
        span = np.repeat(np.arange(len(size)), size)
        first, piece = pieces.edges(data, stop[span])
        self.start = stop - size + np.arange(len(size))
        self.end = self.start + size
        source = first + span[first]
        target = source + pieces.size[piece]
        order = np.argsort(target, kind="stable")
        source, target, piece = source[order], target[order], piece[order]
        level = target - self.start[span[first[order]]]
        short = level.astype(np.int16) if len(level) and level.max() < 1 << 15 else level
        by_level = np.argsort(short, kind="stable")
        reach = np.full(len(data) + len(size), -np.inf)
        reach[self.start] = 0
        own_source, own_target, own_weight = source[by_level], target[by_level], pieces.weight[piece[by_level]]
        value = np.empty(len(source))
        edge = np.flatnonzero(np.diff(level[by_level], prepend=-1))
        for low, high in zip(edge.tolist(), [*edge[1:].tolist(), len(level)], strict=True):
            part = reach[own_source[low:high]] + own_weight[low:high]
            to = own_target[low:high]
            group = np.flatnonzero(np.diff(to, prepend=-1))
            most = np.maximum.reduceat(part, group)
            most[~np.isfinite(most)] = 0
            many = np.diff(np.append(group, len(to)))
            with np.errstate(divide="ignore"):
                reach[to[group]] = most + np.log(np.add.reduceat(np.exp(part - np.repeat(most, many)), group))
            value[low:high] = part
        self.source, self.piece = source, piece
        whole = np.empty(len(source))
        whole[by_level] = value
        with np.errstate(invalid="ignore"):
            share = np.nan_to_num(np.exp(whole - reach[target]))
        group = np.flatnonzero(np.diff(target, prepend=-1))
        many = np.diff(np.append(group, len(target)))
        total = np.cumsum(share)
        within = np.minimum(total - np.repeat(total[group] - share[group], many), 1.0)
        within[group + many - 1] = 1.0
        self.mark = target + within

    def back(self, node: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The edge drawn at each node by a number in [0, 1)."""
        return np.searchsorted(self.mark, node + draw, "right")


def draws(key: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (mix(key + position.astype(np.uint64) * _STEP) >> np.uint64(11)) * 2.0**-53


def sample(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after another, and how many each text has."""
    n = len(offsets) - 1
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    cut = (data == 0x20) | pieces.alone[data]
    cut[1:] |= pieces.alone[data[:-1]]
    cut[offsets[:-1][filled]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    code, unit = pd.factorize(span_keys(chunks(data), start, end))
    first = np.full(len(unit), -1, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    size = (end - start)[first]
    step = np.repeat(start[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    lattice = Lattice(pieces, data[step], size)
    text = np.searchsorted(offsets, start, "right") - 1
    key = mix(keys.astype(np.uint64) ^ mix(np.array([seed], np.uint64)))[text]
    node, floor, place, base = lattice.end[code], lattice.start[code], end, offsets[text]
    out = np.full(len(data), -1, np.int32)
    while len(node):
        edge = lattice.back(node, draws(key, place - base))
        out[place - 1] = lattice.piece[edge]
        before = lattice.source[edge]
        place = place - (node - before)
        more = before > floor
        node, floor, place, base, key = before[more], floor[more], place[more], base[more], key[more]
    at = np.flatnonzero(out >= 0)
    edge = np.searchsorted(at, offsets)
    return out[at].astype(np.int64), np.diff(edge)


def encode(docs: DataFrame, model_path: str, *, seed: int = 0, sharpness: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces and ids (little-endian unsigned 32-bit) of one sampled segmentation of each row."""
    bounded_batches(docs.sparkSession)

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path, sharpness)
        for part in parts:
            keys = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in batches(part.column(1), 3 << 20):
                ids, count = sample(pieces, data, offsets, keys[a:b], seed)
                edge = np.concatenate([[0], np.cumsum(count * 4)]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(count), blob], names=["doc_id", "n_pieces", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(draw, "doc_id long, n_pieces long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows with text, the bytes of their pieces without the leading space."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path, 1.0)
        for part in parts:
            texts = []
            for blob in part["ids"]:
                ids = np.frombuffer(blob.as_buffer(), "<u4").astype(np.int64) if blob.is_valid else np.zeros(0, np.int64)
                size = pieces.size[ids]
                step = np.repeat(pieces.begin[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                texts.append(pieces.body[step].tobytes()[1:])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, "text"])

    return encoded.mapInArrow(join, f"{fields}, text string")
