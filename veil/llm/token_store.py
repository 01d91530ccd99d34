"""Token ids of documents in shard files with a minimal perfect hash index.

``write_store`` encodes documents in ascending key order and writes one file per
range of keys.  A file holds the raw ids, the edges of its rows in them, and an
index: a minimal perfect hash over the file's keys (levels of bit vectors; a key
takes the first level in which no other key has its bit, and the rank of that bit
is its slot) with the rank of each 64-bit word beside the word, and by slot an
entry of 32 bytes: a 32-bit fingerprint of the key, its number of rows, its first
row, and where the first row's ids begin and end.  Keys themselves are not
stored: the fingerprint turns away foreign keys but for one in four thousand
million.

A lookup reads the same few pieces at any size of a file: its head, 16 bytes for
each level that it tries (two at most for nine keys of ten), 32 bytes of the
entry, and the ids.  The shard is found by bisection of the manifest.

Cases: null texts are empty texts (the end id alone); rows with one key stand
together, in order of their texts, under one slot; rows with a null key come
first and have no slot; an empty table gives a store without shards.  Only the
key and the text are read, so other columns may have any names.

Files are written to a name of the attempt and renamed, and a shard's content
depends on its rows only, so a task that is run again does no harm.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm._shared import bounded_batches, filesystem, partitions_of, shared_dir, tidy
from veil.llm._text import batches, mix
from veil.llm._tokens import tokenizer, with_end

MAGIC = b"IDSHARD2"
GAMMA = 2.0
#: What the index holds by slot.
ENTRY = np.dtype([("mark", "<u4"), ("rows", "<u4"), ("first", "<i8"), ("begin", "<i8"), ("end", "<i8")])


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        count = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(count) - count

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, parts = keys.astype(np.uint64), [], []
        while len(keys):
            size = (int(GAMMA * len(keys)) // 64 + 1) * 64
            at = cls._place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
            sizes.append(size)
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit (then it is none of the keys)."""
        keys = keys.astype(np.uint64)
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._place(keys[open_], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_, base = open_[~hit], base + size
            if not len(open_):
                break
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    def __init__(self, uri: str, width: int) -> None:
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.at = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.at)
        self.out.write(MAGIC)
        self.width, self.counts, self.keys, self.nulls = width, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Rows in key order; rows with null keys before all others."""
        self.nulls += keys.null_count
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.counts.append(counts)
        self.out.write(ids.astype(f"<u{self.width}").tobytes())

    def close(self) -> tuple[int, int, int]:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        first = self.nulls + np.flatnonzero(np.diff(keys[self.nulls :], prepend=keys[self.nulls] - 1 if len(keys) > self.nulls else 0))
        own = keys[first]
        hash_ = PerfectHash.build(own)
        slot = hash_.slots(own)
        edge = np.concatenate([[0], np.cumsum(counts)])
        entries = np.empty(len(own), ENTRY)
        entries["mark"][slot], entries["rows"][slot] = fingerprint(own), np.diff(np.append(first, len(keys)))
        entries["first"][slot], entries["begin"][slot], entries["end"][slot] = first, edge[first], edge[first + 1]
        ranked = np.stack([hash_.bits, hash_.before.astype(np.uint64)], 1)
        parts = {"edge": edge.astype("<i8"), "ranked": ranked.astype("<u8"), "entries": entries}
        begin = len(MAGIC) + int(edge[-1]) * self.width
        head = {"width": self.width, "nulls": self.nulls, "sizes": hash_.sizes, "parts": {}}
        for name, x in parts.items():
            head["parts"][name] = [begin, x.nbytes]
            begin += x.nbytes
            self.out.write(x.tobytes())
        text = json.dumps(head).encode()
        self.out.write(text + len(text).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.at, self.path)
        return len(keys), int(edge[-1]), self.nulls


class ShardReader:
    """Keyed access to one shard file; ``read`` counts the bytes that were read."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file, self.read = fs.open_input_file(path), 0
        size = self.file.size()
        tail = self._at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no shard file, or is cut off")
        n = int.from_bytes(tail[:8], "little")
        self.head = json.loads(self._at(n, size - 8 - len(MAGIC) - n))
        self.nulls, self.rows = self.head["nulls"], self.head["parts"]["edge"][1] // 8 - 1

    def _at(self, size: int, begin: int) -> bytes:
        self.read += size
        return self.file.read_at(size, begin)

    def _some(self, part: str, kind: np.dtype | str, first: int, n: int) -> np.ndarray:
        """n values of a part of the file from the first on."""
        width = np.dtype(kind).itemsize
        return np.frombuffer(self._at(n * width, self.head["parts"][part][0] + first * width), kind)

    def locate(self, key: int) -> np.void | None:
        """The entry of a key, by a few reads of fixed size; None for keys that the shard lacks."""
        keys, base = np.array([key], np.int64).view(np.uint64), 0
        for level, size in enumerate(self.head["sizes"]):
            at = base + int(PerfectHash._place(keys, level, size)[0])
            word, before = self._some("ranked", "<u8", 2 * (at >> 6), 2).tolist()
            if word >> (at & 63) & 1:
                entry = self._some("entries", ENTRY, before + (word & ((1 << (at & 63)) - 1)).bit_count(), 1)[0]
                return entry if entry["mark"] == fingerprint(keys)[0] else None
            base += size
        return None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entries of many keys, with the whole index in memory; rows is 0 for keys that the shard lacks."""
        ranked = self._some("ranked", "<u8", 0, self.head["parts"]["ranked"][1] // 8).reshape(-1, 2)
        entries = self._some("entries", ENTRY, 0, self.head["parts"]["entries"][1] // ENTRY.itemsize)
        slot = PerfectHash(self.head["sizes"], np.ascontiguousarray(ranked[:, 0])).slots(keys)
        out = np.zeros(len(keys), ENTRY)
        ok = slot >= 0
        ok[ok] = entries["mark"][slot[ok]] == fingerprint(keys[ok])
        out[ok] = entries[slot[ok]]
        return out

    def edges(self, row: int, rows: int = 1) -> np.ndarray:
        """Where the ids of some rows that follow each other begin, and where the last ones end."""
        return self._some("edge", "<i8", row, rows + 1)

    def ids(self, begin: int, end: int) -> np.ndarray:
        w = self.head["width"]
        return np.frombuffer(self._at((end - begin) * w, len(MAGIC) + begin * w), f"<u{w}").astype("<u4")

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Shard:
    number: int
    uri: str
    rows: int
    ids: int
    #: Ids of all shards before it.
    start: int
    least: int | None
    greatest: int | None
    #: Rows with a null key; they stand first.
    nulls: int = 0


@dataclass(frozen=True)
class Store:
    """What the manifest lists; one entry per shard file, in key order."""

    shards: tuple[Shard, ...]

    def keyed(self) -> tuple[list[int], list[Shard]]:
        """The shards that have keys, and the least key of each, ascending."""
        own = sorted((s for s in self.shards if s.least is not None), key=lambda s: s.least)
        return [s.least for s in own], own

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every row with this key (driver-side access)."""
        least, own = self.keyed()
        at = bisect_right(least, key) - 1
        if at < 0 or key > own[at].greatest:
            return []
        reader = ShardReader(own[at].uri)
        try:
            entry = reader.locate(key)
            if entry is None:
                return []
            if entry["rows"] == 1:
                return [reader.ids(int(entry["begin"]), int(entry["end"]))]
            edge = reader.edges(int(entry["first"]), int(entry["rows"])).tolist()
            return [reader.ids(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        finally:
            reader.close()


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, *, key: str = "doc_id", text: str = "text") -> Store:
    """Encodes and writes docs; returns the manifest, which is written beside the shards as well."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or shared_dir(spark, "ids")

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, ends = TaskContext.get().partitionId(), None, [None, None]
        encoder = tokenizer(tokenizer_path)
        width = 2 if max(encoder.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        uri = f"{path}/shard-{number:06d}.ids"
        for batch in rows:
            if not batch.num_rows:
                continue
            out = out or ShardWriter(uri, width)
            for a, b, data, offsets in batches(batch.column(1), 1 << 20):
                ids, counts = encoder.encode(data, offsets)
                ids, edge = with_end(ids, counts, end_id)
                out.add(batch.column(0).slice(a, b - a), ids, np.diff(edge))
            some = batch.column(0).drop_null()
            if len(some):
                ends = [some[0].as_py() if ends[0] is None else ends[0], some[-1].as_py()]
        if out:
            n, ids, nulls = out.close()
            yield pa.RecordBatch.from_pylist([{"number": number, "uri": uri, "rows": n, "ids": ids, "least": ends[0], "greatest": ends[1], "nulls": nulls}], schema=MANIFEST)
        tidy()

    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = keyed.repartitionByRange(partitions_of(keyed), "key").sortWithinPartitions("key", "text")
    found = sorted(ordered.mapInArrow(write, "number long, uri string, rows long, ids long, least long, greatest long, nulls long").collect(), key=lambda r: r["number"])
    start, shards = 0, []
    for r in found:
        shards.append(Shard(r["number"], r["uri"], r["rows"], r["ids"], start, r["least"], r["greatest"], r["nulls"]))
        start += r["ids"]
    store = Store(tuple(shards))
    fs, at = filesystem(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps([asdict(s) for s in shards]).encode())
    return store


MANIFEST = pa.schema([("number", pa.int64()), ("uri", pa.string()), ("rows", pa.int64()), ("ids", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64()), ("nulls", pa.int64())])


def open_store(path: str) -> Store:
    fs, at = filesystem(path)
    with fs.open_input_file(f"{at}/manifest.json") as f:
        return Store(tuple(Shard(**x) for x in json.loads(f.read())))


def read_digests(spark: SparkSession, store: Store, docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """For each row of the store whose key is among those of docs, found in the files by the index: doc_id, start, n_tokens, ids_crc32.

    A null key among them stands for all rows without a key.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not store.shards:
        return spark.createDataFrame([], schema)
    least, own = store.keyed()
    ends, without = np.array(least, np.int64), [s for s in store.shards if s.nulls]

    def rows_of(reader: ShardReader, shard: Shard, row: np.ndarray, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        """Rows of a shard, ascending."""
        for at in range(0, len(row), 1024):
            some = row[at : at + 1024]
            low, high = int(some[0]), int(some[-1])
            edge = reader.edges(low, high - low + 1)
            ids, begin, end = reader.ids(int(edge[0]), int(edge[-1])), edge[some - low], edge[some - low + 1]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((begin - edge[0]).tolist(), (end - edge[0]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([keys.slice(at, 1024), pa.array(shard.start + begin), pa.array(end - begin), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.column(0).null_count:
                for shard in without:
                    reader = ShardReader(shard.uri)
                    yield from rows_of(reader, shard, np.arange(shard.nulls), pa.nulls(shard.nulls, pa.int64()))
                    reader.close()
            keys = part.column(0).drop_null().to_numpy()
            at = np.searchsorted(ends, keys, "right") - 1
            for number in np.unique(at[at >= 0]).tolist():
                asked, shard = keys[at == number], own[number]
                reader = ShardReader(shard.uri)
                found = reader.find(asked)
                n = found["rows"].astype(np.int64)
                row = np.repeat(found["first"] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                order = np.argsort(row)
                yield from rows_of(reader, shard, row[order], pa.array(np.repeat(asked, n)[order]))
                reader.close()
        tidy()

    keys = docs.select(F.col(key).cast("long").alias("key")).distinct()
    return keys.repartitionByRange(len(store.shards), "key").sortWithinPartitions("key").mapInArrow(read, schema)
