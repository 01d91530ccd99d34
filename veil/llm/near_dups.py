"""Near duplicates by HyperMinHash registers, banding and exact checks.

A document is the set of its word shingles.  Documents with one set are one
node; a set's name has 128 bits.  A shingle's hash picks one of ``registers``
buckets by its first bits; a bucket's least remaining hash is kept as its count
of leading zeros and ``mantissa`` bits after them, 16 bits in all.  For banding,
an empty register takes the value of the first filled one in an order of its
own.  Nodes that agree on a band's registers share a bucket.

Inside buckets, nodes are compared by folded registers: 4 bits each, hashed from
the 16, as bit planes.  The Jaccard estimate is corrected for registers that
agree by chance, after folding or before, and a pair is likely if its estimate
is at least the limit less ``errors`` standard errors.  Likely pairs aren't
written out.  Two rounds bring nodes together for exact checks:

1. A node proposes one partner, the likely one of its block that has most likely
   partners itself, so that a group's nodes gather around few; of the proposals
   of its buckets the most frequent counts.  Links make first components.
2. In buckets that hold several components, a node with a likely partner in
   another component is a guest of the chunk of that component (some hundred
   thousand shingles of its members) that holds the partner; of two components,
   the larger is host.  A guest's set meets all sets of the chunk at once, through
   an index of their shingles, and one link is enough.  Rows are guests times
   chunks, not pairs, and a chunk's set travels once for many guests.

A link is a pair of which 100 * intersection >= percent * union on full sets.
Components come from large-star and small-star rounds over the components so far
and the new links.

A link at the very threshold shares no bucket with a chance of about
(1 - 0.75**4)**36 = 1e-6, less for closer ones, and has an estimate five standard
errors low with a chance of 3e-7.

Cases: null, empty and blank texts have the empty set and are linked with
nothing; texts of fewer words than a shingle are one shingle; equal texts and
repeated rows share a node; rows with a null key are linked with nothing, kept,
and have no component; an empty table gives no rows; only the key and the text
are read, so other columns may have any names.  Keys are whole numbers; other
types are cast, and what is no number counts as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm._shared import Scratch, bounded_batches, by_likely, kept, release, row_name, tidy
from veil.llm._text import LOWER, batches, chunks, mix, span_keys, sums, words


@dataclass(frozen=True)
class Near:
    shingle: int = 5
    percent: int = 75
    #: A multiple of 64.
    registers: int = 256
    mantissa: int = 10
    bands: int = 36
    band: int = 4
    errors: float = 5.0
    #: Nodes of a bucket that are compared together, shingles of a host chunk, and guests that meet it in one task.
    block: int = 2048
    chunk: int = 1 << 18
    guests: int = 4096


_STEP = 0xD6E8FEB86659FD93
_FOLD = 4


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted."""
    data = LOWER[data]
    start, end, text = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = span_keys(chunks(data), start, end)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    at = np.arange(len(key)) - first[text]
    have = np.minimum(count, size)[text]
    begins = at + have <= count[text]
    begins &= (count[text] >= size) | (at == 0)
    place = np.flatnonzero(begins)
    got = have[place].astype(np.uint64)
    for j in range(size):
        inside = j < have[place]
        got = np.where(inside, (got ^ key[np.minimum(place + j, len(key) - 1)]) * np.uint64(_STEP) + np.uint64(j + 1), got)
        got ^= got >> np.uint64(29)
    got, owner = mix(got), text[place]
    order = np.lexsort((got, owner))
    got, owner = got[order], owner[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], got[new]


def names_of(owner: np.ndarray, got: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each text's set, as two numbers."""
    many = np.bincount(owner, minlength=n).astype(np.uint64)
    one = lambda key: mix(sums(mix(got ^ np.uint64(key)).view(np.int64), owner, n).view(np.uint64) ^ many).view(np.int64)
    return one(0xA5A5A5A55A5A5A5A), one(0x3C6EF372FE94F82B)


def registers(owner: np.ndarray, got: np.ndarray, n: int, near: Near) -> np.ndarray:
    """n x registers of leading zeros and mantissa of each bucket's least hash; 0 where the bucket is empty."""
    bits = near.registers.bit_length() - 1
    bucket = (got >> np.uint64(64 - bits)).astype(np.int64)
    least = np.ones(len(got), bool)
    least[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    rest = (got[least] << np.uint64(bits)) | np.uint64(1)
    zeros = np.zeros(len(rest), np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        low = rest >> np.uint64(64 - step) == 0
        zeros[low] += np.uint64(step)
        rest[low] <<= np.uint64(step)
    after = (rest << np.uint64(1)) >> np.uint64(64 - near.mantissa)
    out = np.zeros((n, near.registers), np.uint16)
    out[owner[least], bucket[least]] = ((zeros + np.uint64(1)) << np.uint64(near.mantissa) | after).astype(np.uint16)
    return out


@cache
def _orders(registers: int, columns: int) -> np.ndarray:
    """For each column the order in which an empty register looks for a filled one."""
    return np.stack([np.random.Generator(np.random.PCG64(7_000 + i)).permutation(registers) for i in range(columns)])


def filled(raw: np.ndarray, near: Near) -> np.ndarray:
    """Registers with empty ones filled from others of the same row; rows without any stay empty."""
    out, k = raw.copy(), near.registers
    orders = _orders(k, near.bands * near.band)
    row, column = np.nonzero((raw[:, : near.bands * near.band] == 0) & raw.any(1)[:, None])
    for step in range(k):
        if not len(row):
            break
        value = raw[row, orders[column, step]]
        out[row, column] = value
        row, column = row[value == 0], column[value == 0]
    return out


def band_keys(raw: np.ndarray, near: Near) -> np.ndarray:
    """rows x bands of 64-bit bucket names."""
    whole = filled(raw, near)[:, : near.bands * near.band].reshape(len(raw), near.bands, near.band).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, near.bands + 1, dtype=np.uint64), whole.shape[:2]).copy()
    for j in range(near.band):
        key = mix(key * np.uint64(_STEP) + whole[:, :, j])
    return key.view(np.int64)


def chance_agreement(n: np.ndarray, m: np.ndarray, near: Near) -> np.ndarray:
    """The chance that one register of two disjoint sets of n and m shingles agrees."""
    a, b = np.asarray(n, float) / near.registers, np.asarray(m, float) / near.registers
    total = np.zeros(np.broadcast(a, b).shape)
    for zeros in range(1, 64 - near.registers.bit_length() + 2):
        low = 2.0**-zeros
        total += (np.exp(-(a + b) * low) - np.exp(-(a + b) * 2 * low)) * low
    return a * b / (a + b) * total * 2.0**-near.mantissa


@cache
def _chances(near: Near) -> np.ndarray:
    """The chance that folded registers of two different minima agree, by the logarithms of the sets' sizes."""
    size = 2.0 ** np.arange(40)
    own = chance_agreement(size[:, None], size[None, :], near)
    return own + (1 - own) / 2**_FOLD


def fold(raw: np.ndarray, near: Near) -> np.ndarray:
    """Bit planes of the registers' folded values, and of which are filled, as rows of 64-bit words."""
    small = (raw * np.uint16(0x9E37)) >> np.uint16(16 - _FOLD)
    planes = [np.packbits((small >> np.uint16(b) & np.uint16(1)).astype(np.uint8), axis=1) for b in range(_FOLD)]
    return np.ascontiguousarray(np.concatenate([*planes, np.packbits(raw != 0, axis=1)], 1)).view("<u8")


def estimates(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of all rows x with all rows y of folded registers, and the standard error of one at the limit."""
    w = near.registers // 64
    same, both, either = (np.zeros((len(x), len(y)), np.int16) for _ in range(3))
    for k in range(w):
        filled = x[:, None, _FOLD * w + k] & y[None, :, _FOLD * w + k]
        both += np.bitwise_count(filled)
        either += np.bitwise_count(x[:, None, _FOLD * w + k] | y[None, :, _FOLD * w + k])
        differ = x[:, None, k] ^ y[None, :, k]
        for b in range(1, _FOLD):
            differ |= x[:, None, b * w + k] ^ y[None, :, b * w + k]
        same += np.bitwise_count(filled & ~differ)
    size = lambda a: np.log2(np.maximum(a, 1)).astype(np.int64)
    chance = _chances(near)[size(n)[:, None], size(m)[None, :]]
    either = np.maximum(either, 1)
    limit = near.percent / 100 + (1 - near.percent / 100) * chance
    return np.maximum(0.0, (same - chance * both) / ((1 - chance) * either)), np.sqrt(limit * (1 - limit) / either) / (1 - chance)


def likely(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, near: Near) -> np.ndarray:
    """Which rows x may be links of which rows y, by the estimates and by the sets' sizes."""
    out = np.empty((len(x), len(y)), bool)
    step = max(1, (1 << 18) // max(1, len(y)))
    for at in range(0, len(x), step):
        own = slice(at, at + step)
        found, error = estimates(x[own], y, n[own], m, near)
        few, many = np.minimum(n[own][:, None], m[None, :]), np.maximum(n[own][:, None], m[None, :])
        out[own] = (found >= near.percent / 100 - near.errors * error) & (100 * few >= near.percent * many)
    return out


def signatures(docs: DataFrame, near: Near, key: str, text: str) -> DataFrame:
    """row (128 bits of key and text), doc_id, n, high and low (the set's name), registers of each row."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near")
        for part in parts:
            for a, b, data, offsets in batches(part.column(1), 1 << 20):
                owner, got = shingles(data, offsets, near.shingle)
                raw = registers(owner, got, b - a, near)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2).slice(a, b - a), part.column(0).slice(a, b - a), pa.array(np.bincount(owner, minlength=b - a)), *map(pa.array, names_of(owner, got, b - a)), _binary(raw.tobytes(), np.full(b - a, raw.shape[1] * 2))],
                    names=["row", "doc_id", "n", "high", "low", "registers"],
                )
        tidy()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), row_name(F.col(key), F.col(text)).alias("row"))
    return rows.mapInArrow(sign, "row binary, doc_id long, n long, high long, low long, registers binary")


def _binary(body: bytes, size: np.ndarray) -> pa.Array:
    edge = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(body)]).cast(pa.binary())


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Values of fixed size as rows of a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(whole.to_pylist()), kind).reshape(-1, width)


def full_sets(docs: DataFrame, nodes: DataFrame, near: Near, key: str, text: str) -> DataFrame:
    """(node, members): the full sets of nodes (node, doc_id, high, low), from their documents' whole texts."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    rows = by_likely(texts, "doc_id", nodes.select("doc_id"))[0].join(nodes.select("node", "doc_id", "high", "low"), "doc_id").select("text", "node", "high", "low")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near")
        for part in parts:
            for a, b, data, offsets in batches(part.column(0), 1 << 20):
                owner, got = shingles(data, offsets, near.shingle)
                high, low = names_of(owner, got, b - a)  # a key may have other texts too
                own = (high == part.column(2).slice(a, b - a).to_numpy()) & (low == part.column(3).slice(a, b - a).to_numpy())
                out = [part.column(1).slice(a, b - a), _binary(got.astype("<u8").tobytes(), np.bincount(owner, minlength=b - a) * 8)]
                yield pa.RecordBatch.from_arrays(out, names=["node", "members"]).filter(pa.array(own))
        tidy()

    return rows.mapInArrow(sets, "node long, members binary").dropDuplicates(["node"])


def _groups(parts: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows with equal numbers in the columns ``by``, and whether each begins a group; a group may come in several runs."""
    last = None
    for part in parts:
        if not part.num_rows:
            continue
        keys = np.stack([part[c].to_numpy() for c in by])
        edge = np.append(np.flatnonzero((np.diff(keys, prepend=keys[:, :1] - 1) != 0).any(0)), part.num_rows)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            now = tuple(keys[:, a])
            yield now != last, part.slice(a, b - a)
            last = now


def _tables(parts: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Whole groups, one after another."""
    held: list[pa.RecordBatch] = []
    for fresh, run in _groups(parts, by):
        if fresh and held:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(run)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def proposals(buckets: DataFrame, planes: DataFrame, near: Near) -> DataFrame:
    """(node, hub) for each node and bucket where it has a likely partner in its block: the one of most likely partners, or the node itself."""
    width = (_FOLD + 1) * near.registers // 64
    rows = buckets.join(planes, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / near.block)))
    dealt = rows.select("bucket", "block", "node", "n", "planes").repartition("bucket", "block").sortWithinPartitions("bucket", "block")

    def star(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near")
        for table in _tables(parts, ("bucket", "block")):
            if table.num_rows < 2:
                continue
            order = np.argsort(table["node"].to_numpy())
            node, n = table["node"].to_numpy()[order], table["n"].to_numpy()[order]
            own = _matrix(table["planes"], "<u8", width)[order]
            may = likely(own, own, n, n, near)
            np.fill_diagonal(may, False)
            degree = may.sum(1)
            np.fill_diagonal(may, True)
            hub = np.empty(len(node), np.int64)
            for at in range(0, len(node), 256):
                hub[at : at + 256] = np.where(may[at : at + 256], degree, -1).argmax(1)
            some = degree > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[hub[some]])], names=["node", "hub"])
        tidy()

    return dealt.mapInArrow(star, "node long, hub long")


def visits(buckets: DataFrame, planes: DataFrame, homes: DataFrame, near: Near) -> DataFrame:
    """(guest, component, chunk): guests with a likely partner in a chunk of another component.

    homes: node, component, members, chunk.
    """
    width = (_FOLD + 1) * near.registers // 64
    placed = buckets.select("bucket", "node").join(homes, "node")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many")).where("low <> high")
    rows = placed.join(mixed.select("bucket", F.ceil(F.col("many") / near.block).alias("blocks")), "bucket").join(planes, "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = rows.select("bucket", "i", "j", "own", "node", "component", "members", "chunk", "n", "planes").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near")
        for table in _tables(parts, ("bucket", "i", "j")):
            node, component, members, chunk, n, own = (table[c].to_numpy() for c in ("node", "component", "members", "chunk", "n", "own"))
            planes_ = _matrix(table["planes"], "<u8", width)
            left, right = np.flatnonzero(own == table["i"][0].as_py()), np.flatnonzero(own == table["j"][0].as_py())
            found: list[np.ndarray] = []
            for at in range(0, len(left), 256):
                a = left[at : at + 256]
                may = likely(planes_[a], planes_[right], n[a], n[right], near) & (component[a][:, None] != component[right][None, :])
                x, y = np.nonzero(may)
                x, y = a[x], right[y]
                hosted = (members[y] > members[x]) | ((members[y] == members[x]) & (component[y] < component[x]))
                guest, host = np.where(hosted, x, y), np.where(hosted, y, x)
                if len(guest):
                    found.append(np.unique(np.stack([node[guest], component[host], chunk[host]], 1), axis=0))
            if found:
                every = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(every[:, i])) for i in range(3)], names=["guest", "component", "chunk"])
        tidy()

    return dealt.mapInArrow(compare, "guest long, component long, chunk long").distinct()


def met(guests: DataFrame, hosts: DataFrame, sets: DataFrame, near: Near, scratch: Scratch) -> DataFrame:
    """(hub, node): of each guest (guest, component, chunk) and chunk, one link to a host (node, component, chunk) if there is any."""
    where = ["component", "chunk"]
    parts_of = guests.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / near.guests).alias("parts"))
    parts_of = scratch.table(parts_of, "chunks")
    come = guests.join(parts_of, where).select(*where, F.pmod(F.xxhash64("guest"), F.col("parts")).alias("part"), F.lit(1).alias("side"), F.col("guest").alias("node"))
    stay = hosts.join(parts_of, where).select(*where, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "node")
    roles = come.unionByName(stay).join(sets, "node")
    by = ("component", "chunk", "part")
    dealt = roles.select(*by, "side", "node", "members").repartition(*by).sortWithinPartitions(*by, "side", "node")

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near")
        hosts_: list[tuple[int, np.ndarray]] = []
        own_none = np.zeros(0, np.uint64)
        index: tuple[np.ndarray, ...] = ()
        for fresh, run in _groups(parts, by):
            if fresh:
                hosts_, index = [], ()
            side = run["side"].to_numpy()
            first = int(np.searchsorted(side, 1))
            for node, blob in zip(run["node"].slice(0, first).to_pylist(), run["members"].slice(0, first), strict=True):
                hosts_.append((node, np.frombuffer(blob.as_buffer(), "<u8").copy()))
            if first == run.num_rows or not hosts_:
                continue
            if not index:
                size = np.array([len(x) for _, x in hosts_])
                key = np.concatenate([x for _, x in hosts_])
                owner = np.repeat(np.arange(len(hosts_), dtype=np.int32), size)
                order = np.argsort(key, kind="stable")
                index = key[order], owner[order], size, np.array([k for k, _ in hosts_])
                hosts_ = [(0, own_none)]
            key, owner, size, name = index
            found: tuple[list[int], list[int]] = ([], [])
            for node, blob in zip(run["node"].slice(first).to_pylist(), run["members"].slice(first), strict=True):
                own = np.frombuffer(blob.as_buffer(), "<u8")
                low = np.searchsorted(key, own, "left")
                many = np.searchsorted(key, own, "right") - low
                at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
                both = np.bincount(owner[at], minlength=len(size))
                link = (100 * both >= near.percent * (size + len(own) - both)) & (name != node)
                if link.any():
                    found[0].append(int(name[link.argmax()]))
                    found[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["hub", "node"])
        tidy()

    return dealt.mapInArrow(check, "hub long, node long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes that have links; component is the least node of its kind."""
    edges = scratch.table(links.select(F.greatest("hub", "node").alias("a"), F.least("hub", "node").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.table(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = scratch.table(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select("b", F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, near: Near | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest key that links reach), kept, and row (128 bits of key and text, see ``row_name``), a row for each row."""
    near, spark = near or Near(), docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "near")
    signed = scratch.table(signatures(docs, near, key, text), "signatures")
    named = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("high", "low").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = scratch.table(named.withColumn("node", F.monotonically_increasing_id()), "nodes")
    release(spark)

    def bands(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near")
        for part in parts:
            if part.num_rows:
                keys = band_keys(_matrix(part["registers"], "<u2", near.registers), near)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part["node"].to_numpy(), near.bands))], names=["bucket", "node"])
        tidy()

    def folded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("near")
        for part in parts:
            if part.num_rows:
                body = fold(_matrix(part["registers"], "<u2", near.registers), near)
                yield pa.RecordBatch.from_arrays([part["node"], part["n"], _binary(body.tobytes(), np.full(len(body), body.shape[1] * 8))], names=["node", "n", "planes"])
        tidy()

    def in_use(members: DataFrame) -> DataFrame:
        """(bucket, many, node) of buckets of two nodes or more."""
        return members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "bucket").select("bucket", "many", "node")

    every = scratch.table(nodes.select("node", "registers").mapInArrow(bands, "bucket long, node long"), "bands")
    buckets = scratch.table(in_use(every), "buckets")
    scratch.drop(every)
    planes = scratch.table(nodes.select("node", "n", "registers").mapInArrow(folded, "node long, n long, planes binary"), "planes")
    release(spark)
    offers = scratch.table(proposals(buckets, planes, near).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times")), "offers")
    release(spark)
    # a bucket of several blocks was not compared whole
    live = offers.select("node").unionAll(buckets.where(F.col("many") > near.block).select("node")).distinct()
    live = scratch.table(nodes.select("node", "doc_id", "high", "low", "n").join(live, "node"), "live")
    sets = scratch.table(full_sets(docs, live, near, key, text), "sets")
    release(spark)
    best = offers.groupBy("node").agg(F.max(F.struct("times", (-F.col("hub")).alias("hub"))).alias("best")).select("node", (-F.col("best.hub")).alias("hub")).where("hub <> node")
    best = scratch.table(best.select(F.col("node").alias("guest"), F.col("hub").alias("component"), F.lit(0).cast("long").alias("chunk")), "best")
    hubs = best.select("component").distinct().select(F.col("component").alias("node"), "component", F.lit(0).cast("long").alias("chunk"))
    links = scratch.table(met(best, hubs, sets, near, scratch), "links")
    release(spark)
    known = components(links, scratch) if not links.isEmpty() else spark.createDataFrame([], "node long, component long")
    whole = live.select("node", "n").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = scratch.table(whole, "first")
    sizes = whole.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.sum("n") / near.chunk).alias("chunks"))
    homes = whole.join(sizes, "component").select("node", "component", "members", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"))
    homes = scratch.table(homes, "homes")
    guests = scratch.table(visits(buckets, planes, homes, near), "visits")
    release(spark)
    if not guests.isEmpty():
        more = scratch.table(met(guests, homes.select("node", "component", "chunk"), sets, near, scratch), "links")
        if not more.isEmpty():
            known = components(more.unionAll(known.where("node <> component").select(F.col("component").alias("hub"), "node")), scratch)
    least = known.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = known.join(least, "component").select("node", "component_id")
    named = nodes.select("node", "high", "low", "doc_id").join(final, "node", "left").select("high", "low", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = scratch.table(named, "names")
    scratch.drop(buckets, planes, offers, live, sets, best, links, whole, homes, guests)
    release(spark)
    has = F.expr("n > 0 AND doc_id IS NOT NULL")
    out = signed.select("row", "doc_id", "n", F.when(has, F.col("high")).alias("high"), F.when(has, F.col("low")).alias("low")).join(named, ["high", "low"], "left")
    found = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"), "row")
