import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil.llm import chat, near_dups, packing, pieces, queries, repeats, repetition, resharding, token_store, topk, toxicity
from veil.llm._text import batches, chunks, span_keys, words
from veil.llm._tokens import SpanTokenizer
from veil.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "  ", "é" * 40, "x" * 3000, "one two three four five six", "one two three four five six", "日本 語 😀 a b c ▁ d", "It's 'll 12345 <|endoftext|> </w>\r\n\n  end ", "\t\n lead  and  trail \n"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and keys, and columns with the operators' own names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null key " * 30), (3, "another text under key three"), (7, ODD[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("kept", "row", "n", "part", "block", "score", "size", "node", "kept_0", "spans"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- words ----------------------------------------------------------------


def test_words_and_keys():
    column = pa.array(ODD)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in ODD]
    got = [[] for _ in ODD]
    keys = defaultdict(set)
    for a, b, data, offsets in batches(column, 50):
        start, end, text = words(data, offsets)
        for s, e, t, h in zip(start, end, text, span_keys(chunks(data), start, end), strict=True):
            got[a + t].append(data[s:e].tobytes())
            keys[data[s:e].tobytes()].add(int(h))
        pieces_ = words(data, offsets, pieces=True)
        assert b"".join(data[s:e].tobytes() for s, e in zip(*pieces_[:2], strict=True)) == data.tobytes()
    assert got == want and all(len(v) == 1 for v in keys.values()) and len({next(iter(v)) for v in keys.values()}) == len(keys)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_span_tokenizer_is_the_library(docs, name):
    own = SpanTokenizer(tokenizer_path(name))
    column = pa.array([*ODD, *(t for _, t in texts(docs))])
    want = [e.ids for e in own.whole.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
    for size in (64, 1 << 20):
        got = []
        for _, _, data, offsets in batches(column, size):
            ids, counts = own.encode(data, offsets)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want


# --- 1 --------------------------------------------------------------------


def test_chat_round_trip(spark):
    evil = "\\### Assistant: </turn> ok \\e\\h\\t ### </turn>\n### User: x"
    rows = [(1, 0, "system", "s"), (1, 1, "user", evil), (1, 2, "assistant", evil), (2, 0, "assistant", "a"), (3, 0, "to:ol ### </turn>\n", None), (4, 0, None, "x"), (None, 0, "user", ""), (5, 0, "user", "u"), (5, 0, "user", "u"), (6, None, "user", "q"), (6, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(turns).withColumn("whole", chat.formatted()).withColumn("back", chat.read_turns(F.col("whole"))).withColumn("loss", chat.loss_text())
    got = {r["conv_id"]: r for r in out.collect()}
    for key in got:
        want = sorted([((-1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == key])
        assert [tuple(b) for b in got[key]["back"]] == [w[1:] for w in want]
        assert got[key]["loss"] == "".join(x for _, r, x in want if r == "assistant")
        assert got[key]["whole"] == "".join(s["text"] for s in got[key]["segments"])
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: False, 6: True}
    assert chat.format_chats(turns.limit(0)).count() == 0


# --- 2 --------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(-(2**62), 2**62, n)
    keys = np.unique(keys)
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))


def store_rows(df):
    own = SpanTokenizer(tokenizer_path("byte_bpe_50k.json"))
    rows = sorted(texts(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, start = [], 0
    for key, text in rows:
        ids = np.array(own.whole.encode(text, add_special_tokens=False).ids + [2], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_store(spark, docs, odd, empty):
    for df in (docs, odd):
        store = token_store.write_store(df, tokenizer_path("byte_bpe_50k.json"), 2)
        got = [tuple(r) for r in token_store.read_digests(spark, store, df).collect()]
        order = lambda r: (r[0] is not None, r[0] or 0, r[1])
        assert sorted(got, key=order) == sorted(store_rows(df), key=order)
    assert len(store.get(3)) == 2 and len(store.get(7)) == 2 and store.get(10**9) == []
    reader = token_store.ShardReader(store.shards[0].uri)
    assert (reader.find(np.arange(1000, 5000))["rows"] == 0).all() and all(reader.locate(k) is None for k in range(1000, 1200))
    assert token_store.read_digests(spark, token_store.write_store(empty, tokenizer_path("byte_bpe_50k.json"), 2), empty).count() == 0


def test_store_access_reads_the_same_at_any_size(tmp_path):
    """Bytes read for a key don't grow with the file, and the fingerprints alone turn foreign keys away."""
    most = {}
    for n in (100, 20_000):
        out = token_store.ShardWriter(f"file://{tmp_path}/{n}.ids", 2)
        keys = np.arange(n) * 7
        out.add(pa.array(keys), np.repeat(np.arange(n) % 60_000, 3), np.full(n, 3))
        out.close()
        reader = token_store.ShardReader(f"file://{tmp_path}/{n}.ids")
        reads = []
        for key in keys[:: n // 100].tolist():
            before, entry = reader.read, reader.locate(key)
            assert reader.ids(int(entry["begin"]), int(entry["end"])).tolist() == [key // 7 % 60_000] * 3
            reads.append(reader.read - before)
        most[n] = max(reads)
        assert all(reader.locate(k) is None for k in range(1, 700, 7))
    assert most[20_000] <= 32 + 6 + 16 * 12 and np.median(reads) <= 32 + 6 + 16 * 2


# --- 3 --------------------------------------------------------------------


def test_best_two_fit_keeps_every_piece():
    rng = np.random.default_rng(3)
    for size in (1, 50, 3000):
        histogram = Counter(np.minimum(rng.geometric(0.01, size), 256).tolist())
        plan = packing.best_two_fit(histogram, 256)
        used = Counter()
        for times, lengths in plan:
            assert sum(lengths) <= 256
            used.update({k: v * times for k, v in Counter(lengths).items()})
        assert used == histogram
        least = max(-(-sum(k * v for k, v in histogram.items()) // 256), sum(v for k, v in histogram.items() if k > 128))
        assert sum(t for t, _ in plan) <= least * 1.02 + 1
    assert packing.best_two_fit({6: 1, 4: 1, 3: 2, 1: 1}, 10)[0][1] in ([6, 4], [6, 3, 1])


def check_packed(rows, want, capacity):
    ends = defaultdict(list)
    got = {}
    for r in rows:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for spans in ends.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return len(ends)


def test_packing(spark, docs, odd, empty):
    path = tokenizer_path("word_bpe_49k.json")
    own = SpanTokenizer(path)
    for df, capacity in ((docs, 2048), (odd, 8)):
        want = defaultdict(list)
        total = 0
        for key, text in texts(df):
            ids = np.array(own.whole.encode(text, add_special_tokens=False).ids + [0], "<u4")
            total += len(ids)
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                want[key].append((piece, start, len(part), zlib.crc32(part.tobytes())))
        n = check_packed(packing.digests(packing.pack_documents(df, path, 0, capacity)).collect(), want, capacity)
        assert n <= -(-total // capacity) * 1.02 + 1
    assert packing.pack_documents(empty, path, 0, 2048).count() == 0


# --- 4 --------------------------------------------------------------------


def brute_top(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in ok:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 5) / 8).tolist()) for i in range(200)] + [(200 + i, [0.5] * 5) for i in range(60)]
    rows += [(300, None), (310, [1.0, None, 0.0, 0.0, 0.0]), (320, [float("nan")] * 5), (None, [1.0] * 5), (330, []), (340, [1.0, 2.0]), (350, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for block in (topk.BLOCK_BYTES, 2000):
        monkeypatch.setattr(topk, "BLOCK_BYTES", block)
        got = [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 5).collect()]
        assert sorted(got) == brute_top(rows, 5, 10)
        monkeypatch.setattr(topk, "WAVE", 2)
    large = [(i, [float(x) for x in rng.normal(0, 1e6, 3)]) for i in range(30)]
    got = topk.exact_top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 3).collect()
    assert sorted(map(tuple, got)) == brute_top(large, 3, 10)
    huge = [(i, [float(x) for x in rng.normal(0, 1, 3) * 10.0 ** int(rng.integers(0, 300))]) for i in range(40)] + [(51, [float("inf")] * 3)]
    got = topk.exact_top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 3).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in huge[:40]}
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    best = {q: sorted((-held(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:3] for q in whole if q % 10 == 0}
    assert sorted(map(tuple, got)) == [(q, r + 1, i, -s) for q in sorted(best) for r, (s, i) in enumerate(best[q])]
    assert topk.exact_top_k(df.limit(0), F.lit(True), 5).count() == 0


# --- 5 --------------------------------------------------------------------


def test_flow_is_least():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = {(int(s), int(c)): (int(n), int(n) * (c + 1)) for s, c, n in zip(rng.integers(0, 4, 6), rng.integers(0, 5, 6), rng.integers(1, 9, 6), strict=True)}
        blocks = {s * resharding._CLASS + c: v for (s, c), v in sizes.items()}
        total, shards = sum(n for n, _ in blocks.values()), 3
        transfers = resharding.solve(blocks, shards)
        count, moved = Counter(), 0
        for t in transfers:
            count[t.shard] += t.high - t.low
            n, size = blocks[t.block]
            moved += (t.high - t.low) * size / n if t.block // resharding._CLASS != t.shard else 0
        assert sum(count.values()) == total and max(count[i] for i in range(shards)) - min(count[i] for i in range(shards)) <= 1
        # what has to leave each shard, for the best choice of the shards with one more row
        rows = {i: sorted(size / n for b, (n, size) in blocks.items() if b // resharding._CLASS == i for _ in range(n)) for i in range(shards)}
        forced = sum(size for b, (n, size) in blocks.items() if b // resharding._CLASS >= shards)
        base, extra = divmod(total, shards)
        best = math.inf
        for chosen in range(1 << shards):
            if bin(chosen).count("1") == extra:
                best = min(best, forced + sum(sum(rows[i][: max(0, len(rows[i]) - base - (chosen >> i & 1))]) for i in range(shards)))
        assert moved == pytest.approx(best)


def test_reshard(spark, docs, odd, empty, tmp_path):
    for df in (docs.repartition(5), odd):
        old = F.when(F.col("doc_id") % 7 < 5, 0).otherwise(F.col("doc_id") % 50).cast("int")
        placed, transfers = resharding.reshard(df, old, 6, carry=("text",))
        rows = placed.collect()
        want = Counter((k, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts(df))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
        counts = [len(slots.get(i, ())) for i in range(6)]
        assert max(counts) - min(counts) <= 1
    path = f"file://{tmp_path}/shards"
    new = resharding.rewrite(placed, transfers, path, rows_a_file=2)
    back = spark.read.parquet(path).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in back} == {i: counts[i] for i in new}
    assert resharding.reshard(empty, F.lit(0), 4)[0].count() == 0


def test_capacities():
    blocks = {0 * resharding._CLASS + 10: (6, 60), 1 * resharding._CLASS + 20: (4, 400)}
    got = resharding.solve(blocks, 3, [3, 4, 5])
    assert {s: sum(t.high - t.low for t in got if t.shard == s) for s in range(3)} == {0: 3, 1: 4, 2: 3}
    assert sum((t.high - t.low) * (10 if t.block < resharding._CLASS else 100) for t in got if t.block // resharding._CLASS != t.shard) == 30
    for bad in ([1, 1, 1], [20, 20], [-1, 20, 20]):
        with pytest.raises(ValueError):
            resharding.solve(blocks, 3, bad)


def test_rewriting_again(spark, tmp_path):
    """A run that ends before the manifest changes nothing; versions that are no longer named can go."""
    path = f"file://{tmp_path}/shards"
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for old, shards in ((F.lit(0), 3), (F.col("doc_id") % 3, 5)):
        placed, transfers = resharding.reshard(df, old, shards)
        resharding.rewrite(placed, transfers, path)
    schema = placed.schema
    now = sorted(r["doc_id"] for r in resharding.read_shards(spark, path, schema).collect())
    assert now == list(range(30))
    placed.limit(5).write.partitionBy("shard").parquet(f"{path}/version=halfdone")
    assert sorted(r["doc_id"] for r in resharding.read_shards(spark, path, schema).collect()) == now
    assert resharding.tidied(path) >= 1 and sorted(r["doc_id"] for r in resharding.read_shards(spark, path, schema).collect()) == now


def test_reshard_query_reads_rewritten_files(spark, docs, odd, empty, monkeypatch):
    """The query's digests are those of the written shards (it was a plan alone once)."""
    paths, write = [], resharding.rewrite

    def recorded(placed, transfers, path):
        paths.append((path, write(placed, transfers, path), resharding.affected(transfers)))
        return paths[-1][1]

    monkeypatch.setattr(resharding, "rewrite", recorded)
    got = queries.op5_reshard(spark, SF)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got.collect()) == Counter((k, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts(docs))
    (path, new, _), = paths
    files = spark.read.parquet(path)
    assert {r["shard"] for r in files.select("shard").distinct().collect()} == set(new)
    assert set(got.inputFiles()) >= set(files.inputFiles())
    paths.clear()
    rows = resharding.rewritten(odd, F.when(F.col("doc_id") < 6, 0).otherwise(F.col("doc_id") % 2 + 1), 3).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in rows) == Counter((k, zlib.crc32(t.encode())) for k, t in texts(odd))
    four = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    old = F.when(F.col("doc_id") < 2, 0).when(F.col("doc_id") < 5, 1).when(F.col("doc_id") < 6, 2).otherwise(3)
    rows = resharding.rewritten(four, old, 4).collect()
    assert paths[-1][2] == {1, 2} and sorted(Counter(r["shard"] for r in rows).values()) == [2, 2, 2, 2]
    assert resharding.rewritten(four, F.col("doc_id") % 4, 4).count() == 8
    assert resharding.rewritten(empty, F.lit(0), 4).count() == 0


# --- 6 --------------------------------------------------------------------


def brute_repeats(rows, length):
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for key, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((key, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def planted(rng, n=60):
    shared = ["".join(rng.choice(list("abcd éß"), 90)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = ["".join(rng.choice(list("abcdefgh \n"), int(rng.integers(0, 80)))) for _ in range(3)]
        cut = [s[int(rng.integers(0, 30)) : int(rng.integers(60, 90))] for s in shared]
        text = parts[0] + cut[int(rng.integers(0, 4))] + parts[1] + (cut[int(rng.integers(0, 4))] if i % 3 else "") + parts[2]
        out.append((i, text if i % 11 else "ab" * 60))
    return out + [(100, None), (101, ""), (None, out[3][1]), (3, out[3][1]), (5, out[6][1])]


@pytest.mark.parametrize(("widest", "part"), [(4096, 1 << 22), (2, 50)])
def test_repeats(spark, odd, empty, widest, part):
    rows = planted(np.random.default_rng(6))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("low", F.lit(1)).repartition(4)
    rule = repeats.Repeats(length=30, gram=8, collection=7, widest=widest, part=part)
    for one in (df, odd):
        got = repeats.remove_repeats(one, rule).collect()
        want = brute_repeats([(k, t.encode()) for k, t in texts(one)], 30)
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["body"]).hexdigest()) for r in got) == want
    whole = repeats.remove_repeats(df, rule, whole_characters=True, keep=("low",)).collect()
    assert all(r["body"].decode() is not None and r["kept_0"] == 1 for r in whole)
    assert repeats.remove_repeats(empty, rule).count() == 0


def test_repeats_come_from_the_transform(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(97, 123, 60, dtype=np.uint8)
    bodies = [base, base[:50], rng.integers(97, 123, 60, dtype=np.uint8), base[10:]]
    args = np.zeros(4, np.int64), np.array([20, 20, 20, 10]), np.array([len(b) for b in bodies]), np.concatenate(bodies), 30
    hit = repeats.repeated_windows(*args)
    assert [h.nonzero()[0].tolist() for h in hit] == [list(range(31)), list(range(21)), [], list(range(21))]
    write = repeats._write
    monkeypatch.setattr(repeats, "_write", lambda spool, order, common, transform: write(spool, order, common, np.where((transform != repeats.ENDED) & (np.arange(len(order)) % 2 == 0), 7, transform)))
    assert repeats.repeated_windows(*args).sum() < hit.sum()


def test_equal_rows_are_linear(spark):
    rows = 10_000
    text = " ".join(f"word{i}" for i in range(150))
    df = spark.range(rows).select(F.lit(5).alias("doc_id"), F.lit(text).alias("text"))
    out = repeats.remove_repeats(df).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in out] == [(5, len(text), 1, rows)]


# --- 7 --------------------------------------------------------------------


def test_pieces_round_trip(spark, docs, odd, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    for df in (docs, odd):
        encoded = pieces.encode(df, path, seed=1)
        got = Counter((r["doc_id"], r["text"]) for r in pieces.decode(encoded, path).collect())
        assert got == Counter(texts(df))
        again = Counter((r["doc_id"], bytes(r["ids"])) for r in pieces.encode(df.repartition(2), path, seed=1).collect())
        assert again == Counter((r["doc_id"], bytes(r["ids"])) for r in encoded.collect())
        assert again != Counter((r["doc_id"], bytes(r["ids"])) for r in pieces.encode(df, path, seed=2).collect())
    assert pieces.encode(empty, path).count() == 0


def test_pieces_have_their_shares():
    model = pieces.Pieces(tokenizer_path("piece_bpe_32k.model"), 1.0)
    word = b"theon"
    ids = {n: i for i, n in enumerate(model.names) if n and np.isfinite(model.weight[i]) and i not in set(model.byte_ids.tolist())}
    whole = b" " + word

    def paths(at):
        if at == len(whole):
            yield (), 0.0
        for end in range(at + 1, len(whole) + 1):
            if whole[at:end] in ids:
                i = ids[whole[at:end]]
                for rest, weight in paths(end):
                    yield (i, *rest), weight + model.weight[i]

    every = dict(paths(0))
    total = sum(math.exp(w) for w in every.values())
    n = 20_000
    data, offsets = np.frombuffer(word * n, np.uint8), np.arange(n + 1) * len(word)
    out, counts = pieces.sample(model, data, offsets, np.arange(n), 3)
    seen = Counter(tuple(x.tolist()) for x in np.split(out, np.cumsum(counts)[:-1]))
    assert set(seen) <= set(every)
    for path, w in every.items():
        p = math.exp(w) / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


# --- 8 --------------------------------------------------------------------


def brute_repeat_lengths(w):
    out = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            n = 0
            while i != j and max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def test_longest_repeats():
    rng = np.random.default_rng(8)
    lists = [rng.integers(0, k, int(n)) for k, n in ((2, 40), (5, 60), (1, 17), (3, 1), (50, 80))]
    text = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    key = np.concatenate([x.astype(np.uint64) + np.uint64(1000 * i) for i, x in enumerate(lists)])
    assert repetition.longest_repeats(key, text).tolist() == [n for x in lists for n in brute_repeat_lengths(x.tolist())]


def test_quality(spark, docs, odd, empty):
    limits = repetition.Limits()
    for df in (docs, odd):
        rows = [(r["doc_id"], r) for r in repetition.quality(df, limits).collect()]
        want = defaultdict(list)
        for key, t in texts(df):
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            three = Counter(zip(w, w[1:], w[2:], strict=False))
            repeated = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
            want[key].append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed))
        got = defaultdict(list)
        for key, r in rows:
            got[key].append(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")))
            assert not (r["base_failed"] and r["kept"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert repetition.quality(empty).count() == 0
    rng = np.random.default_rng(1)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    passage = fresh(60)
    made = spark.createDataFrame([(1, fresh(300)), (2, f"{passage} {fresh(200)} {passage}"), (3, " ".join([fresh(8)] * 3 + [fresh(25)]))], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in repetition.quality(made).collect()} == {1: True, 2: False, 3: False}


# --- 9 --------------------------------------------------------------------


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    keys = [k for k, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and keys[i] is not None and keys[j] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, len(sets[i]), least.get(find(i)) if sets[i] and k is not None else k) for i, k in enumerate(keys))


def near_rows(rng):
    base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    out = []
    for i in range(40):  # a chain: neighbours are near, ends are not
        w = list(base)
        w[i % 60] = f"x{i}"
        w[(i + 1) % 60] = f"x{i + 1}" if i % 2 else w[(i + 1) % 60]
        out.append((500 - i, " ".join(w)))
    for i in range(12):
        out.append((600 + i, " ".join(base[:45] + [f"y{i}_{j}" for j in range(15)])))
    tiny = [(700, "a b c d e f g"), (701, "A B C d e f g"), (702, "a b c d e f h"), (703, "a b"), (704, "a  b"), (705, "b a"), (706, "Ä b"), (707, "ä b")]
    return out + tiny


def test_near_duplicates(spark, docs, odd, empty):
    rows = near_rows(np.random.default_rng(9))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for df, near in ((made, near_dups.Near()), (made, near_dups.Near(chunk=100, block=3, guests=2)), (odd.where("doc_id <> 3 or doc_id is null"), near_dups.Near()), (docs, near_dups.Near())):
        got = near_dups.near_duplicates(df, near).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(texts(df))
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dups.near_duplicates(odd).count() == odd.count()
    assert near_dups.near_duplicates(empty).count() == 0


def test_estimates():
    near = near_dups.Near()
    rng = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.75, 1.0):
        errors = []
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2))
            same = int(len(a) * 2 * share / (1 + share))
            b = np.concatenate([a[:same], np.unique(rng.integers(0, 2**63, len(a) - same, dtype=np.uint64) * np.uint64(2) + np.uint64(1))])
            regs = [near_dups.registers(np.zeros(len(x), np.int64), np.sort(x), 1, near) for x in (a, b)]
            planes = [near_dups.fold(r, near) for r in regs]
            found, error = near_dups.estimates(*planes, np.array([len(a)]), np.array([len(b)]), near)
            errors.append(float(found[0, 0]) - share)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.15 and 0.02 < error[0, 0] < 0.04


# --- 10 -------------------------------------------------------------------


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(10)
    bad = ["vileword", "nastyterm", "awfulslur"]
    rows, marks = [], []
    for i in range(900):
        w = [f"{a}{b}" for a, b in zip(rng.choice(["ta", "lo", "mi", "ren", "sof"], 40), rng.choice(["ka", "du", "pel", "o"], 40), strict=True)]
        toxic = int(i % 4 == 0)
        if toxic:
            term = bad[int(rng.integers(0, 3))]
            if i > 700:
                term += term[-1]  # never seen in training
            w[5] = w[20] = term
        rows.append((i, " ".join(w)))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels, ~toxicity.held_out() & (F.col("doc_id") <= 700), toxicity.Fit(steps=1000))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs.repartition(3), model).collect()}
    test = [(got[i], y) for i, y in marks if i > 700]
    right = sum((s >= 0.5) == bool(y) for s, y in test) / len(test)
    assert right > 0.9 and all(0 <= s <= 1 for s in got.values())
    again = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert all(abs(again[i] - got[i]) < 1e-9 for i in got)
    scored = toxicity.scored(odd, model, keep=("text", "kept")).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.scored(empty, model).count() == 0
    none = toxicity.trained(docs, labels.limit(0), F.lit(True))
    assert {r["score"] < 1e-9 for r in toxicity.scored(docs, none).collect()} == {True}


def test_training_has_its_steps_at_every_size(monkeypatch):
    """The budget of mini-batches holds for small samples too (passes were bounded once)."""
    fit, passes = toxicity.Fit(steps=120, rows=64), []
    rng = np.random.default_rng
    class Counted:
        def __init__(self, seed):
            self.inner = rng(seed)
        def random(self, *a):
            return self.inner.random(*a)
        def permutation(self, n):
            passes.append(n)
            return self.inner.permutation(n)
    monkeypatch.setattr(toxicity.np.random, "default_rng", Counted)
    for n in (32, 64, 960):
        passes.clear()
        toxicity.train([(np.array([i % 64]), np.ones(1, np.int64), i % 2, 1.0) for i in range(n)], fit)
        assert sum(math.ceil(x / fit.batch) for x in passes) == fit.steps


def test_training_reads_every_word(spark, monkeypatch):
    """No word of a sampled document is left out, however many it has (1,000 words by hash were read once)."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda documents, fit: seen.extend(documents))
    long = " ".join(f"word{i}" for i in range(40_000)) + " word1 Word2"
    docs = spark.createDataFrame([(1, long), (2, "one two one"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    for fit in (toxicity.Fit(), toxicity.Fit(rows=300), toxicity.Fit(rows=200)):
        seen.clear()
        toxicity.trained(docs, labels, F.lit(True), fit)
        for (rows, times, label, _), text in zip(seen, (long, "one two one", ""), strict=True):
            want = Counter()
            data = np.frombuffer(text.encode(), np.uint8)
            start, end, _, _ = toxicity.distinct_words(data, np.array([0, len(data)]))
            if len(start):
                want.update(toxicity.bags(data, start, end, fit)[0].tolist())
            assert dict(zip(rows.tolist(), times.tolist(), strict=True)) == want and label == (text is long)


def test_gradients():
    """Against finite differences of the loss."""
    rng = np.random.default_rng(3)
    table, softmax, bias = rng.normal(size=(3, 12)), rng.normal(size=(3, 2)), rng.normal(size=2)
    size, labels, scale = np.array([3, 1, 4]), np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    rows, times, over = rng.integers(0, 12, 8), rng.integers(1, 4, 8).astype(float), np.array([7.0, 3.0, 9.0])

    def loss():
        total, at = 0.0, 0
        for n, y, w, o in zip(size, labels, scale, over, strict=True):
            mean = sum(table[:, r] * t for r, t in zip(rows[at : at + n], times[at : at + n], strict=True)) / o
            logit = mean @ softmax + bias
            total += w * (np.log(np.exp(logit).sum()) - logit[y])
            at += n
        return total

    for one, got in zip((table, softmax, bias), toxicity.gradients(table, softmax, bias, rows, times, size, over, labels, scale), strict=True):
        for i in np.ndindex(one.shape):
            one[i] += 1e-6
            high = loss()
            one[i] -= 2e-6
            assert got[i] == pytest.approx((high - loss()) / 2e-6, abs=1e-6)
            one[i] += 1e-6


def plain_score(model, text):
    """A document's score from the definition, word by word."""
    total, n = 0.0, 0
    for word in {w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)}:
        marked = b"\x02" + word.encode() + b"\x03"
        grams = [marked] + [marked[i : i + k] for k in range(model.fit.least, model.fit.most + 1) if k < len(marked) for i in range(len(marked) - k + 1)]
        for gram in grams:
            eight = chunks(np.frombuffer(gram, np.uint8))
            total += model.margin[int(span_keys(eight, np.array([0]), np.array([len(gram)]))[0] % np.uint64(model.fit.rows))]
            n += 1
    return 1 / (1 + math.exp(-(total / (n + model.fit.padding) + model.bias)))


def test_scores_are_averages(spark, odd):
    fit = toxicity.Fit()
    model = toxicity.Model(fit, np.random.default_rng(5).normal(size=fit.rows) * 100, -0.5)
    got = Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.scored(odd, model).collect())
    assert got == Counter((k, round(plain_score(model, t), 9)) for k, t in texts(odd))


def test_one_row_of_a_key_is_learnt(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda documents, fit: seen.extend(documents))
    docs = spark.createDataFrame([(1, "same")] * 50 + [(1, "other"), (2, "x")], "doc_id long, text string")
    toxicity.trained(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), F.lit(True))
    assert len(seen) == 2


def test_held_out(spark):
    got = {r["id"]: r["h"] for r in spark.range(200).select("id", toxicity.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_schemas_of_empty_tables(spark, empty):
    assert isinstance(repetition.quality(empty).schema, T.StructType)
