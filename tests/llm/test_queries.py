"""The registered queries over whole test tables against plain computations, and texts made to defeat hashes."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import SF, brute_near, brute_repeats, brute_repeat_lengths, check_packed, store_rows, texts

import corpus_pipeline
from veil.llm import near_dups, pieces, queries, repeats, repetition, token_store, toxicity
from veil.llm._text import batches, chunks, span_keys, words
from veil.llm._tokens import SpanTokenizer
from veil.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def kinds(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_op2_query(spark, docs):
    got = queries.op2_token_store(spark, SF)
    assert kinds(got) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, got.collect())) == store_rows(docs)


def want_pieces(rows, capacity=2048):
    own, want, total = SpanTokenizer(tokenizer_path("word_bpe_49k.json")), defaultdict(list), 0
    for key, text in rows:
        ids = np.array(own.whole.encode(text, add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[key].append((piece, start, len(part), zlib.crc32(part.tobytes())))
    return want, total


def test_op3_query(spark, docs):
    got = queries.op3_best_fit_packing(spark, SF)
    assert {k: v for k, v in kinds(got).items() if k in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")} == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    want, total = want_pieces(texts(docs))
    assert check_packed(got.collect(), want, 2048) <= -(-total // 2048) * 1.02 + 1


def test_op5_query(spark, docs):
    got = queries.op5_reshard(spark, SF)
    assert {k: kinds(got)[k] for k in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")} == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = got.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((k, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts(docs))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[i]) for i in range(40)]
    assert set(slots) == set(range(40)) and max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_op7_query(spark, docs):
    got = queries.op7_sampled_pieces(spark, SF).collect()
    want = Counter((k, len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for k, t in texts(docs))
    assert Counter((r["doc_id"], r["n_bytes"], r["decoded_sha256"]) for r in got) == want
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op7_sampled_pieces(spark, SF).collect()))


def test_op10_query(spark, docs):
    got = queries.op10_toxicity(spark, SF)
    assert kinds(got) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in texts(docs))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_pipeline_query(spark, docs):
    """All five stages by plain means, but for the scores, which test_scores_are_averages holds."""
    model = toxicity.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out())
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    kept = [(k, t) for k, t in texts(docs) if score[k] < 0.5]
    limits = repetition.Limits()

    def good(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        longest, three = brute_repeat_lengths(w), Counter(zip(w, w[1:], w[2:], strict=False))
        if len(w) < limits.least_words or 100 * len({i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}) > limits.repeat_percent * len(w):
            return False
        covered = {i + j for i, n in enumerate(longest) if n >= limits.span_words for j in range(n)}
        return 100 * len(covered) <= limits.covered_percent * len(w) and max(longest) <= limits.longest_words

    kept = [(k, t) for k, t in kept if len(t) > 20_000 or good(t)]
    least = {k for (k, _, c) in brute_near(kept) if k == c}
    kept = [(k, t) for k, t in kept if k in least]
    cut = {k: r for k, r in ((r["doc_id"], r["body"]) for r in repeats.remove_repeats(spark.createDataFrame(kept, "doc_id long, text string"), whole_characters=True).collect())}
    plain = Counter((k, len(b)) for k, b in ((r[0], t.encode()) for r, t in ((r, dict(kept)[r[0]]) for r in brute_repeats([(k, t.encode()) for k, t in kept], 200))))
    assert set(k for k, _ in plain) == set(cut)
    want, total = want_pieces([(k, b.decode()) for k, b in cut.items()])
    rows = corpus_pipeline.run(spark, SF).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: [x[:3] for x in v] for k, v in want.items()}
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) * 1.02 + 1


# --- texts made to defeat polynomial hashes --------------------------------


def thue_morse(size):
    a, b = "a", "b"
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def twins():
    """Pairs of words that every polynomial modulo 2**64 takes as one."""
    return [w for size in (512, 1024, 2048, 4096) for w in thue_morse(size)]


def test_keys_of_twins(twins):
    data = np.frombuffer("".join(twins).encode(), np.uint8)
    end = np.cumsum([len(w) for w in twins])
    for lane in range(3):
        assert len(set(span_keys(chunks(data), end - [len(w) for w in twins], end, lane).tolist())) == len(twins)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_of_twins(twins, name):
    own = SpanTokenizer(tokenizer_path(name))
    for _, _, data, offsets in batches(pa.array([" ".join(twins), *twins])):
        ids, counts = own.encode(data, offsets)
    want = [e.ids for e in own.whole.encode_batch([" ".join(twins), *twins], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_operators_on_twins(spark, twins, tmp_path):
    rows = [*enumerate(twins), *((10 + i, f"one two three four five six {w} seven eight nine ten") for i, w in enumerate(twins)), (30, " ".join(twins)), (31, " ".join([*twins, *twins]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    path = tokenizer_path("piece_bpe_32k.model")
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(df, path, seed=3), path).collect()}
    assert back == dict(rows)
    got = {r["doc_id"]: r["longest_repeat"] for r in repetition.quality(df).collect()}
    assert got == {k: max(brute_repeat_lengths(t.split()), default=0) for k, t in rows}
    near = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(df).collect())
    assert near == brute_near(rows)
    cut = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["body"]).hexdigest()) for r in repeats.remove_repeats(df).collect())
    assert cut == brute_repeats([(k, t.encode()) for k, t in rows], 200)
    store = token_store.write_store(df, tokenizer_path("byte_bpe_50k.json"), 2)
    assert sorted(map(tuple, token_store.read_digests(spark, store, df).collect())) == store_rows(df)
    bags = {tuple(toxicity.counted(np.frombuffer(w.encode(), np.uint8), toxicity.Fit())[1].tolist()) for w in twins}
    assert len(bags) >= 4


# --- one very long text, ties, many equal rows ------------------------------


def test_long_texts(spark):
    """Ten megabytes in one text; words() alone tells what it should give."""
    unit = " ".join(f"w{i}" for i in range(120_000))
    text = (unit + "\n") * 12
    df = spark.createDataFrame([(1, text), (2, "short " * 60), (3, None)], "doc_id long, text string")
    data = np.frombuffer(text.encode(), np.uint8)
    count = len(words(data, np.array([0, len(data)]))[0])
    judged = {r["doc_id"]: r for r in repetition.quality(df).collect()}
    assert judged[1]["n_words"] == count and judged[1]["longest_repeat"] == count - 120_000 and judged[1]["n_dup_lines"] == 11 and not judged[1]["kept"]
    near = {r["doc_id"]: r["n_shingles"] for r in near_dups.near_duplicates(df).collect()}
    assert near[1] == 120_000 and near[2] == 1
    cut = {r["doc_id"]: r for r in repeats.remove_repeats(df).collect()}
    assert cut[1]["n_removed"] == len(text) and cut[1]["n_spans"] == 1
    fit = toxicity.Fit()
    model = toxicity.Model(fit, np.ones(fit.rows), 0.0)
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(df, model).collect())


def test_ties_in_the_pipeline(spark):
    """Of rows equal in key and text one stays, the same one however the rows are dealt."""
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, s, {"a": 1}) for s in ("b", "a", None, "c")] + [(6, text, "z", None), (None, text, "n", None), (None, text, "m", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, veil_row map<string,int>")
    for n in (1, 3, 7):
        got = corpus_pipeline.drop_near_duplicates(spark, df.repartition(n), SF)
        assert got.columns == df.columns
        assert sorted(((r["doc_id"], r["row"]) for r in got.collect()), key=str) == [(5, "a"), (None, "m")]
