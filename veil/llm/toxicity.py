"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, with marks at both ends, and the
word as a whole; each has a row of an embedding table by hash.  A document is
the average of the rows of its distinct words' bags and of ``padding`` zero
vectors, which every bag holds, and a linear softmax over two classes reads it.
Embeddings, zero at first, and softmax are trained together in numpy by
mini-batches with Adagrad; an n-gram that training never met stays zero.  A misspelling that was never seen shares most of its
n-grams, and so its vectors, with the word that was.

Since the softmax is linear, a trained model is one number for each table row:
a document's logit is that mean of its bags' numbers plus a bias.  Workers keep
the sums of the words that they have met.

Training reads a bounded sample of labelled rows (``Fit.toxic_rows`` and
``Fit.clean_rows`` of either class, the least by a hash of the key, weighted
back to the classes' shares; of rows with one key, one), each with its whole
text; scoring reads every document's whole text.  The parameters were chosen on a
part of the rows that labels may be learnt from.

Cases: null and empty texts have an empty bag and the bias alone as logit; a
repeated key is scored row by row; of clashing labels for one key the greater
holds, null labels none; without labelled rows of both classes every score is
the share of toxic ones (0 without any); an empty table gives no rows; only the
key and the text of documents are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm._shared import bounded_batches, kept, tidy
from veil.llm._text import LOWER, batches, chunks, mix, span_keys, words

#: Words whose sums a task keeps.
KEPT_WORDS = 200_000
#: Words whose n-grams are made together.
RUN = 1 << 12


@dataclass(frozen=True)
class Fit:
    toxic_rows: int = 2000
    clean_rows: int = 4000
    rows: int = 1 << 16
    width: int = 4
    #: Padding n-grams in every bag; their vector stays zero, so they draw short texts, of which little is known, to the bias.
    padding: int = 1000
    least: int = 3
    most: int = 6
    #: Mini-batches in all, at every size; small samples are passed over more often.
    steps: int = 1500
    batch: int = 32
    rate: float = 8.0
    seed: int = 11
    #: What a toxic row counts, beyond its class's share.
    toxic_weight: float = 4.0


def bags(data: np.ndarray, start: np.ndarray, end: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words' n-grams, word after word, and how many each word has."""
    size = end - start
    edge = np.concatenate([[0], np.cumsum(size + 2)])
    marked = np.empty(edge[-1], np.uint8)
    marked[edge[:-1]], marked[edge[1:] - 1] = 0x02, 0x03
    inside = np.ones(len(marked), bool)
    inside[edge[:-1]] = inside[edge[1:] - 1] = False
    step = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    marked[inside] = LOWER[data[step]]
    eight = chunks(marked)
    owner, keys = [np.arange(len(size))], [span_keys(eight, edge[:-1], edge[1:])]
    place = np.arange(len(marked))
    last = np.repeat(edge[1:], size + 2)
    word = np.repeat(np.arange(len(size)), size + 2)
    for n in range(fit.least, fit.most + 1):
        ok = (place + n <= last) & (n < np.repeat(size + 2, size + 2))
        owner.append(word[ok])
        keys.append(span_keys(eight, place[ok], place[ok] + n))
    owner, hashed = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return (hashed[order] % np.uint64(fit.rows)).astype(np.int64), np.bincount(owner, minlength=len(size))


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, key and text of each text's distinct words, letters A-Z taken as a-z."""
    start, end, text = words(data, offsets)
    if not len(start):
        return start, end, np.zeros(0, np.uint64), text
    key = span_keys(chunks(LOWER[data]), start, end)
    _, first = np.unique(mix(key ^ mix(text.astype(np.uint64))), return_index=True)
    first.sort()
    return start[first], end[first], key[first], text[first]


def _row_type(fit: Fit) -> np.dtype:
    return np.min_scalar_type(fit.rows - 1)


def counted(data: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """The table rows in the bag of one text's distinct words, all of them, and how often each is in it; both in the least type that holds them."""
    total = np.zeros(fit.rows, np.int64)
    start, end, _, _ = distinct_words(data, np.array([0, len(data)]))
    for at in range(0, len(start), RUN):
        total += np.bincount(bags(data, start[at : at + RUN], end[at : at + RUN], fit)[0], minlength=fit.rows)
    rows = np.flatnonzero(total)
    times = total[rows]
    return rows.astype(_row_type(fit)), times.astype(np.min_scalar_type(times.max(initial=0)))


def uncounted(rows: pa.Buffer, times: pa.Buffer, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Views of what ``counted`` gave, from its bytes."""
    kept = np.frombuffer(rows, _row_type(fit))
    return kept, np.frombuffer(times, f"u{len(times) // len(kept) if len(kept) else 1}")


@dataclass(frozen=True)
class Model:
    fit: Fit
    #: The softmax's margin of each embedding row, and its bias.
    margin: np.ndarray
    bias: float

    def score(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total / (n + self.fit.padding) + self.bias, -50, 50)))


def gradients(table: np.ndarray, softmax: np.ndarray, bias: np.ndarray, rows: np.ndarray, times: np.ndarray, size: np.ndarray, over: np.ndarray, labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the scaled cross-entropy of some documents: by table, softmax and bias.

    rows and times are those of all documents, one after another, ``size`` of them each; over: what a document's sum is divided by.
    """
    mean = np.stack([np.add.reduceat(one[rows] * times, np.cumsum(size) - size) for one in table], 1) / over[:, None]
    logit = mean @ softmax + bias
    chance = np.exp(logit - logit.max(1, keepdims=True))
    chance /= chance.sum(1, keepdims=True)
    chance[np.arange(len(size)), labels] -= 1
    error = chance * scale[:, None]
    back = (error @ softmax.T / over[:, None]).astype(table.dtype)
    up = np.stack([np.bincount(rows, np.repeat(back[:, j], size) * times, table.shape[1]) for j in range(len(table))])
    return up, mean.T @ error, error.sum(0)


def train(documents: list[tuple[np.ndarray, np.ndarray, int, float]], fit: Fit) -> Model:
    """From (distinct rows of the bag, how often each is in it, label, weight) of each document."""
    labels = np.array([label for _, _, label, _ in documents], np.int64)
    weights = np.array([w for _, _, _, w in documents], np.float64)
    bag_size = np.array([times.sum(dtype=np.int64) for _, times, _, _ in documents], np.int64)
    share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(fit, np.zeros(fit.rows), 50.0 if share else -50.0)
    rng = np.random.default_rng(fit.seed)
    table = np.zeros((fit.width, fit.rows), np.float32)
    softmax = (rng.random((fit.width, 2), np.float32) - 0.5) / fit.width
    bias = np.log([1 - share, share]).astype(np.float32)
    seen, seen_softmax, seen_bias = np.full(fit.rows, 1e-12, np.float32), np.full(softmax.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    scale = weights / weights.mean()
    epochs = max(1, round(fit.steps * fit.batch / len(documents)))
    for epoch in range(epochs):
        rate = fit.rate * (1 - epoch / epochs)
        order = rng.permutation(len(documents))
        for at in range(0, len(order), fit.batch):
            chosen = [i for i in order[at : at + fit.batch] if len(documents[i][0])]
            if not chosen:
                continue
            rows = np.concatenate([documents[i][0] for i in chosen])
            times = np.concatenate([documents[i][1] for i in chosen]).astype(np.float32)
            size = np.array([len(documents[i][0]) for i in chosen])
            over = bag_size[chosen] + fit.padding
            up, up_softmax, up_bias = gradients(table, softmax, bias, rows, times, size, over, labels[chosen], scale[chosen])
            seen_softmax += up_softmax**2
            seen_bias += up_bias**2
            seen += (up**2).mean(0)
            softmax -= (rate * 0.1 * up_softmax / np.sqrt(seen_softmax)).astype(np.float32)
            bias -= (rate * 0.1 * up_bias / np.sqrt(seen_bias)).astype(np.float32)
            table -= (rate * up / np.sqrt(seen)).astype(np.float32)
    direction = softmax[:, 1] - softmax[:, 0]
    return Model(fit, (direction @ table).astype(np.float64), float(bias[1] - bias[0]))


def trained(docs: DataFrame, labels: DataFrame, usable: Column, fit: Fit | None = None, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows for which usable, a condition on the labels' rows, holds."""
    fit = fit or Fit()
    bounded_batches(docs.sparkSession)
    marked = labels.where(usable & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = docs.select(F.col(key).cast("long").alias("doc_id")).distinct().join(marked, "doc_id")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in ((0, fit.clean_rows), (1, fit.toxic_rows))]
    sample = F.broadcast(parts[0].unionAll(parts[1]))

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        for batch in rows:
            for a, b, data, offsets in batches(batch.column(1), 1 << 18):
                pairs = [counted(data[i:j], fit) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                blobs = [pa.array([x[k].tobytes() for x in pairs], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *blobs], names=["doc_id", "label", "rows", "times"])
        tidy()

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(sample, "doc_id")
    chosen = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
    table = chosen.mapInArrow(read, "doc_id long, label int, rows binary, times binary").toArrow()
    ids, label_ = (table.column(i).to_pylist() for i in range(2))
    bags_ = [uncounted(r.as_buffer(), t.as_buffer(), fit) for r, t in zip(table.column(2), table.column(3), strict=True)]  # views of the table's own buffers
    taken = {y: sum(1 for x in label_ if x == y) for y in (0, 1)}
    order = sorted(range(len(ids)), key=lambda i: (ids[i], len(bags_[i][0]), zlib.crc32(bags_[i][1], zlib.crc32(bags_[i][0]))))
    return train([(*bags_[i], label_[i], counts[label_[i]] / taken[label_[i]] * (fit.toxic_weight if label_[i] else 1.0)) for i in order], fit)


def scored(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key, the kept columns and the score of every row, from its whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep) if c != text))
    taken = [rows.columns.index("text" if c == text else f"kept_{i}") for i, c in enumerate(keep)]  # the text travels once

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        model = shared.value
        known, total, size = pd.Index(np.zeros(0, np.uint64)), np.zeros(0), np.zeros(0, np.int64)
        for part in parts:
            for a, b, data, offsets in batches(part.column(1), 1 << 20):
                start, end, hashed, owner = distinct_words(data, offsets)
                unit, first, code = np.unique(hashed, return_index=True, return_inverse=True)
                if len(known) > KEPT_WORDS:
                    known, total, size = known[:0], total[:0], size[:0]
                at = known.get_indexer(unit)
                new = np.flatnonzero(at < 0)
                if len(new):
                    at[new] = len(total) + np.arange(len(new))
                    begin, stop = start[first[new]], end[first[new]]
                    for i in range(0, len(new), RUN):
                        got, n = bags(data, begin[i : i + RUN], stop[i : i + RUN], model.fit)
                        total, size = np.concatenate([total, np.add.reduceat(model.margin[got], np.cumsum(n) - n)]), np.concatenate([size, n])
                    known = known.append(pd.Index(unit[new]))
                at = at[code]
                score_ = model.score(np.bincount(owner, total[at], b - a), np.bincount(owner, size[at], b - a)) if len(at) else model.score(np.zeros(b - a), np.zeros(b - a))
                columns = [part.column(0).slice(a, b - a), *(part.column(i).slice(a, b - a) for i in taken), pa.array(score_)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"kept_{i}" for i in range(len(keep))), "score"])
        tidy()

    fields = ["doc_id long", *(f"kept_{i} {rows.schema[rows.columns[j]].dataType.simpleString()}" for i, j in enumerate(taken)), "score double"]
    return rows.mapInArrow(score, ", ".join(fields))


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model may learn labels from: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
