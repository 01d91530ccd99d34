"""Quality rules: repetition inside a document by suffix arrays of words.

The words of many texts are put into one array of keys, each mixed with its
text's number so that nothing is equal across texts, and sorted into one suffix
array by prefix doubling; a round goes on with the suffixes alone that still
share their rank.  Longest common prefixes of neighbours are compared word by word
only where they can't be told from the suffix a word earlier.  A suffix's deepest
LCP interval is the larger of its two neighbouring values: its longest prefix
that occurs elsewhere in the text.
Those that can't be extended to the left are the maximal repeats; their spans
are united, and a document is held against two limits, the part of its words
that the spans cover and the longest repeat.

Base measures that need no suffix array come from the same pass.

Memory is linear in a text, some 150 bytes a word, whatever repeats in it.

Cases: a null text has no words; a document without words fails the base rule;
rows are judged one by one, so repeated rows get the same verdict; an empty
table gives no rows; only the key and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm._shared import bounded_batches, kept, tidy
from veil.llm._text import SPACE, batches, chunks, mix, span_keys, sums, text_of, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    least_words: int = 50
    #: Percent of words in 3-word windows that occur twice or more.
    repeat_percent: int = 50
    #: Words from which on a repeat counts for the covered part.
    span_words: int = 6
    #: Percent of the words that such repeats may cover.
    covered_percent: int = 40
    #: The longest repeat that a document may hold, as words.
    longest_words: int = 50


def suffix_array(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The suffix array of key; equal keys must be of one text."""
    n = len(key)
    order = np.argsort(key, kind="stable").astype(np.int32 if n < 1 << 31 else np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, order.dtype)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=order.dtype), 0))
    h = 1
    while True:
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        place = np.flatnonzero(shared)
        if not len(place):
            return order
        own = order[place].astype(np.int64)
        after = np.minimum(own + h, n - 1)
        follow = np.where((own + h < n) & (text[after] == text[own]), rank[after] + 1, 0)
        sort = np.lexsort((follow, rank[own]))
        own, follow = own[sort], follow[sort]
        order[place] = own
        split = np.ones(len(own), bool)
        split[1:] = (rank[own[1:]] != rank[own[:-1]]) | (follow[1:] != follow[:-1])
        fresh[place] = split
        rank[own] = place[np.maximum.accumulate(np.where(split, np.arange(len(own)), 0))]
        h *= 2


def _extend(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are equal, one pair at a time next to each other; the first ones are known to be."""
    n, length, alive = len(key), np.ones(len(a), np.int64), np.arange(len(a))
    while len(alive) > 64:
        x, y = a[alive] + length[alive], b[alive] + length[alive]
        inside = np.maximum(x, y) < n
        alive, x, y = alive[inside], x[inside], y[inside]
        alive = alive[key[x] == key[y]]
        length[alive] += 1
    for i in alive.tolist():  # few and perhaps long: by growing runs
        x, y, run = int(a[i] + length[i]), int(b[i] + length[i]), 64
        while max(x, y) < n:
            run = min(run, n - max(x, y))
            differ = key[x : x + run] != key[y : y + run]
            if differ.any():
                x += int(differ.argmax())
                break
            x, y, run = x + run, y + run, run * 2
        length[i] = x - a[i]
    return length


def common_prefixes(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """LCP of each suffix of the array with the one before it (0 for the first), in memory linear in the words.

    Where the words before a suffix and its neighbour are equal too, the LCP is one less than that of the suffix a word earlier; only the others are compared word by word, and their LCPs sum up to n log n at most.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    same = before >= 0
    same[same] = key[before[same]] == key[np.flatnonzero(same)]
    at = np.flatnonzero(same)
    other = before[at]
    apart = (at == 0) | (other == 0)
    apart[~apart] = key[at[~apart] - 1] != key[other[~apart] - 1]
    length = np.zeros(n, np.int64)
    length[at[apart]] = _extend(key, at[apart], other[apart])
    start = np.zeros(n, np.int64)
    start[at[apart]] = at[apart]
    start = np.maximum.accumulate(start)
    follows = at[~apart]
    length[follows] = length[start[follows]] - (follows - start[follows])
    return length[order]


def longest_repeats(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest string of words from it on that starts elsewhere in its text too."""
    order = suffix_array(key, text)
    lcp = common_prefixes(order, key)
    deepest = lcp.copy()
    deepest[:-1] = np.maximum(deepest[:-1], lcp[1:])
    out = np.empty(len(key), np.int64)
    out[order] = deepest
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Words that the maximal repeats of at least so many words cover."""
    n = len(length)
    begins = length >= least
    begins[1:] &= length[1:] != length[:-1] - 1  # else the repeat goes on to the left
    depth = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(begins)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + length[start], -1)
    return np.cumsum(depth)[:n] > 0


def measures(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    if not len(data):
        return dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"), np.zeros(n, np.int64))
    start, end, text = words(data, offsets)
    eight = chunks(data)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    length = longest_repeats(span_keys(eight, start, end) ^ salt[text], text)
    breaks = data == 0x0A
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first[1:] |= breaks
    begin = np.flatnonzero(first[:-1])
    stop = np.append(begin[1:], len(data))
    stop = stop - breaks[stop - 1]
    lines = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop = begin[lines], stop[lines]
    owner = text_of(begin, offsets)
    _, once = np.unique(span_keys(eight, begin, stop) ^ salt[owner], return_index=True)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, length)
    return {
        "n_words": sums(np.ones(len(start), np.int64), text, n),
        "word_chars": count(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": count(SYMBOLS[data]),
        "n_dup_lines": np.bincount(owner, minlength=n) - np.bincount(owner[once], minlength=n),
        "n_repeat_words": sums(covered(length, 3), text, n),
        "covered_words": sums(covered(length, limits.span_words), text, n),
        "longest_repeat": longest,
    }


def quality(docs: DataFrame, limits: Limits | None = None, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key, the kept columns, the measures, base_failed and kept, a row for each row."""
    limits = limits or Limits()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep) if c != text))
    taken = [rows.columns.index("text" if c == text else f"kept_{i}") for i, c in enumerate(keep)]  # the text travels once

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("quality")
        for part in parts:
            for a, b, data, offsets in batches(part.column(1), 1 << 20):
                m = measures(data, offsets, limits)
                m["base_failed"] = (m["n_words"] < limits.least_words) | (100 * m["n_repeat_words"] > limits.repeat_percent * m["n_words"])
                m["kept"] = ~m["base_failed"] & (100 * m["covered_words"] <= limits.covered_percent * m["n_words"]) & (m["longest_repeat"] <= limits.longest_words)
                columns = {"doc_id": part.column(0).slice(a, b - a)} | {f"kept_{i}": part.column(j).slice(a, b - a) for i, j in enumerate(taken)}
                yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v) for k, v in m.items()})
        tidy()

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
    fields = ["doc_id long", *(f"kept_{i} {rows.schema[rows.columns[j]].dataType.simpleString()}" for i, j in enumerate(taken)), *(f"{c} long" for c in names), "base_failed boolean", "kept boolean"]
    return rows.mapInArrow(judge, ", ".join(fields))
