"""Token ids of whole texts by the ``tokenizers`` library, word by word.

Both tokenizer files split texts into pre-tokens that never reach across the
cuts made here, so the ids of a text are the ids of its spans one after
another.  Each worker keeps the ids of the spans that it has met; only new ones
go to the library.  Spans of plain Latin letters, digits and signs go to the
library's BPE model as pre-tokens; all others go through the library's whole
encoder.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import regex

from veil.llm._shared import kept
from veil.llm._text import chunks, span_keys, sums, words

# The pre-token patterns that the two tokenizer files state.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Spans that every Unicode version reads alike and that normalisation leaves alone but for case.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7eÀ-ÿ]*")
LATIN = regex.compile(r"[ ]?[a-zA-ZÀ-ÖØ-öø-ÿ]+")

KEPT_SPANS = 500_000
KEPT_PRETOKENS = 200_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next free one from U+0100 on."""
    shown = {b for r in (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)) for b in r}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)}


class SpanTokenizer:
    """Ids of whole texts with a bounded store of span ids; ``lower``: the lower-case word kind, else the byte kind."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.lower = self.whole.normalizer is not None
        self.pattern = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN)
        self.shown = byte_alphabet()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.pretokens: dict[str, list[int]] = {}

    def _pretoken(self, text: str) -> list[int]:
        found = self.pretokens.get(text)
        if found is None:
            found = [x.id for x in self.model.tokenize(text.encode().decode("latin-1").translate(self.shown))]
            if len(self.pretokens) < KEPT_PRETOKENS:
                self.pretokens[text] = found
        return found

    def _new(self, spans: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(spans)
        rest = []
        for i, span in enumerate(spans):
            try:
                text = span.decode()
            except UnicodeDecodeError:
                text = span.decode("utf-8", "replace")
            if not PLAIN.fullmatch(text):
                rest.append((i, text))
            else:
                text = text.lower() if self.lower else text
                if LATIN.fullmatch(text):
                    out[i] = self._pretoken(text)
                else:
                    out[i] = [x for part in self.pattern.findall(text) for x in self._pretoken(part)]
        for at in range(0, len(rest), 256):
            part = rest[at : at + 256]
            for (i, _), found in zip(part, self.whole.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                out[i] = found.ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (32-bit), and the number of ids of each text."""
        n = len(offsets) - 1
        start, end, text = words(data, offsets, pieces=not self.lower)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        code, key = pd.factorize(span_keys(chunks(data), start, end))
        if len(self.keys) > KEPT_SPANS:
            self.clear()
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == key[at < len(self.keys)]
        new = np.flatnonzero(~known)
        if len(new):
            first = np.full(len(key), -1, np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            raw = data.tobytes()
            found = self._new([raw[start[i] : end[i]] for i in first[new].tolist()])
            count = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((x for f in found for x in f), np.uint32, int(count.sum()))
            slot = len(self.starts) + np.arange(len(new), dtype=np.int32)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(count) - count])
            self.lengths = np.concatenate([self.lengths, count.astype(np.int32)])
            self.ids = np.concatenate([self.ids, flat])
            order = np.argsort(key[new])
            place = np.searchsorted(self.keys, key[new][order])
            self.keys = np.insert(self.keys, place, key[new][order])
            self.slots = np.insert(self.slots, place, slot[order])
            at = np.searchsorted(self.keys, key)
        slot = self.slots[at][code]
        length = self.lengths[slot].astype(np.int64)
        total = int(length.sum())
        step = np.repeat(self.starts[slot] - (np.cumsum(length) - length), length)
        step += np.arange(total)
        return self.ids[step], sums(length, text, n)


def tokenizer(path: str) -> SpanTokenizer:
    """The worker's own tokenizer for this file."""
    have = kept(f"tokens {path}")
    if "tokenizer" not in have:
        have["tokenizer"] = SpanTokenizer(path)
    return have["tokenizer"]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text's, and where each text starts (one more at the end)."""
    edge = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts + 1, out=edge[1:])
    out = np.full(int(edge[-1]), end_id, np.uint32)
    inside = np.ones(len(out), bool)
    inside[edge[1:] - 1] = False
    out[inside] = ids
    return out, edge
