"""Byte-pair merges of many words at once, for words of Latin letters."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from dwell.llm.common import offsets

#: The longest word in bytes, words merged at once, and the value of a pair that no merge joins.
LONGEST, _AT_ONCE, _NEVER = 32, 4096, 1 << 30
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8
_LETTERS = bytes(range(ord("a"), ord("z") + 1))
_TRAILS = bytes(range(0x80, 0xC0))
_PLAIN = np.isin(np.arange(256), [*_LETTERS, _LEAD, *_TRAILS])


def _byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """The merges of a byte-level model with word ends, of words of a-z and U+00C0 to U+00FF.

    As in the model, the pair of the lowest rank is joined first, the leftmost of equal ones, until no
    merge joins a pair. A step is taken by all words of one length together.
    """

    def __init__(self, model: dict):
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, joined = (np.array([vocabulary[x] for x in some], np.int64) for some in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.joined = joined.astype(np.int32)
        names = _byte_names()
        self.inner, self.last = np.full(256, -1, np.int32), np.full(256, -1, np.int32)
        for b in [*_LETTERS, _LEAD, *_TRAILS]:
            self.inner[b], self.last[b] = vocabulary[names[b]], vocabulary[names[b] + end]
        # open addressing: a pair lies at its hash or in the first free place behind it
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NEVER, np.int32)
        keys = left << 32 | right
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.pairs[at] < 0
            self.pairs[at[free]] = keys[todo[free]]
            self.ranks[at[free]] = todo[free] * LONGEST
            lost = self.pairs[at] != keys[todo]
            # of several that took one place the last one written has it, with its rank
            todo, at = todo[lost], at[lost] + 1 & self.mask

    @classmethod
    def of(cls, tokenizer) -> Merges | None:
        """The merges of a tokenizer, or None if it isn't one that splits, lowers and merges words as this class does."""
        spec = json.loads(tokenizer.to_str())
        model, normal, split = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        kinds = [n["type"] for n in normal.get("normalizers", [])]
        steps = split.get("pretokenizers", [])
        fits = (
            model["type"] == "BPE" and not model["dropout"] and not model["ignore_merges"] and not model["continuing_subword_prefix"] and model["end_of_word_suffix"]
            and kinds == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [s["type"] for s in steps] == ["Split", "ByteLevel"] and r"|[\p{L}]+|" in steps[0]["pattern"].get("Regex", "")
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        )
        return cls(model) if fits else None

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """LONGEST times the rank of the merge of each pair, or _NEVER."""
        keys = left.astype(np.int64) << 32 | right
        at = self._place(keys)
        held = self.pairs[at]
        out = np.where(held == keys, self.ranks[at], _NEVER)
        more = np.flatnonzero((held != keys) & (held >= 0))
        at = at[more]
        while len(more):
            at = at + 1 & self.mask
            held = self.pairs[at]
            same = held == keys[more]
            out[more[same]] = self.ranks[at[same]]
            on = ~same & (held >= 0)
            more, at = more[on], at[on]
        return out

    def _merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of each word's ids) of words of one length, a column each."""
        size, n = symbols.shape
        done, count, column = np.empty_like(symbols), np.empty(n, np.int64), np.arange(n)
        # a pair's value is its rank, then its place, so that the least one is the next to join
        value = np.empty((size - 1, n), np.int32)
        for j in range(size - 1):
            value[j] = self._rank(symbols[j], symbols[j + 1]) + j
        while True:
            least = value[: size - 1].min(axis=0) if size > 1 else np.full(len(column), _NEVER)
            on = least < _NEVER
            if not on.all():
                done[:size, column[~on]] = symbols[:size, ~on]
                count[column[~on]] = size
                symbols, value, column, least = symbols[:size, on], value[: size - 1, on], column[on], least[on]
            if not len(column):
                return done.T[np.arange(len(done)) < count[:, None]], count
            at = least % LONGEST
            symbols[at, np.arange(len(at))] = self.joined[least // LONGEST]
            # what is right of the joined pair moves up
            for j in range(1, size - 1):
                np.copyto(symbols[j], symbols[j + 1], where=at < j)
            for j in range(size - 2):
                np.copyto(value[j], value[j + 1] - 1, where=at <= j)
            size -= 1
            for some, shift in ((at > 0, 1), (at < size - 1, 0)):
                c = np.flatnonzero(some)
                q = at[c] - shift
                value[q, c] = self._rank(symbols[q, c], symbols[q + 1, c]) + q

    def fits(self, words: pa.Array) -> np.ndarray:
        """Which words this class can merge, of words of letters whose A-Z are lowered."""
        data, edges = _bytes(words)
        strange = np.concatenate([[0], np.cumsum(~_PLAIN[data])])
        size = np.diff(edges)
        return (strange[edges[1:]] == strange[edges[:-1]]) & (size > 0) & (size <= LONGEST)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each word, number of its ids) of words that fit; the ids lie by length of the words."""
        data, edges = _bytes(words)
        raised = (data >= 0x80) & (data < 0x9F)
        data = np.where(raised, data + 0x20, data)  # U+00C0 to U+00DE, as their second byte
        size = np.diff(edges)
        ids, starts, sizes, total = [np.empty(0, np.int32)], np.empty(len(size), np.int64), np.empty(len(size), np.int64), 0
        for length in np.unique(size).tolist():
            same = np.flatnonzero(size == length)
            for k in range(0, len(same), _AT_ONCE):
                rows = same[k : k + _AT_ONCE]
                letters = data[edges[rows] + np.arange(length)[:, None]]
                symbols = self.inner[letters]
                symbols[-1] = self.last[letters[-1]]
                found, count = self._merge(symbols)
                ends = np.cumsum(count)
                starts[rows], sizes[rows] = total + ends - count, count
                total += int(ends[-1])
                ids.append(found)
        return np.concatenate(ids).astype("<u4"), starts, sizes


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each word and the end)."""
    edges = offsets(words)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]] if len(words) else np.empty(0, np.uint8), edges - edges[0]
