"""Token ids of a public tokenizer, and exact length histograms."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwell.llm.common import batch, checkpointed, offsets, tidy
from dwell.llm.merges import Merges

#: Parts of words in each generation of a task's cache, and the longest part that is kept.
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
#: Bytes of text that are encoded at a time, words that are joined for the tokenizer and whose ids are laid out at once.
SLICE_BYTES, _JOINED, _LAID = 16 << 20, 4096, 1 << 18
#: Marks that end a word as a piece of their own; an apostrophe could start a contraction.
_MARKS = ".,;:!?%*#$&|)"


@lru_cache(2)
def _load(path: str):
    """One tokenizer for each file and worker, whether each id ends a word, and its merges if they can be taken at once."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    word_end = np.zeros(max(vocabulary.values()) + 1, bool)
    if end := tokenizer.model.end_of_word_suffix:
        word_end[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
    return tokenizer, word_end, Merges.of(tokenizer)


class WordEncoder:
    """Ids of whole texts of a tokenizer that never joins over ASCII white space, by distinct words.

    Words of a column are made distinct first. Letters and the marks after them are pieces of their own in
    any case, so a word is cut there and its parts are shared by words. Words of Latin letters are merged
    together (``Merges``); other parts that aren't cached are encoded as one text by the tokenizer. Two
    generations bound the cache, which lives as long as its task.
    """

    def __init__(self, path: str):
        self.tokenizer, self.word_end, self.merges = _load(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, parts: list[str]) -> list[bytes]:
        """The ids of words of letters, empty for those that aren't one piece; as one text they end at its word ends."""
        out: list[bytes] = []
        for at in range(0, len(parts), _JOINED):
            some = parts[at : at + _JOINED]
            raw = self._encode([" ".join(some)])[0]
            ends = 4 * (np.flatnonzero(self.word_end[np.frombuffer(raw, "<u4")]) + 1)
            if len(ends) == len(some):
                ends = ends.tolist()
                out += [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:
                ids = self._encode(some)
                out += [x if self.word_end[np.frombuffer(x, "<u4")].sum() == 1 else b"" for x in ids]
        return out

    def _known(self, parts: list[str], encode) -> list[bytes]:
        """The ids of distinct parts, those of ``encode`` for parts that no generation has."""
        out = list(map(self.new.get, parts))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            fresh = {parts[i]: self.old.get(parts[i]) for i in missing}
            unknown = [p for p, x in fresh.items() if x is None]
            fresh.update(zip(unknown, encode(unknown)))
            for i in missing:
                out[i] = fresh[parts[i]]
            fresh = {p: x for p, x in fresh.items() if len(p) <= CACHE_LENGTH}
            if len(self.new) + len(fresh) > CACHE_WORDS:
                self.old, self.new = self.new, {}
            if len(fresh) <= CACHE_WORDS:
                self.new.update(fresh)
        return out

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first of each word and the end) of distinct words."""
        core = pc.ascii_rtrim(words, characters=_MARKS)
        letters = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
        edges = offsets(words)
        size = np.diff(edges)
        tail = size - pc.binary_length(core).to_numpy(zero_copy_only=False)
        letters &= tail <= 8
        # the marks of a word as a number: its last bytes
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] is not None else np.zeros(1, np.uint8)
        number = np.zeros(len(words), np.int64)
        for k in range(1, 9):
            on = np.flatnonzero(letters & (tail >= k))
            number[on] = number[on] << 8 | data[edges[on + 1] - tail[on] + k - 1]
        whole = pc.ascii_lower(core.filter(pa.array(letters))).dictionary_encode()
        names = whole.dictionary
        fits = self.merges.fits(names) if self.merges else np.zeros(len(names), bool)
        merged, merged_at, merged_size = self.merges.encode(names.filter(pa.array(fits))) if fits.any() else (np.empty(0, "<u4"), *np.empty((2, 0), np.int64))
        cores = self._known(names.filter(pa.array(~fits)).to_pylist(), self._encode_letters)
        known = np.empty(len(names), np.int64)  # the part of each name, merged ones after the others
        known[~fits] = np.where(np.fromiter(map(bool, cores), bool, len(cores)), np.arange(len(cores)), -1)
        known[fits] = len(cores) + np.arange(len(merged_at))
        at = np.full(len(words), -1, np.int64)  # the part that a word starts with
        at[letters] = known[whole.indices.to_numpy()]
        n_cores = len(names)
        rest = np.flatnonzero((at < 0) & (size > 0))
        odd = self._known([" " + w for w in words.take(pa.array(rest)).to_pylist()], self._encode)
        at[rest] = n_cores + np.arange(len(rest))
        ends, mark = np.unique(np.where(at < n_cores, number, 0), return_inverse=True)
        marks = self._known([" " + int(n).to_bytes(8, "big").lstrip(b"\0").decode() for n in ends], self._encode)
        more = [*odd, *marks, b""]
        sizes = [np.fromiter(map(len, some), np.int64, len(some)) // 4 for some in (cores, more)]
        ids = [np.frombuffer(b"".join(cores), "<u4"), merged, np.frombuffer(b"".join(more), "<u4")]
        laid = np.cumsum([0, *map(len, ids)])
        starts = np.concatenate([np.cumsum(sizes[0]) - sizes[0], laid[1] + merged_at, laid[2] + np.cumsum(sizes[1]) - sizes[1]])
        sizes, ids = np.concatenate([sizes[0], merged_size, sizes[1]]), np.concatenate(ids)
        at[at < 0] = len(sizes) - 1
        pair = np.stack([at, n_cores + len(odd) + mark], 1).ravel()
        return ids[spans(starts[pair], sizes[pair])], np.concatenate([[0], np.cumsum(sizes[pair])[1::2]])

    def encode_words(self, texts: pa.Array):
        """(ids of all texts as 32-bit numbers, first id of each text and the end, number of each word, first word of each text and the end, distinct words).

        Texts aren't null; an empty word may stand at their ends.
        """
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, bounds = self._table(words.dictionary)
        code, first = words.indices.to_numpy(), lists.offsets.to_numpy()
        first = first.astype(np.int64) - first[0]
        size = np.diff(bounds)[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        laid = np.empty(ends[-1], ids.dtype)
        for a in range(0, len(code), _LAID):
            b = min(a + _LAID, len(code))
            laid[ends[a] : ends[b]] = ids[spans(bounds[code[a:b]], size[a:b])]
        return laid, ends[first], code, first, words.dictionary

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as 32-bit numbers, first id of each text and the end); texts aren't null."""
        return self.encode_words(texts)[:2]

    def encode(self, text: bytes | None) -> bytes:
        """The ids of ``text`` (UTF-8) as little-endian unsigned 32-bit numbers."""
        return self.encode_column(pa.array([(text or b"").decode()], pa.string()))[0].tobytes()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of all elements of spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Runs of texts of about ``most`` bytes, null as empty, as (first row, column)."""
    column = column.fill_null("")
    ends = np.cumsum(np.diff(offsets(column)))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        yield at, column.slice(at, to - at)
        at = to


def length_histogram(documents: DataFrame, tokenizer: str, extra: int = 0) -> DataFrame:
    """(n_tokens, n_docs): how many documents encode to each length, ``extra`` ids added to each.

    Whole texts; null or empty text has no ids. Repeated rows count each; other columns are ignored; an
    empty table gives no rows. Batches are pre-aggregated, so only lengths are shuffled; the result,
    a row for each length, is materialised, as its readers use it more than once.
    """

    def run(batches):
        encode = WordEncoder(tokenizer).encode_column
        for b in batches:
            for _, texts in slices(b.column(0)):
                values, n = np.unique(np.diff(encode(texts)[1]) + extra, return_counts=True)
                yield batch(n_tokens=values, n_docs=n)

    sizes = documents.select("text").mapInArrow(tidy(run), "n_tokens long, n_docs long")
    return checkpointed(sizes.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def suffix_sums(histogram: DataFrame, stride: int = 1024) -> DataFrame:
    """The histogram with what every context limit asks for, one row for each length.

    docs_from, tokens_from: documents at least that long and their ids; docs_to: documents up to that
    long; truncated_tokens: ids left if each document is cut to that length; rank: docs_to as a share.
    Sums run within blocks of ``stride`` lengths after one small row for each block, so no task gets
    more than a block or the list of blocks.
    """
    sized = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("ids"), F.floor(F.col("n_tokens") / stride).alias("block"))
    blocks = sized.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("ids").alias("block_ids"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_ids").over(above), F.lit(0)).alias("ids_above"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_ids").over(whole).alias("all_ids"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = sized.join(carried, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_ids",
        (F.sum("n_docs").over(within) + F.col("docs_above")).alias("docs_from"),
        (F.sum("ids").over(within) + F.col("ids_above")).alias("tokens_from"),
    )
    docs_to = F.col("all_docs") - F.col("docs_from") + F.col("n_docs")
    return summed.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", docs_to.alias("docs_to"),
        (F.col("all_ids") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        (docs_to / F.col("all_docs")).alias("rank"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, total_tokens, truncated_tokens, docs_cut) for each of ``limits``, from suffix_sums alone."""
    asked = sums.sparkSession.createDataFrame([(c,) for c in sorted(set(limits))], "context long")
    total = sums.agg(F.coalesce(F.max("tokens_from"), F.lit(0)).alias("total_tokens"))
    over = F.broadcast(asked).join(sums, F.col("n_tokens") > F.col("context"), "left").groupBy("context").agg(
        F.coalesce(F.max("tokens_from"), F.lit(0)).alias("ids"), F.coalesce(F.max("docs_from"), F.lit(0)).alias("docs_cut"))
    return over.join(F.broadcast(total)).select("context", "total_tokens", (F.col("total_tokens") - F.col("ids") + F.col("context") * F.col("docs_cut")).alias("truncated_tokens"), "docs_cut")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least a ``share`` of the documents don't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(s),) for s in sorted(set(shares))], "share double")
    return F.broadcast(asked).join(sums, F.col("rank") >= F.col("share"), "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
