"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import batch

ORDERS = (1, 2, 3)
#: More distinct labels than this are refused: the model's size must stay bounded.
MAX_LANGUAGES = 256
#: Characters scored at a time, divided by the number of languages.
SLICE = 1 << 22


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (2**bits, languages)
    bits: int


@lru_cache(1)
def _letter_table() -> np.ndarray:
    """Whether each code point is a letter (surrogates are not)."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of hashed n-grams: (bucket of each, first of each text, letters of each text)."""
    lowered = [(t or "").lower() + "\n" for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[np.minimum(codes, 0x10FFFF)]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    before, after = np.zeros_like(codes), np.zeros_like(codes)
    before[1:], after[:-1] = codes[:-1], codes[1:]
    middle = np.flatnonzero(letter)
    c = codes[middle]
    a, z = before[middle], after[middle]
    hashed = {1: c, 2: (c << np.uint64(21) | z) + np.uint64(1 << 62), 3: (a << np.uint64(42) | c << np.uint64(21) | z) ^ np.uint64(3 << 62)}
    keys = np.stack([hashed[n] for n in ORDERS], 1)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(32)
    keys *= np.uint64(0xD6E8FEB86659FD93)
    letters = np.add.reduceat(letter, starts, dtype=np.int64) if len(starts) else np.empty(0, np.int64)
    return (keys >> np.uint64(64 - bits)).astype(np.int64).ravel(), (np.cumsum(letters) - letters) * len(ORDERS), letters


#: A cut is moved on to white space up to so many characters away, else to any character that isn't a letter.
_REACH = 1 << 16
_GAP, _BREAK = re.compile(r"\s"), re.compile(r"[\W\d_]")


def _slices(texts: list[str | None], most: int):
    """Runs of texts of about ``most`` characters; a longer text comes in pieces, marked by its number.

    Pieces end before a character that isn't a letter, so no n-gram of letters lies across a border and
    the pieces have the n-grams of the whole text, whatever ``most`` is.
    """
    run, size = [], 0
    for i, t in enumerate(texts):
        t = t or ""
        at = 0
        while True:
            to = at + most
            if to < len(t):
                found = _GAP.search(t, to, to + _REACH) or _BREAK.search(t, to)
                to = found.start() if found else len(t)
            run.append((i, t[at:to]))
            size += min(to, len(t)) - at
            at = to
            if size >= most:
                yield run
                run, size = [], 0
            if at >= len(t):
                break
    if run:
        yield run


def score(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(log posterior up to a constant, letters) of each text."""
    total = np.tile(model.log_prior, (len(texts), 1))
    letters = np.zeros(len(texts), np.int64)
    for run in _slices(texts, max(1 << 12, SLICE // max(4, len(model.languages)))):
        at = np.array([i for i, _ in run])
        keys, starts, n = grams([t for _, t in run], model.bits)
        some = np.flatnonzero(n)
        if len(some):
            np.add.at(total, at[some], np.add.reduceat(model.log_prob[keys], starts[some], axis=0, dtype=np.float64))
        np.add.at(letters, at, n)
    return total, letters


def held_out() -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, per_language: int = 2000, bits: int = 16, smoothing: float = 0.5) -> LanguageModel:
    """Fit on about ``per_language`` documents of each non-null lang at most, whole texts.

    The sample is drawn by a hash of doc_id, so it's the same in every run. Class priors are the shares
    of all labelled documents. Rows without text, lang or doc_id are left out. More than MAX_LANGUAGES
    distinct labels are an error, as the model's size must stay bounded.
    """
    labelled = documents.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = sorted((r["lang"], r["count"]) for r in counts)
    names = tuple(n for n, _ in counts)
    if not names:
        return LanguageModel((), np.empty(0), np.empty((1 << bits, 0)), bits)
    spark = documents.sparkSession
    shares = spark.createDataFrame([(n, i, min(1.0, per_language / k)) for i, (n, k) in enumerate(counts)], "lang string, at int, share double")
    sample = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("at", "text").repartition(4)

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            by: dict[int, list[str]] = {}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(i, []).append(t)
            for i, texts in by.items():
                for run in _slices(texts, 1 << 20):
                    sums[i] = sums.get(i, 0) + np.bincount(grams([t for _, t in run], bits)[0], minlength=1 << bits)
        for i, s in sums.items():
            yield batch(at=pa.array([i], pa.int32()), sums=[s.astype("<i8").tobytes()])

    total = np.full((len(names), 1 << bits), smoothing)
    for row in sample.mapInArrow(count, "at int, sums binary").toLocalIterator():
        total[row["at"]] += np.frombuffer(row["sums"], "<i8")
    prior = np.array([k for _, k in counts], float)
    log_prob = np.log(total / total.sum(axis=1, keepdims=True)).T
    return LanguageModel(names, np.log(prior / prior.sum()), np.ascontiguousarray(log_prob, np.float32), bits)


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score), one row for each row of ``documents`` (doc_id, text).

    lang_pred is the learned language of the largest posterior over the whole text (the first by name
    of equal ones), score that posterior. Null or empty text, text without a letter, or a model of no
    language: ``und`` with score 0. Other columns are ignored; repeated rows get equal results.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            if not model.languages:
                yield batch(doc_id=b.column(0), lang_pred=["und"] * len(texts), score=np.zeros(len(texts)))
                continue
            total, letters = score(texts, model)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            known = letters > 0
            names = [model.languages[i] if k else "und" for i, k in zip(best.tolist(), known.tolist())]
            yield batch(doc_id=b.column(0), lang_pred=pa.array(names, pa.string()), score=np.where(known, np.clip(share, 0, 1), 0.0))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
