"""I-Match document fingerprints over a band of inverse document frequency."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import batch, pack_sorted, unpack_sorted, utf8

#: Randomised subsets of the lexicon: SUBSETS for each share 1/8, 1/16 ... 1/1024 of its terms, so
#: that short and long texts both have many subsets with one or two of their terms.
SUBSETS, SHARES = 8, (3, 4, 5, 6, 7, 8, 9, 10)
#: A subset is drawn from all terms of a text if fewer of them than this share are in the lexicon. The
#: shares differ, so that two near copies fall on different sides of few.
FEW = tuple(1 / 8 + (j * len(SHARES) + r) / (8 * SUBSETS * len(SHARES)) for r in range(len(SHARES)) for j in range(SUBSETS))
#: Places of a fingerprint that are filled at least, so that those of very short texts have 64 bits.
LEAST = 4
_FLUSH, _CACHE = 400_000, 300_000
_EDGES = b".,;:!?\"'()[]{}<>|*#$%&"
_FIRST = -(1 << 63)


def terms(text: bytes) -> set[bytes]:
    """Distinct words, ASCII lower case, without punctuation at their ends."""
    return {w.strip(_EDGES) for w in set(text.lower().split())} - {b""}


def lexicon(documents: DataFrame, low: float = 0.001, high: float = 0.1) -> np.ndarray:
    """Hashes of the terms that are in a share from ``low`` to ``high`` of all documents, ascending.

    Document frequencies are counted over all whole texts. As the shares of all terms sum to the mean
    number of distinct terms m, at most m / low terms pass: the result is bounded whatever the input
    (about 200,000 for m = 200), and only it reaches the driver. Counts are pre-aggregated in each task
    and travel as compressed runs of hashes.
    """
    n = documents.count()
    buckets = max(1, min(1 << 14, n // 20_000))

    def flush(counts):
        keys = np.frombuffer(b"".join(map(xxhash.xxh64_digest, counts)), ">u8").astype(np.uint64)
        sums = np.fromiter(counts.values(), np.int64, len(counts))
        order = np.argsort(keys)
        keys, sums = keys[order], sums[order]
        cut = np.searchsorted(keys, np.array([(k << 64) // buckets for k in range(buckets)], np.uint64))
        for k, (s, e) in enumerate(zip(cut, [*cut[1:], len(keys)])):
            if e > s:
                yield batch(bucket=[k], terms=[pack_sorted(keys[s:e])], counts=[zstandard.compress(sums[s:e].astype("<i8").tobytes())])

    def count(batches):
        counts: dict[bytes, int] = {}
        for b in batches:
            for text in utf8(b.column(0)):
                for t in terms(text or b""):
                    counts[t] = counts.get(t, 0) + 1
                if len(counts) > _FLUSH:
                    yield from flush(counts)
                    counts = {}
        if counts:
            yield from flush(counts)

    def band(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_sorted(x.as_py()) for x in table.column("terms")])
        sums = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), "<i8") for x in table.column("counts")])
        names, at = np.unique(keys, return_inverse=True)
        share = np.bincount(at, weights=sums, minlength=len(names)) / n
        return pa.table({"term": pa.array(names[(share >= low) & (share <= high)].view(np.int64), pa.int64())})

    counted = documents.select("text").mapInArrow(count, "bucket long, terms binary, counts binary")
    kept = counted.groupBy("bucket").applyInArrow(band, "term long")
    return np.sort(np.array([r["term"] for r in kept.toLocalIterator()], np.int64).view(np.uint64))


def _short(some: list[bytes], seed: int = 0) -> int:
    return xxhash.xxh32_intdigest(b" ".join(some), seed) % 0xFFFF + 1


class Fingerprinter:
    """Fingerprints under one lexicon."""

    def __init__(self, kept: np.ndarray):
        self.kept = frozenset(kept.tolist())
        self.seen: dict[bytes, tuple[int, ...] | None] = {}  # None: not in the lexicon

    @lru_cache(1 << 18)
    def subsets(self, key: int) -> tuple[int, ...]:
        """The subsets that hold a term, drawn by its hash."""
        out = []
        for r, bits in enumerate(SHARES):
            draw = xxhash.xxh128_intdigest(key.to_bytes(8, "big"), seed=r)
            for j in range(SUBSETS):
                if (draw >> (j * 16)) & ((1 << bits) - 1) == 0:
                    out.append(r * SUBSETS + j)
        return tuple(out)

    def __call__(self, text: bytes) -> tuple[int, ...]:
        """A 16-bit hash of each subset's terms of the text in order, 0 for none.

        A text with few terms in the lexicon, such as a copy in a group so large that its terms are over
        the band, or one of rare words alone, has its subsets drawn from all its terms. A text with terms
        in fewer than LEAST subsets even so gets other hashes of all its terms in the first of the others.
        """
        seen = self.seen
        if len(seen) > _CACHE:
            seen.clear()
        parts: list[list[bytes]] = [[] for _ in range(SUBSETS * len(SHARES))]
        all_terms = sorted(terms(text))
        known = 0
        for t in all_terms:
            at = seen.get(t, ())
            if at == () and t not in seen:
                key = xxhash.xxh64_intdigest(t)
                at = seen[t] = self.subsets(key) if key in self.kept else None
            if at is not None:
                known += 1
                for j in at:
                    parts[j].append(t)
        if known < FEW[-1] * len(all_terms):
            whole_parts: list[list[bytes]] = [[] for _ in parts]
            for t in all_terms:
                for j in self.subsets(xxhash.xxh64_intdigest(t)):
                    whole_parts[j].append(t)
            parts = [w if known < few * len(all_terms) else p for p, w, few in zip(parts, whole_parts, FEW)]
        marks = [_short(p) if p else 0 for p in parts]
        bare = [j for j, mark in enumerate(marks) if not mark]
        for j in bare[: max(0, LEAST - len(marks) + len(bare))]:
            marks[j] = _short(all_terms, j + 1)
        return tuple(marks)


def likeness(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Share of the subsets that either text has terms in on which the two agree."""
    if a == b:
        return 1.0
    some = sum(1 for x, y in zip(a, b) if x or y)
    return sum(1 for x, y in zip(a, b) if x and x == y) / some if some else 0.0


def text_of(fingerprint: tuple[int, ...]) -> str:
    return "".join(f"{x:04x}" for x in fingerprint)


def fingerprints(documents: DataFrame, kept: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint), one row for each row of ``documents`` (doc_id, text); null text counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(kept)

    def run(batches):
        make = Fingerprinter(shared.value)
        for b in batches:
            yield batch(doc_id=b.column(0), fingerprint=[text_of(make(t or b"")) for t in utf8(b.column(1))])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def fingerprint_edits(documents: DataFrame, kept: np.ndarray, rows: int = 4096) -> DataFrame:
    """Fingerprints of each document, its edited text and the next document, with their likeness.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one
    row for each row of ``documents``. The next document has the next smaller doc_id; after the last
    comes the first. The edited text has the last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next document.

    Documents are dealt into ranges of doc_id that end at real doc_ids (about ``rows`` each, from
    approximate quantiles), sorted and read as a stream that holds two texts; the first document of a
    range also goes to the range before it. So each text is shuffled once.

    Null text: empty. Null doc_ids come last; rows that share a doc_id go by text, and each is the next
    of the one before it. Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n = documents.count()
    parts = max(1, min(20_000, n // rows))
    ends = keyed.agg(F.percentile_approx("key", [(i + 1) / parts for i in range(parts)], 4 * parts + 100).alias("ends"), F.max("key").alias("top")).first()
    edges = np.unique(np.array([*(ends.ends or []), ends.top or 0], np.int64))
    shared, bounds = spark.sparkContext.broadcast(kept), spark.sparkContext.broadcast(edges)

    def deal(batches):
        edges = bounds.value
        for b in batches:
            key = b.column(0).to_numpy()
            at = np.searchsorted(edges, key)
            heads = np.flatnonzero(edges[at] == key)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), bool)), b.column(0), b.column(1)], ["part", "guest", "key", "text"])
            if len(heads):
                guests = b.take(pa.array(heads))
                yield pa.RecordBatch.from_arrays([pa.array((at[heads] + 1) % len(edges)), pa.array(np.ones(len(heads), bool)), guests.column(0), guests.column(1)], ["part", "guest", "key", "text"])

    def pair(batches):
        make = Fingerprinter(shared.value)
        held, done = None, None  # the row that waits for its next; the part that has met its guest
        out: list[tuple] = []

        def finish(row, follower):
            text, mark = row[3], row[4]
            chars = text.decode()
            half = len(chars) // 2
            edited = (chars[: len(chars) - half] + follower[3].decode()[:half]).encode()
            new = make(edited)
            return (None if row[2] == _FIRST else row[2], len(chars), hashlib.sha256(edited).hexdigest(), text_of(mark), text_of(new), likeness(mark, new), likeness(mark, follower[4]))

        for b in batches:
            for part, guest, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), utf8(b.column(3))):
                if guest and done == part:
                    continue
                row = (part, guest, key, text, make(text))
                if held is not None:
                    out.append(finish(held, row))
                held = None if guest else row
                if guest:
                    done = part
            if out:
                yield _rows(out)
                out = []

    def _rows(out):
        c = list(zip(*out))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = keyed.mapInArrow(deal, "part long, guest boolean, key long, text string").repartition("part")
    ordered = dealt.sortWithinPartitions("part", "guest", F.desc("key"), "text")
    return ordered.mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
