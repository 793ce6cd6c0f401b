"""Packing of documents into windows next to their lexical neighbours (BM25)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import batch, offsets, tidy
from dwell.llm.tokens import WordEncoder, slices, spans

#: Bytes of text in a shard of the index.
SHARD_BYTES = 8 << 20
K1, B = 1.2, 0.75
#: Places of the table of document frequencies; words that fall on one place count as one there.
SLOTS = 1 << 21
#: Documents that others are grouped around, and the width of the hashed vectors that compare them.
LEADERS, WIDTH = 1024, 512
#: Places of the table in a row, tasks whose tables are summed at once, bytes hashed at a time.
_BUCKET, _LOT, _BLOCK = 1 << 14, 1024, 1 << 18
#: A term of fewer documents of a shard is never a row of its dense table.
_DENSE = 64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BLOCK, int(_ODD)), _powers(_BLOCK, pow(int(_ODD), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return ((h ^ h >> np.uint64(32)) >> np.uint64(1)).view(np.int64)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit hash of each word between ASCII white space, first word of each text and the end).

    A word's hash is the sum of its letters' numbers times powers of an odd number, so that running
    sums over many words give them all at once. Texts aren't null.
    """
    edges = offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]] if len(texts) else np.empty(0, np.uint8)
    edges = edges - edges[0]
    inside = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[edges] = True
    begin = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + _BLOCK, side="right")))
        s, e = begin[at], end[to - 1]
        up, down = (_UP, _DOWN) if e - s <= _BLOCK else (_powers(e - s, int(_ODD)), _DOWN)
        sums = np.zeros(e - s + 1, np.uint64)
        np.cumsum(_LETTER[data[s:e]] * up[: e - s], out=sums[1:])
        out[at:to] = (sums[end[at:to] - s] - sums[begin[at:to] - s]) * down[begin[at:to] - s]
        at = to
    return _mixed(out), np.searchsorted(begin, edges)


def word_codes_of(words: pa.Array) -> np.ndarray:
    """The hashes of single words; 0 for empty ones."""
    codes, first = word_codes(words)
    out = np.zeros(len(words), np.int64)
    out[np.diff(first) > 0] = codes
    return out


class Codes(dict):
    """The hashes of single words."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = int(word_codes(pa.array([word.decode()], pa.string()))[0][0])
        return code


@dataclass
class Statistics:
    """Number of documents, their mean length in words, and document frequencies by place."""

    n: int
    mean: float
    frequency: np.ndarray

    def idf(self, codes: np.ndarray) -> np.ndarray:
        held = np.maximum(1, self.frequency[codes & (SLOTS - 1)])
        return np.log1p((self.n - held + 0.5) / (held + 0.5))


def _places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, occurrences) of the distinct places of each text's words, by text."""
    codes, first = word_codes(texts)
    key = np.repeat(np.arange(len(texts)) * SLOTS, np.diff(first)) + (codes & SLOTS - 1)
    key, times = np.unique(key, return_counts=True)
    return key // SLOTS, key & SLOTS - 1, times


def statistics(documents: DataFrame) -> Statistics:
    """Counts over all documents; a table of bounded size reaches the driver, summed by range before."""

    def count(batches):
        table, n, words = np.zeros(SLOTS, np.int32), 0, 0
        for b in batches:
            for _, texts in slices(b.column(0)):
                _, place, times = _places(texts)
                n, words = n + len(texts), words + int(times.sum())
                table += np.bincount(place, minlength=SLOTS).astype(np.int32)
        if n:
            lot = TaskContext.get().partitionId() // _LOT
            yield batch(lot=[lot], bucket=[-1], counts=[zstandard.compress(np.array([n, words], "<i8").tobytes())])
            for k in range(SLOTS // _BUCKET):
                yield batch(lot=[lot], bucket=[k], counts=[zstandard.compress(table[k * _BUCKET : (k + 1) * _BUCKET].astype("<i8").tobytes())])

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for x in group.column("counts"):
            total = total + np.frombuffer(zstandard.decompress(x.as_py()), "<i8")
        return pa.table({"lot": group.column("lot").slice(0, 1), "bucket": group.column("bucket").slice(0, 1), "counts": pa.array([zstandard.compress(total.tobytes())], pa.binary())})

    kinds = "lot long, bucket long, counts binary"
    summed = documents.select("text").mapInArrow(tidy(count), kinds).groupBy("lot", "bucket").applyInArrow(add, kinds)
    n, words, table = 0, 0, np.zeros(SLOTS, np.uint32)
    for r in summed.groupBy("bucket").applyInArrow(add, kinds).collect():
        sums = np.frombuffer(zstandard.decompress(bytes(r.counts)), "<i8")
        if r.bucket < 0:
            n, words = sums.tolist()
        else:
            table[r.bucket * _BUCKET : (r.bucket + 1) * _BUCKET] = np.minimum(sums, (1 << 32) - 1)
    return Statistics(n, words / max(1, n), table)


def vectors(texts: pa.Array, known: Statistics) -> np.ndarray:
    """Unit vectors of the words' weights (log of occurrences times idf), hashed with signs to WIDTH places."""
    text, place, times = _places(texts)
    weight = (1 + np.log(times)) * known.idf(place) ** 2 * np.where(place >> 20 & 1, 1.0, -1.0)
    out = np.bincount(text * WIDTH + (place & WIDTH - 1), weight, len(texts) * WIDTH).reshape(-1, WIDTH)
    return (out / np.maximum(1e-9, np.sqrt((out * out).sum(1, keepdims=True)))).astype(np.float32)


def content_keys(texts: pa.Array, marks: np.ndarray, known: Statistics, leaders: np.ndarray) -> np.ndarray:
    """The nearest leader and the distance from it as one number; ``marks`` only spread equal texts."""
    likeness = vectors(texts, known) @ leaders.T
    best = likeness.argmax(axis=1)
    away = (1 - np.clip(likeness[np.arange(len(best)), best], -1, 1)) / 2.1
    return best + away.astype(float) + (marks & 0xFFFF) * 1e-7


def _chained(leaders: np.ndarray) -> np.ndarray:
    """The leaders in an order in which each is followed by the one most like it that is left."""
    likeness = leaders @ leaders.T
    order, left = [0], np.arange(len(leaders)) > 0
    while left.any():
        order.append(int(np.where(left, likeness[order[-1]], -2.0).argmax()))
        left[order[-1]] = False
    return leaders[order]


def _keyed(documents: DataFrame, shard_bytes: int):
    """(part, key, doc_id, text) with the part of each document, about ``shard_bytes`` of related texts; the broadcast statistics."""
    context = documents.sparkSession.sparkContext
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("mark"))
    known = statistics(rows)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // shard_bytes))
    shared = context.broadcast(known)
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 30))
    share = lambda wanted: int((1 << 30) * min(1.0, wanted / max(1, known.n)))
    most = min(LEADERS, 4 * parts)
    heads = rows.where(drawn < share(1.5 * most)).select("text").limit(most)

    def read(batches):
        for b in batches:
            for _, texts in slices(b.column(0), 1 << 20):
                yield batch(v=[v.tobytes() for v in vectors(texts, shared.value)])

    found = [np.frombuffer(bytes(r.v), np.float32) for r in heads.mapInArrow(tidy(read), "v binary").collect()] if parts > 1 else []
    leaders = context.broadcast(_chained(np.array(found)) if found else np.zeros((1, WIDTH), np.float32))

    def keys(batches):
        for b in batches:
            marks = b.column(2).to_numpy()
            some = [content_keys(texts, marks[k : k + len(texts)], shared.value, leaders.value) for k, texts in slices(b.column(1), 1 << 20)]
            yield batch(key=pa.array(np.concatenate([np.empty(0), *some])), doc_id=b.column(0), text=b.column(1))

    kinds = "key double, doc_id long, text string"
    edges = np.empty(0)
    if parts > 1:
        sample = rows.where(drawn < share(max(4096, 32 * parts))).mapInArrow(tidy(keys), kinds).select("key", F.octet_length("text").alias("size")).toArrow()
        at, size = sample.column("key").to_numpy(), sample.column("size").to_numpy()
        order = np.argsort(at)
        if len(at):
            so_far = np.cumsum(size[order])
            edges = at[order][np.minimum(np.searchsorted(so_far, so_far[-1] * np.arange(1, parts) / parts), len(at) - 1)]
    bounds = context.broadcast(edges)

    def deal(batches):
        for b in keys(batches):
            yield batch(part=pa.array(np.searchsorted(bounds.value, b.column(0).to_numpy()).astype(np.int64)), key=b.column(0), doc_id=b.column(1), text=b.column(2))

    return rows.mapInArrow(tidy(deal), f"part long, {kinds}"), shared


class Index:
    """BM25 inverted index of one shard, weighted by ``known`` or else by the shard's own counts.

    Terms that a good part of the documents have are rows of a dense table, the others lists of postings.
    """

    def __init__(self, lists: list[list[bytes]], known: Statistics | None = None):
        numbers: dict[bytes, int] = {}
        term = np.array([numbers.setdefault(w, len(numbers)) for words in lists for w in words], np.int64)
        codes = Codes()
        first = np.cumsum([0, *map(len, lists)])
        self._build(term, first, np.array([codes[w] for w in numbers], np.int64), known, 1)

    @classmethod
    def of(cls, term: np.ndarray, first: np.ndarray, codes: np.ndarray, known: Statistics) -> Index:
        """The index of texts of numbered words; words of one text alone, which no other can share, are left out."""
        self = cls.__new__(cls)
        self._build(term, first, codes, known, 2)
        return self

    def _build(self, term: np.ndarray, first: np.ndarray, codes: np.ndarray, known: Statistics | None, least: int):
        sizes = np.diff(first)
        self.n = n = len(sizes)
        key, tf = np.unique(term.astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)  # by term
        term, doc = np.divmod(key, max(1, n))
        holders = np.bincount(term, minlength=len(codes))
        idf = known.idf(codes) if known else np.log1p((n - holders + 0.5) / (holders + 0.5))
        mean = known.mean if known else sizes.mean() if n else 1.0
        length = K1 * (1 - B + B * sizes / max(1.0, mean))
        weight = (idf[term] * tf * (K1 + 1) / (tf + length[doc])).astype(np.float32)
        wide = holders >= max(_DENSE, n // 8)
        on, dense = (holders[term] >= least) & ~wide[term], wide[term]
        row = np.cumsum(wide) - 1
        self.table = np.zeros((int(wide.sum()), n), np.float32)
        self.table[row[term[dense]], doc[dense]] = weight[dense]
        self.doc, self.weight = doc[on].astype(np.int32), weight[on]
        held = np.bincount(term[on], minlength=len(codes))
        end = np.cumsum(held)
        self.start, self.held = end - held, held

        def by_document(on, number):
            to = np.argsort(doc[on], kind="stable")
            return number[to], np.searchsorted(doc[on][to], np.arange(n + 1))

        self.terms, self.first = by_document(on, term[on])
        self.rows, self.first_row = by_document(dense, row[term[dense]])

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The score of each unused document for the terms of ``seed``, 0 for the others."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        at = spans(self.start[terms], self.held[terms])
        found = np.bincount(self.doc[at], self.weight[at], self.n)
        rows = self.rows[self.first_row[seed] : self.first_row[seed + 1]]
        return np.where(unused, found + self.table[rows].sum(0), 0.0)


def order_by_neighbours(index: Index, sizes: np.ndarray, window: int) -> list[int]:
    """An order of documents in which each window is seeded by what it starts with and filled greedily.

    The seed of a window is the document that reaches into it, or else the first unused one; its unused
    neighbours follow, best first and the first of equal ones, and after them the unused documents in
    order. The document that crosses the window's end seeds the next one.
    """
    n = len(sizes)
    unused = np.ones(n, bool)
    order: list[int] = []
    total, next_free = 0, 0

    def take(d: int):
        nonlocal total
        order.append(d)
        unused[d] = False
        total += int(sizes[d])

    while len(order) < n:
        if total % window == 0:
            while not unused[next_free]:
                next_free += 1
            take(next_free)
            if total % window == 0:
                continue
        end = -(-total // window) * window
        scores = index.scores(order[-1], unused)
        while total < end:
            d = int(scores.argmax())
            if scores[d] <= 0:
                break
            scores[d] = 0.0
            take(d)
        while total < end and len(order) < n:
            while not unused[next_free]:
                next_free += 1
            take(next_free)
    return order


def cuts(total: int, window: int) -> np.ndarray:
    """Ends of sequences over ``total`` ids: whole windows, then powers of two, so nothing is padded."""
    ends = np.arange(window, total + 1, window)
    at, rest = total - total % window, total % window
    more = []
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            more.append(at)
    return np.concatenate([ends, np.array(more, np.int64)]).astype(np.int64)


def pack(documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents' ids.

    ids: the piece's ids as little-endian unsigned 32-bit numbers, of the whole text by the tokenizer
    file, and ``end_id`` after them. Document frequencies and mean length are counted over all documents.
    Shards are about ``shard_bytes`` of texts that are nearest to the same leaders (documents drawn from all
    the input), in order of their distance from them, whatever the layout of the input; seeds find their
    neighbours there. A group too large for a shard is split along that distance, equal texts at random.
    All sequences of a shard are full windows but its last ones, which are cut to powers of two.

    Null text: empty, one piece with the end id alone. Repeated rows are packed each, null doc_ids stay
    null; other columns are ignored; an empty table gives no rows.
    """

    def pieces(encoder, ids, texts, name: int):
        flat, bounds, term, first, words = encoder.encode_words(texts)
        sizes = np.diff(bounds) + 1
        real = pc.binary_length(words).to_numpy()[term] > 0
        index = Index.of(term[real], np.concatenate([[0], np.cumsum(real)])[first], word_codes_of(words), shared.value)
        order = np.array(order_by_neighbours(index, sizes, window), np.int64)
        # the end ids are set in behind each document's ids
        coded = memoryview(np.insert(flat, bounds[1:], end_id)).cast("B")
        origins = bounds[:-1] + np.arange(len(sizes))
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        total = int(ends[-1])
        stops = cuts(total, window)
        edges = np.unique(np.concatenate([[0], ends, stops]))
        begin, stop = edges[:-1], edges[1:]
        row = np.searchsorted(ends, begin, side="right")
        sequence = np.searchsorted(stops, begin, side="right")
        origin = np.concatenate([[0], stops])[sequence]
        doc = order[row]
        start = begin - starts[row]
        length = stop - begin
        at = 4 * (origins[doc] + start)
        parts = [bytes(coded[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
        return batch(
            doc_id=ids.take(pa.array(doc)), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids=pa.array(parts, pa.binary()),
            doc_tokens=pa.array(sizes[doc], pa.int64()), sequence_id=pa.array(name + sequence, pa.int64()), offset=pa.array(begin - origin, pa.int64()),
        )

    def run(batches):
        # a shard's sequences are numbered after those of the shards before it in the task
        used, encoder = TaskContext.get().partitionId() << 40, WordEncoder(tokenizer)
        ids, texts, size, shard = [], [], 0, None

        def flush():
            nonlocal ids, texts, size, used
            out = pieces(encoder, pa.concat_arrays(ids), pa.concat_arrays(texts), used)
            used = out.column(5)[-1].as_py() + 1
            ids, texts, size = [], [], 0
            return out

        for b in batches:
            part, bytes_ = b.column(0).to_numpy(), np.diff(offsets(b.column(2)))
            at = 0
            while at < len(part):
                if ids and (part[at] != shard or size >= 2 * shard_bytes):
                    yield flush()
                shard = part[at]
                most = np.searchsorted(np.cumsum(bytes_[at:]), 2 * shard_bytes - size) + 1
                to = at + min(int(most), int(np.searchsorted(part[at:], shard, side="right")))
                ids.append(b.column(1).slice(at, to - at))
                texts.append(b.column(2).slice(at, to - at))
                size += int(bytes_[at:to].sum())
                at = to
        if ids:
            yield flush()

    dealt, shared = _keyed(documents, shard_bytes)
    ordered = dealt.repartition("part").sortWithinPartitions("part", "key", "doc_id", "text").select("part", "doc_id", "text")
    kinds = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ordered.mapInArrow(tidy(run), kinds)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
