"""Exact repeats of word windows over the whole corpus, found from fixed-block anchors."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import batch, checkpointed, pack_sorted, unpack_sorted, utf8

#: Bytes of text that are worked on at a time, and window values under one bucket.
CHUNK_BYTES = 8 << 20
BUCKET_VALUES = 2 << 20
_STEP, _CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LAST = np.int64(np.iinfo(np.int64).max)
_ASK = "bucket long, chunk long, blob binary, extra binary"
_ANSWER = "chunk long, bucket long, blob binary"


def _chunks(limit: int):
    """Rows (chunk, words, docs): runs of documents of about ``limit`` bytes, each as one Arrow message."""

    def message(ids, texts):
        part = batch(doc_id=pa.array(ids, pa.int64()), text=pa.array(texts, pa.binary()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(part)
        return sink.getvalue().to_pybytes()

    def run(batches):
        task, n, ids, texts, size, words = TaskContext.get().partitionId(), 0, [], [], 0, 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                ids.append(i)
                texts.append(t := t or b"")
                size += len(t)
                words += len(t.split())
                if size >= limit:
                    yield batch(chunk=[(task << 32) + n], words=[words], docs=[message(ids, texts)])
                    n, ids, texts, size, words = n + 1, [], [], 0, 0
        if ids:
            yield batch(chunk=[(task << 32) + n], words=[words], docs=[message(ids, texts)])

    return run


class _Chunk:
    """The words of one chunk with the hashes of their windows."""

    def __init__(self, message: bytes, window: int, bits: int):
        with pa.ipc.open_stream(message) as reader:
            part = reader.read_next_batch()
        self.ids = part.column(0).to_pylist()
        self.lists = [t.split() for t in part.column(1).to_pylist()]
        self.window, self.block = window, (window + 1) // 2
        self.sizes = np.array([len(x) for x in self.lists], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        words = [w for x in self.lists for w in x]
        self.hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(7))), ">u8").astype(np.uint64)
        self.place = np.arange(len(words)) - np.repeat(self.starts, self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.place
        self.short = self.rolled(self.block, _STEP) >> np.uint64(64 - bits)
        self.whole = self.left >= self.block

    def rolled(self, width: int, step: np.uint64) -> np.ndarray:
        """A hash of the ``width`` words from each place; meaningless where a document ends before."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        for j in range(min(width, n)):
            out *= step
            out[: n - j] += self.hashes[j:]
        out ^= out >> np.uint64(29)
        return out * _CHECK

    def probes(self) -> np.ndarray:
        return np.unique(self.short[self.whole])

    def anchors(self) -> np.ndarray:
        return np.unique(self.short[self.whole & (self.place % self.block == 0)])

    def candidates(self, answers: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows around hit anchors: (place of each, class of each, the classes' hash, check, first doc, first place)."""
        values = np.sort(self.short[self.whole])
        own = np.intersect1d(values[1:][values[1:] == values[:-1]], self.anchors())
        hits = np.union1d(own, answers)
        n = len(self.hashes)
        hit = np.zeros(n + 1, np.int64)
        if len(hits):
            at = np.minimum(np.searchsorted(hits, self.short), len(hits) - 1)
            hit[1:] = np.cumsum((hits[at] == self.short) & self.whole)
        spots = np.flatnonzero(self.left >= self.window)
        spots = spots[hit[spots + self.window - self.block + 1] > hit[spots]]
        key, check = self.rolled(self.window, _STEP)[spots], (self.rolled(self.window, _CHECK)[spots] >> np.uint64(48)).astype(np.uint64)
        order = np.lexsort((check, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        doc = np.repeat(np.array([_LAST if i is None else i for i in self.ids], np.int64), self.sizes)[spots]
        place = self.place[spots]
        by = np.lexsort((place, doc, kind))
        first = by[np.searchsorted(kind[by], np.arange(int(new.sum())))]
        return spots, kind, key[order][new], check[order][new], doc, place, doc[first], place[first]


def _bucket(values: np.ndarray, bits: int, spread: int) -> np.ndarray:
    return (values >> np.uint64(bits - spread)).astype(np.int64) if spread else np.zeros(len(values), np.int64)


def _slices(buckets: np.ndarray):
    """(bucket, slice) over ascending buckets."""
    names, first = np.unique(buckets, return_index=True)
    return zip(names.tolist(), map(slice, first, [*first[1:], len(buckets)]))


def _planes(*columns: np.ndarray) -> bytes:
    flat = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(flat)


def _columns(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(c.T).view("<i8").ravel() for c in raw]


def _probe(window: int, bits: int, spread: int):
    """Asks of each chunk: all its rolling blocks, and those on its own grid, by bucket."""

    def run(batches):
        for b in batches:
            for name, message in zip(b.column(0).to_pylist(), b.column(1)):
                chunk = _Chunk(message.as_py(), window, bits)
                probes, anchors = chunk.probes(), chunk.anchors()
                own = dict(_slices(_bucket(anchors, bits, spread)))
                for k, part in _slices(_bucket(probes, bits, spread)):
                    index = anchors[own[k]] if k in own else anchors[:0]
                    yield batch(bucket=[k], chunk=[name], blob=[pack_sorted(probes[part])], extra=[pack_sorted(index)])

    return run


def _match(table: pa.Table) -> pa.Table:
    """Of a bucket: for each chunk those values that it shares with another chunk and that are an anchor."""
    chunks = table.column("chunk").to_pylist()
    probes = [unpack_sorted(x.as_py()) for x in table.column("blob")]
    anchors = np.unique(np.concatenate([unpack_sorted(x.as_py()) for x in table.column("extra")]))
    values = np.sort(np.concatenate(probes))
    shared = np.unique(values[1:][values[1:] == values[:-1]])
    shared = np.intersect1d(shared, anchors, assume_unique=True)
    found = [np.intersect1d(p, shared, assume_unique=True) for p in probes]
    some = [i for i, f in enumerate(found) if len(f)]
    return pa.table({
        "chunk": pa.array([chunks[i] for i in some], pa.int64()),
        "bucket": pa.array([table.column("bucket")[0].as_py()] * len(some), pa.int64()),
        "blob": pa.array([pack_sorted(found[i]) for i in some], pa.binary()),
    })


def _given(answers, empty=np.empty(0, np.uint64)) -> dict[int, np.ndarray]:
    return {a["bucket"]: unpack_sorted(a["blob"]) for a in answers or ()}


def _hits(answers) -> np.ndarray:
    parts = _given(answers)
    return np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.empty(0, np.uint64)


def _extend(window: int, bits: int, spread: int):
    """Asks of each chunk: its distinct windows around hits, each with its first document and place."""

    def run(batches):
        for b in batches:
            for name, message, answers in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                _, _, key, check, _, _, doc, place = _Chunk(message.as_py(), window, bits).candidates(_hits(answers.as_py()))
                for k, part in _slices(_bucket(key, 64, spread)):
                    blob = _planes(np.diff(key[part], prepend=np.uint64(0)), check[part], doc[part], place[part])
                    yield batch(bucket=[k], chunk=[name], blob=[blob], extra=[b""])

    return run


def _first(table: pa.Table) -> pa.Table:
    """Of a bucket: for each chunk the numbers of those of its windows that start earlier in another chunk."""
    chunks = table.column("chunk").to_pylist()
    parts = [_columns(x.as_py(), 4) for x in table.column("blob")]
    key = np.concatenate([np.cumsum(p[0].view(np.uint64), dtype=np.uint64) for p in parts])
    check, doc, place = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    order = np.lexsort((place, doc, check, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    leader = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.empty(len(order), bool)
    later[order] = (doc[leader] != doc[order]) | (place[leader] != place[order])
    ends = np.cumsum([len(p[0]) for p in parts])
    found = [np.flatnonzero(later[e - len(p[0]) : e]) for p, e in zip(parts, ends)]
    some = [i for i, f in enumerate(found) if len(f)]
    return pa.table({
        "chunk": pa.array([chunks[i] for i in some], pa.int64()),
        "bucket": pa.array([table.column("bucket")[0].as_py()] * len(some), pa.int64()),
        "blob": pa.array([pack_sorted(found[i].astype(np.uint64)) for i in some], pa.binary()),
    })


def _remove(window: int, bits: int, spread: int):
    """The documents of each chunk without the words of later repeats."""

    def run(batches):
        for b in batches:
            for message, hits, answers in zip(b.column(0), b.column(1), b.column(2)):
                chunk = _Chunk(message.as_py(), window, bits)
                spots, kind, key, _, doc, place, doc0, place0 = chunk.candidates(_hits(hits.as_py()))
                later = np.zeros(len(key), bool)
                given = _given(answers.as_py())
                for k, part in _slices(_bucket(key, 64, spread)):
                    if k in given:
                        later[part.start + given[k].astype(np.int64)] = True
                gone = spots[later[kind] | (doc != doc0[kind]) | (place != place0[kind])]
                edge = np.zeros(len(chunk.hashes) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + window, -1)
                cut = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(cut)])
                removed = total[chunk.starts + chunk.sizes] - total[chunk.starts]
                texts = []
                for words, s, r in zip(chunk.lists, chunk.starts.tolist(), removed.tolist()):
                    if r:
                        words = [w for w, c in zip(words, cut[s : s + len(words)].tolist()) if not c]
                    texts.append(b" ".join(words).decode())
                yield batch(doc_id=pa.array(chunk.ids, pa.int64()), n_words=pa.array(chunk.sizes), n_removed=pa.array(removed, pa.int64()), kept_text=pa.array(texts, pa.string()))

    return run


def drop_repeats(documents: DataFrame, window: int = 20, chunk_bytes: int = CHUNK_BYTES, bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row for each row of ``documents``.

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a
    document of smaller doc_id, or earlier in the same one. Windows are judged on the input.

    Each document is cut into a grid of blocks of half a window, so that every window holds a whole
    block of its earlier copy. The grid is the index; every rolling block of the corpus probes it.
    Blocks that meet are extended to the windows around them, which are compared by an 80-bit hash
    and their first places; runs of consecutive repeated windows are the maximal repeats. Probes and
    windows travel as compressed runs of distinct values for a chunk of documents and a hash range,
    so a passage that fills a third of all rows counts once for each chunk, and answers come back to
    chunks, which keep to a stated size.

    Null text: no words. Rows that share a doc_id count as one document for the order, so equal rows
    don't remove each other; null doc_ids come after all others, as one document. Other columns are
    ignored; an empty table gives no rows.
    """
    chunks = checkpointed(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunks(chunk_bytes), "chunk long, words long, docs binary"))
    words = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    spread = max(0, int(words // bucket_values).bit_length())
    bits = min(64, max(32, spread, int(words).bit_length() + 8))

    def told(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias(name))

    asked = chunks.select("chunk", "docs").mapInArrow(_probe(window, bits, spread), _ASK)
    hits = told(checkpointed(asked.groupBy("bucket").applyInArrow(_match, _ANSWER)), "hits")
    seeded = chunks.join(hits, "chunk", "left")
    asked = seeded.select("chunk", "docs", "hits").mapInArrow(_extend(window, bits, spread), _ASK)
    later = told(checkpointed(asked.groupBy("bucket").applyInArrow(_first, _ANSWER)), "later")
    judged = seeded.join(later, "chunk", "left").select("docs", "hits", "later")
    return judged.mapInArrow(_remove(window, bits, spread), "doc_id long, n_words long, n_removed long, kept_text string")


#: The rows of the registered query for DuckDB; ``{window}`` words make a window.
SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM t),
w AS (SELECT doc_id, pos AS start, hash(list(word) OVER v) AS part, count(*) OVER v AS n FROM l
      WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window} - 1 FOLLOWING)),
f AS (SELECT *, min(struct_pack(d := doc_id, s := start)) OVER (PARTITION BY part) AS first FROM w WHERE n = {window}),
g AS (SELECT DISTINCT doc_id, start + o AS pos FROM f, range({window}) r(o) WHERE first < struct_pack(d := doc_id, s := start)),
k AS (SELECT l.doc_id, count(*) AS n_words, count(g.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
