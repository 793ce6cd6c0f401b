"""SimHash near-duplicate classes by deletion-variant signatures."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import batch, checkpointed, sorted_runs, tidy, utf8
from dwell.llm.components import connected_components

SEED = 42
#: Runs of more fingerprints than this under one signature are signed again on their other segment.
LARGE_RUN = 4096
#: Runs of up to this many fingerprints are compared together, step by step.
SHORT_RUN = 32


def fingerprint(text: bytes | None, width: int = 3) -> bytes:
    """64-bit SimHash, big-endian: a bit is set if it is in over half of the shingles' XXH64."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(rows)).tobytes()


def with_fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, bits): the fingerprint of each row's whole text as a signed long."""

    def run(batches):
        for b in batches:
            raw = b"".join(fingerprint(t, width) for t in utf8(b.column(1)))
            yield batch(doc_id=b.column(0), bits=pa.array(np.frombuffer(raw, ">i8").astype(np.int64)))

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, bits long")


def spanning(n: int, pairs, label: np.ndarray | None = None):
    """Of (a, b) arrays of linked rows, the links that join two parts of ``n`` rows, and each row's part.

    A part is named by its first row; ``label`` names those that are joined already.
    """
    label, found_a, found_b = np.arange(n) if label is None else label.copy(), [], []
    for a, b in pairs:
        while True:
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            hi, lo = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
            first = np.unique(hi, return_index=True)[1]
            found_a.append(a[first])
            found_b.append(b[first])
            label[hi[first]] = lo[first]
            while not np.array_equal(label, up := label[label]):
                label = up
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b]), label


def _links(values: np.ndarray, groups: np.ndarray | None, radius: int):
    """Spanning links of the fingerprints of one run; with ``groups`` only across its two halves."""
    if groups is None:
        left = right = np.arange(len(values))
    else:
        left, right = np.flatnonzero(~groups), np.flatnonzero(groups)
    step = max(1, (1 << 20) // max(1, len(right)))

    def near():
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            a, b = np.nonzero(np.bitwise_count(values[rows, None] ^ values[None, right]) <= radius)
            yield rows[a], right[b]

    a, b, _ = spanning(len(values), near())
    return values[a], values[b]


def _short_links(bits: np.ndarray, side: np.ndarray, whole: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int):
    """``_links`` of all runs from ``starts`` to ``ends``, each row with the row one, two, ... places on."""

    def near():
        size = ends - starts
        rows = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
        last, step = np.repeat(ends, size), 1
        while len(rows):
            inside = rows + step < last
            rows, last = rows[inside], last[inside]
            other = rows + step
            found = (whole[rows] | (side[rows] != side[other])) & (np.bitwise_count(bits[rows] ^ bits[other]) <= radius)
            yield rows[found], other[found]
            step += 1

    a, b, _ = spanning(len(bits), near())
    return bits[a], bits[b]


def _verify(radius: int, final: bool, large_run: int):
    """Links within each run of one signature; runs that are too long are handed on, not compared."""

    def run(batches):
        keys = ["k1", "k2"] if final else ["k1"]
        most = 1 << 62 if final else large_run
        for cols, starts, ends, state in sorted_runs(batches, keys, most):
            bits = cols["bits"].view(np.uint64)
            if state == "more":
                yield batch(k1=pa.array(cols["k1"]), bits=pa.array(cols["bits"]), other=pa.nulls(len(bits), pa.int64()))
                continue
            two = ends - starts > 1
            starts, ends = starts[two], ends[two]
            if not len(starts):
                continue
            key = cols["k2" if final else "k1"]
            place = (key >> 32) & 63  # the wildcard's place among the 64 bits
            whole = (key >> 38) & 1 == 1  # this signature also stands for the unchanged segment
            side = (bits >> place.astype(np.uint64)) & np.uint64(1) == 1
            bounds = np.stack([starts, ends], 1).ravel()
            bounds = bounds[:-1] if ends[-1] == len(side) else bounds
            low, high = np.minimum.reduceat(side, bounds)[::2], np.maximum.reduceat(side, bounds)[::2]
            todo = whole[starts] | (low != high)
            short = ends - starts <= SHORT_RUN
            a, b = _short_links(bits, side, whole, starts[todo & short], ends[todo & short], radius)
            found_a, found_b = [a], [b]
            for i in np.flatnonzero(todo & ~short):
                s, e = starts[i], ends[i]
                a, b = _links(bits[s:e], None if whole[s] else side[s:e], radius)
                found_a.append(a)
                found_b.append(b)
            a, b = np.concatenate(found_a).view(np.int64), np.concatenate(found_b).view(np.int64)
            if len(a):
                yield batch(k1=pa.array(np.zeros(len(a), np.int64)), bits=pa.array(a), other=pa.array(b))

    return run


def _pieces(first: int, size: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, size) of ``parts`` pieces of ``size`` bits from bit ``first``, as equal as can be."""
    return [(a, b - a) for a, b in pairwise(first + size * k // parts for k in range(parts + 1))]


def _signatures(bits, segments: list[tuple[int, int]]):
    """Signatures of each segment of (first bit, size): one for each wildcard place; bits go on at 0 after 63.

    A signature packs the segment without the wildcard's bit, the place, whether it is the one under
    which equal segments meet, and the segment's number.
    """
    found = []
    for number, (first, size) in enumerate(segments):
        first, mask = first % 64, (1 << size) - 1
        turned = F.shiftright(bits, first)
        if first + size > 64:
            turned = F.shiftrightunsigned(bits, first).bitwiseOR(F.shiftleft(bits, 64 - first))
        for i in range(size):
            mark = ((first + i) % 64 << 32) | ((i == 0) << 38) | (number << 39)
            found.append(turned.bitwiseAND(F.lit(mask & ~(1 << i))).bitwiseOR(F.lit(mark)))
    return F.array(*found)


def near_links(fingerprints: DataFrame, radius: int = 3, large_run: int = LARGE_RUN) -> DataFrame:
    """Links (bits, other) that span all pairs of ``fingerprints.bits`` at ``radius`` (at most 7) bits.

    Of radius // 2 + 1 segments (two at least) one differs by at most one bit, so two such fingerprints
    share a segment variant with one wildcard bit: 32-bit segments up to 3 bits, 16-bit ones for 7. Rows
    meet by equal variant and are verified there. A run of over ``large_run`` fingerprints under one
    variant is signed once more on as many pieces of its other bits, where again one differs by at most
    one bit. At 3 bits such a run has at most 2**18 distinct fingerprints, so no task holds an unbounded
    group; at 7 bits 26 bits are fixed in it. Only links that join two parts of a run leave it: fewer
    rows than fingerprints in it, never all pairs.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    out = "k1 long, bits long, other long"
    distinct = fingerprints.select("bits").distinct()
    parts = max(2, radius // 2 + 1)
    segments = _pieces(0, 64, parts)
    signed = distinct.select("bits", F.explode(_signatures(F.col("bits"), segments)).alias("k1"))
    met = signed.repartition("k1").sortWithinPartitions("k1", "bits").mapInArrow(tidy(_verify(radius, False, large_run)), out)
    met = checkpointed(met)
    long = met.where("other is null")
    links = met.where("other is not null").select("bits", "other")
    if long.isEmpty():
        return links
    rest = [long.where(F.shiftright("k1", 39) == k).select("bits", "k1", F.explode(_signatures(F.col("bits"), _pieces(first + size, 64 - size, parts))).alias("k2")) for k, (first, size) in enumerate(segments)]
    again = reduce(DataFrame.union, rest)
    again = again.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "bits").select("k1", "k2", "bits")
    return links.union(again.mapInArrow(tidy(_verify(radius, True, large_run)), out).select("bits", "other"))


def near_duplicate_classes(documents: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, class_bits), one row for each row of ``documents``.

    ``documents`` needs doc_id and text; other columns are ignored. Null or blank text: fingerprint
    zero, linked like any other. Repeated rows and equal texts share a class. component_id is the
    smallest doc_id of the class; null doc_ids count only if the class has no other, and then it is
    null. class_bits tells classes apart even then. An empty table gives no rows.
    """
    marked = checkpointed(with_fingerprints(documents, width))
    firsts = marked.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(near_links(firsts, radius), "bits", "other")
    classed = firsts.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "first_id", F.coalesce("root", "bits").alias("class_bits"))
    least = classed.groupBy("class_bits").agg(F.min("first_id").alias("component_id"))
    classed = classed.join(least, "class_bits").select("bits", "class_bits", "component_id")
    named = marked.join(classed, "bits")
    return named.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "class_bits")


def drop_near_duplicates(documents: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``documents`` with one row of each near-duplicate class: that of the smallest doc_id.

    Where rows share a doc_id, each class keeps one with its own text; rows without doc_id stay as they
    are, as nothing names them.
    """
    classes = near_duplicate_classes(documents, width, radius).where("doc_id = component_id")
    kept = classes.groupBy("class_bits").agg(F.min("component_id").alias("_kept_id"), F.min("fingerprint").alias("fingerprint"))
    source = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    named = documents.withColumn("_kept_source", source).withColumn("_kept_id", F.col("doc_id").cast("long"))
    rows = named.join(kept.select("_kept_id"), "_kept_id", "left_semi").select("_kept_id", "_kept_source", "text")
    prints = with_fingerprints(rows.select(F.col("_kept_source").alias("doc_id"), "text"), width)
    prints = prints.select(F.col("doc_id").alias("_kept_source"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")).distinct()
    own = rows.select("_kept_id", "_kept_source").distinct().join(prints, "_kept_source").join(kept, ["_kept_id", "fingerprint"])
    own = own.groupBy("class_bits").agg(F.min("_kept_id").alias("_kept_id"), F.min("_kept_source").alias("_kept_source"))
    named = named.join(own.select("_kept_id", "_kept_source"), ["_kept_id", "_kept_source"], "left_semi").dropDuplicates(["_kept_id", "_kept_source"])
    return named.select(*documents.columns).unionByName(documents.where("doc_id is null"))
