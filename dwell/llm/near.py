"""Near-duplicate classes by exact Jaccard similarity of word shingles.

SimHash links by deletion-variant signatures come first; prefix filtering finds the pairs that no signature reaches.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import batch, checkpointed, sorted_runs, tidy, utf8
from dwell.llm.components import connected_components
from dwell.llm.simhash import SEED, near_links, spanning

#: A 256-bit SimHash of SKETCH_SIZE or more shingles differs by 39 bits on average with a deviation of 6 at
#: a similarity of 0.8, so fewer than one such pair in a thousand million is over SKETCH_BITS.
SKETCH_SIZE, SKETCH_BITS = 32, 80
_WORDS = np.array([1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_BITS = [f"b{k}" for k in range(len(_WORDS))]
#: Differing bits of 64 up to which signatures find all pairs; at a similarity of 0.8 it is 10 on average.
RADIUS = 7
_KINDS = ", ".join(f"{k} long" for k in _BITS)
#: Documents and shingles that set the order of shingles; any order gives the same classes.
SAMPLE_DOCS, SAMPLE_SHINGLES = 20_000, 50_000
#: Rows of a run that are compared with each other; a longer run counts as alike.
PIECE = 4096
#: Texts, and shingles, of a block of a family, and the shingles' holders from which they are counted by a matrix product.
BLOCK, BLOCK_SHINGLES, HOLDERS = 512, 1 << 20, 16


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` lower-case words, ascending; fewer words are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        runs = [b" ".join(words)]
    else:
        runs = set(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(SEED))), ">u8").astype(np.uint64))


def _sketch(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set of shingles as four numbers, each from other hashes of them."""
    ones = np.zeros(256, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        h = hashes[at : at + (1 << 14), None] * _WORDS
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 32), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes)).view(np.int64).tolist()


def _common(documents: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample, ascending, and their counts."""

    def run(batches):
        for b in batches:
            found = [shingles(t, width) for t in utf8(b.column(0))]
            yield batch(h=pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)))

    n = documents.count()
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / max(1, n)))
    counted = documents.where(part).select("text").mapInArrow(run, "h long").groupBy("h").count().where("count > 2")
    top = counted.orderBy(F.desc("count"), "h").limit(SAMPLE_SHINGLES).toArrow()
    names, sums = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(names)
    return names[order], sums[order]


def _marked(documents: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, source, print, b0 to b3, n, prefix) of each row: hashes of its text and of its shingles, and
    of those the first n - ceil(similarity * n) + 1 with the rarest of the sample ahead."""
    shared = documents.sparkSession.sparkContext.broadcast(_common(documents, width))
    share = Fraction(str(similarity))

    def run(batches):
        names, sums = shared.value
        for b in batches:
            prints, bits, sizes, prefixes = [], [], [], []
            for t in utf8(b.column(2)):
                h = shingles(t, width)
                n = len(h)
                prints.append(int(np.int64(np.uint64(xxhash.xxh64_intdigest(h.tobytes())))) if n else 0)
                bits.append(_sketch(h) if n else [0] * len(_BITS))
                sizes.append(n)
                if n and len(names):
                    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    h = h[np.argsort(np.where(names[at] == h, sums[at], 0), kind="stable")]
                prefixes.append(h[: n - math.ceil(share * n) + 1].tobytes() if n else b"")
            sketch = np.array(bits, np.int64).reshape(-1, len(_BITS))
            yield batch(doc_id=b.column(0), source=b.column(1), print=pa.array(prints, pa.int64()), **{k: pa.array(sketch[:, i]) for i, k in enumerate(_BITS)}, n=pa.array(sizes, pa.int64()), prefix=pa.array(prefixes, pa.binary()))

    rows = documents.select(F.col("doc_id").cast("long"), _source(documents).alias("source"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id long, source long, print long, {_KINDS}, n long, prefix binary")


def _source(documents: DataFrame):
    return F.xxhash64(F.coalesce(documents["text"], F.lit("")))


def _keys(batches):
    """(key, class, n, b0 to b3) for each shingle of the prefixes."""
    for b in batches:
        lists = [np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()]
        times = [len(x) for x in lists]
        keys = np.concatenate([np.empty(0, np.int64), *lists])
        rest = {name: pa.array(np.repeat(b.column(name).to_numpy(), times)) for name in ("class", "n", *_BITS)}
        yield batch(key=pa.array(keys), **rest)


def _alike(bits, n, rows, similarity: float) -> np.ndarray:
    """Whether sizes and sketches of ``rows`` and of all leave room for the similarity."""
    a, b = n[rows, None], n[None]
    least = np.minimum(a, b)
    apart = np.bitwise_count(bits[rows, None] ^ bits[None]).sum(2, dtype=np.int16)
    return (least >= similarity * np.maximum(a, b) - 1e-6) & ((apart <= SKETCH_BITS) | (least < SKETCH_SIZE))


def _joined(classes: np.ndarray) -> np.ndarray:
    """The first row of each row's class."""
    _, first, number = np.unique(classes, return_index=True, return_inverse=True)
    return first[number]


def _candidates(similarity: float):
    """Pairs (class, other) that span the possible pairs of each run, and all of a run of over PIECE rows."""

    def possible(bits, n):
        for at in range(0, len(n), 256):
            rows = np.arange(at, min(at + 256, len(n)))
            a, b = np.nonzero(_alike(bits, n, rows, similarity))
            a = rows[a]
            yield a[a < b], b[a < b]

    def run(batches):
        head = (None, None)  # key and first class of a run that comes in pieces
        for cols, starts, ends, state in sorted_runs(batches, ["key"], PIECE):
            classes, n = cols["class"], cols["n"]
            bits = np.stack([cols[k] for k in _BITS], 1).view(np.uint64)
            pairs_a, pairs_b = [], []
            for s, e in zip(starts, ends):
                if state == "more":
                    head = head if head[0] == cols["key"][s] else (cols["key"][s], classes[s])
                    some = np.unique(classes[s:e])
                    pairs_a.append(some)
                    pairs_b.append(np.full(len(some), head[1]))
                elif classes[s] != classes[e - 1]:
                    a, b, _ = spanning(e - s, possible(bits[s:e], n[s:e]), _joined(classes[s:e]))
                    pairs_a.append(classes[s:e][a])
                    pairs_b.append(classes[s:e][b])
            if pairs_a:
                yield batch(**{"class": pa.array(np.concatenate(pairs_a)), "other": pa.array(np.concatenate(pairs_b))})

    return run


def _common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some sets share, above the diagonal."""
    k = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(k), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    number = np.cumsum(new) - 1
    holders = np.bincount(number)
    few = holders[number] < HOLDERS
    out = np.zeros((k, k), np.int64)
    for step in range(1, min(HOLDERS, k)):
        at = np.flatnonzero(few[:-step] & (number[step:] == number[:-step]))
        if not len(at):
            break
        out += np.bincount(owner[at] * k + owner[at + step], minlength=k * k).reshape(k, k)
    many = np.flatnonzero(holders >= HOLDERS)
    column = np.full(len(holders), -1)
    column[many] = np.arange(len(many))
    at = np.flatnonzero(~few)
    for first in range(0, len(many), 2048):
        some = at[(column[number[at]] >= first) & (column[number[at]] < first + 2048)]
        has = np.zeros((k, min(2048, len(many) - first)), np.float32)
        has[owner[some], column[number[some]] - first] = 1
        out += (has @ has.T).astype(np.int64)
    return np.triu(out, 1)


def _links(similarity: float):
    """(a, b) for each class that pairs in a run link to another: the class and the one of the first such row.

    A run holds one block of a family or two.
    """
    share = Fraction(str(similarity))

    def run(batches):
        for cols, starts, ends, _ in sorted_runs(batches, ["root", "i", "j"], 1 << 62):
            found_a, found_b = [], []
            for s, e in zip(starts, ends):
                classes = cols["class"][s:e]
                if (classes == classes[0]).all():
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in cols["h"][s:e]]
                same, n = _common_counts(sets), np.array([len(x) for x in sets])
                near = (same > 0) & (same * share.denominator >= share.numerator * (n[:, None] + n[None] - same))
                own = _joined(classes)
                part = spanning(e - s, [np.nonzero(near)], own)[2]
                moved = np.flatnonzero((own == np.arange(e - s)) & (part != own))
                found_a.append(classes[moved])
                found_b.append(classes[part[moved]])
            if found_a:
                yield batch(a=pa.array(np.concatenate(found_a)), b=pa.array(np.concatenate(found_b)))

    return run


def _parts():
    """Blocks of a family of sets of n shingles."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))


def _family_links(asked: DataFrame, documents: DataFrame, width: int, similarity: float, star: bool = False) -> DataFrame:
    """Links (a, b) of classes that span the pairs of each family (source, print, root, class, parts) at the similarity.

    A large family is dealt to blocks, and each two of them meet in a task with their whole shingle sets.
    With ``star`` each block meets only the set of the root, the smallest print, so rows are linear but
    pairs between blocks are left; if all classes are prints, each a has one b then, which is no a.
    """
    texts = documents.select(_source(documents).alias("source"), F.coalesce("text", F.lit("")).alias("text"))

    def read(batches):
        rows, size = [], 0
        for b in batches:
            named = [b.column(k).to_pylist() for k in range(4)]
            for root, print_, class_, parts, text in zip(*named, utf8(b.column(4))):
                h = shingles(text, width).tobytes()
                own = print_ % parts
                if star:
                    met = [(k, k) for k in range(parts)] if print_ == root else [(own, own)]
                else:
                    met = [(min(own, k), max(own, k)) for k in range(parts)]
                for i, j in met:
                    rows.append((root, i, j, print_, class_, h))
                    size += len(h)
                    if size > 16 << 20:
                        yield _family_rows(rows)
                        rows, size = [], 0
        if rows:
            yield _family_rows(rows)

    found = texts.join(asked, "source").dropDuplicates(["print"]).select("root", "print", "class", "parts", "text")
    found = found.mapInArrow(tidy(read), "root long, i long, j long, print long, class long, h binary")
    met = found.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "print")
    return checkpointed(met.mapInArrow(tidy(_links(similarity)), "a long, b long"))


def _family_rows(rows: list[tuple]) -> pa.RecordBatch:
    *numbers, h = zip(*rows)
    return batch(**{k: pa.array(x, pa.int64()) for k, x in zip(("root", "i", "j", "print", "class"), numbers)}, h=pa.array(h, pa.binary()))


def _signed_families(sets: DataFrame) -> DataFrame:
    """(source, print, root, class, parts) of the sets in families of two or more; root is the smallest, each set a class.

    A family is what has the same fingerprint b0, or the same smallest one among those that it has a link
    to within RADIUS bits and itself.
    """
    prints = sets.where("n > 0").select("print", "source", "n", F.col("b0").alias("bits"))
    sides = [F.struct(F.col(a).alias("bits"), F.col(b).alias("least")) for a, b in (("bits", "other"), ("other", "bits"))]
    least = near_links(prints, RADIUS).select(F.explode(F.array(*sides)).alias("e")).groupBy("e.bits").agg(F.min("e.least").alias("least"))
    named = prints.join(least, "bits", "left").withColumn("family", F.least("bits", "least")).drop("bits", "least")
    named = checkpointed(named)
    first = named.groupBy("family").agg(F.min("print").alias("root"), F.count("*").alias("rows"), _parts().alias("parts")).where("rows > 1")
    return named.join(first, "family").select("source", "print", "root", F.col("print").alias("class"), "parts")


def _class_families(families: DataFrame, sets: DataFrame) -> DataFrame:
    """(source, print, root, class, parts) of the sets of the classes in ``families`` (class, root)."""
    sized = sets.select("print", "source", "class", "n").join(families, "class")
    large = checkpointed(sized.groupBy("root").agg(_parts().alias("parts")).where("parts > 1"))
    return sized.join(large, "root", "left").select("source", "print", "root", "class", F.coalesce("parts", F.lit(1)).alias("parts"))


def similar_classes(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, source, class_print, component_id), one row for each row of ``documents``.

    Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``similarity`` (above 0); classes are the connected components. Texts of fewer words are one shingle,
    and null and blank texts are one class. component_id is the smallest doc_id of the class, null if it
    has none; source is the hash of the row's text.

    Texts whose SimHashes are within RADIUS bits meet by deletion-variant signatures, as in op1 with more
    and smaller segments. They make up families in which whole shingle sets are compared, so that what
    is linked is linked rightly; the first classes are the linked parts of families.

    A SimHash can't reach all pairs at a similarity, so the pairs between these classes are completed
    exactly. Two linked sets share a shingle among the first n - ceil(similarity * n) + 1 of each in any
    common order, so texts meet by these; an order with frequent shingles last keeps runs short. What
    size and sketch leave possible between two classes makes up families of classes: each run gives links
    that span its possible pairs, and the families are their components, so no link leaves a family.
    Whole shingle sets are compared within families, block by block; only links that join two parts of a
    block leave a task. Comparisons grow with the square of such a family, rows with the square over a
    block's size; a class that meets no other is in none.
    """
    marked = checkpointed(_marked(documents, width, similarity))
    sets = marked.groupBy("print").agg(F.min("source").alias("source"), F.min("doc_id").alias("first_id"), *[F.max(k).alias(k) for k in _BITS], F.max("n").alias("n"))
    sets = checkpointed(sets)
    signed = _family_links(_signed_families(sets), documents, width, similarity, star=True).withColumnRenamed("a", "print")
    sets = checkpointed(sets.join(signed, "print", "left").withColumn("class", F.coalesce("b", "print")).drop("b"))
    prefixes = marked.groupBy("print").agg(F.max("prefix").alias("prefix")).join(sets, "print")
    kinds = f"key long, class long, n long, {_KINDS}"
    keyed = prefixes.select("prefix", "class", "n", *_BITS).mapInArrow(tidy(_keys), kinds)
    met = keyed.repartition("key").sortWithinPartitions("key", "class").mapInArrow(tidy(_candidates(similarity)), "class long, other long")
    families = connected_components(met, "class", "other").withColumnRenamed("node", "class")
    links = _family_links(_class_families(families, sets), documents, width, similarity)
    roots = connected_components(links, "a", "b")
    classed = sets.join(roots.withColumnRenamed("node", "class"), "class", "left").select("print", "first_id", F.coalesce("root", "class").alias("class_print"))
    least = classed.groupBy("class_print").agg(F.min("first_id").alias("component_id"))
    classed = classed.join(checkpointed(least), "class_print").select("print", "class_print", "component_id")
    return marked.select("doc_id", "source", "print").join(checkpointed(classed), "print").select("doc_id", "source", "class_print", "component_id")


def drop_similar(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``documents`` with one row of each class of ``similar_classes``: one of the smallest doc_id.

    Where rows share a doc_id, each class keeps one with its own text; rows without doc_id stay as they
    are, as nothing names them.
    """
    classes = similar_classes(documents, width, similarity)
    kept = classes.where("doc_id = component_id").groupBy("class_print").agg(F.min("component_id").alias("_near_id"), F.min("source").alias("_near_source"))
    named = documents.withColumn("_near_source", _source(documents)).withColumn("_near_id", F.col("doc_id").cast("long"))
    named = named.join(kept.select("_near_id", "_near_source"), ["_near_id", "_near_source"], "left_semi").dropDuplicates(["_near_id", "_near_source"])
    return named.select(*documents.columns).unionByName(documents.where("doc_id is null"))
