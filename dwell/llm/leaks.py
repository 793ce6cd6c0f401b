"""Benchmark passages in documents, by SimHash of item-sized windows and multi-index Hamming blocks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import SPACE_RUN, checkpointed

#: Shingles of an index block that is broadcast; a longer benchmark is searched in several blocks.
BLOCK_SHINGLES = 1_000_000
_LAST = (1 << 63) - 1
_MARKS = ".,;:!?\"'()[]"


def _words(text: Column) -> Column:
    """Lower-case words without punctuation marks."""
    return F.filter(F.split(F.translate(F.lower(text), _MARKS, ""), SPACE_RUN), lambda w: w != "")


def _shingles(words: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words; fewer words: none."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    some = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, some).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """64-bit SimHash of an array column of shingle hashes, each counted as often as it occurs."""
    return F.expr(
        f"""aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(
            2 * aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1 as int)) > size({hashes}),
            shiftleft(1L, b), 0L))"""
    )


def block_variants(radius: int, blocks: int = 8) -> list[int]:
    """Masks that turn one block's bits into all values near enough to meet it.

    Fingerprints within ``radius`` bits agree in some of ``blocks`` blocks up to radius // blocks bits.
    """
    size = 64 // blocks
    return [sum(1 << i for i in on) for n in range(radius // blocks + 1) for on in combinations(range(size), n)]


def find_leaks(documents: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 23, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, print, item_id, start, n_words, distance, similarity): the best window of each item in each document.

    Words are lower case, without punctuation marks, between ASCII white space. A window has as many
    words as an item and any start; a shorter document is one window. It counts if its SimHash is within
    ``radius`` bits of the item's, and the weighted Jaccard similarity of their ``width``-word shingles
    (weight: occurrences) is at least ``similarity``. At a similarity of 0.8 a SimHash differs by 9 bits on
    average with a deviation of 3: 1 in 10,000 of the least similar ones is over 23 bits.

    Windows of n shingles that are at least so similar to an item of that size share
    2 n similarity / (1 + similarity) shingles with it, so windows with fewer shingles of items of the
    size aren't signed; the others are, at every start. Fingerprints meet on 8 blocks of 8 bits, whatever
    the item: within 23 bits, some block differs by at most two, and the index holds each item's blocks
    with all changes of up to two bits. The table of shingles is broadcast up to ``block_shingles``
    entries; a larger benchmark is cut into blocks of that size, each searched over all documents.

    Items of fewer words than ``width`` count as one shingle; items and documents without words, and null
    texts, match nothing. Of windows of equal similarity the first is given. print tells rows apart that
    share a doc_id; equal rows give one result. Null doc_ids and item_ids stay null. Other columns are
    ignored; empty tables give no rows.
    """
    items = benchmark.select("item_id", _words(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"])
    sizes = items.agg(F.array_sort(F.collect_set(F.least(F.size("words"), F.lit(width)))).alias("widths"), F.coalesce(F.sum(F.greatest(F.size("words"), F.lit(1))), F.lit(0)).alias("n")).first()
    found = None
    parts = max(1, -(-sizes.n // block_shingles))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), _words(F.coalesce("text", F.lit(""))).alias("words"))
    for k in sizes.widths or [width]:
        fits = (F.size("words") >= width) if k == width else (F.size("words") == k)
        signed = items.where(fits).select("item", "item_id", F.size("words").alias("n_words"), _shingles(F.col("words"), k).alias("h"))
        # no filter on h, nor one inferred from an explode: pushed down, it would split the text anew for each shingle
        hashed = texts.select("doc_id", "print", _shingles(F.col("words"), k).alias("h"))
        for part in range(parts):
            block = signed if parts == 1 else signed.where(F.pmod("item", F.lit(parts)) == part)
            leaks = _confirm(_windows(hashed, block, similarity), block, similarity, radius)
            found = leaks if found is None else found.unionByName(leaks)
    return found


def _numbered(hashes: str) -> Column:
    """The array with repeated elements told apart by their number, so that it is a set."""
    h = F.col(hashes)
    before = lambda x, i: F.size(F.filter(F.slice(h, 1, i), lambda y: y == x))
    parted = F.transform(h, lambda x, i: F.when(F.array_position(h, x) == i + 1, x).otherwise(F.xxhash64(x, before(x, i))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(parted)


def _windows(hashed: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(window, doc_id, print, size, start, h, bits): the item-sized windows that hold enough shingles of items of their size."""
    index = items.select(F.size("h").alias("size"), F.explode("h").alias("shingle")).distinct()
    probes = hashed.select("doc_id", "print", "h", F.posexplode_outer("h").alias("pos", "shingle"))
    met = probes.join(F.broadcast(index), "shingle")
    held = met.groupBy("doc_id", "print", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"), F.first("h").alias("h"))
    width = F.least(F.col("size"), F.size("h"))
    need = F.ceil((F.col("size") + width) * (similarity / (1 + similarity)) - 1e-6).cast("int")
    held = held.select("*", width.alias("width"), F.greatest(F.lit(1), need).alias("need")).where(F.size("at") >= F.col("need"))
    # starts whose first shingle of an item is the j-th, and that reach over as many more as are needed
    low = lambda j: F.greatest(F.lit(0), F.coalesce(F.get("at", j - 1) + 1, F.lit(0)), F.get("at", j + F.col("need") - 1) - F.col("width") + 1)
    high = lambda j: F.least(F.get("at", j), F.size("h") - F.col("width"))
    runs = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda j: F.struct(low(j).alias("low"), high(j).alias("high")))
    starts = F.flatten(F.transform(F.filter(runs, lambda r: r.low <= r.high), lambda r: F.sequence(r.low, r.high)))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("h", s + 1, F.col("width")).alias("h")))
    windows = held.select("doc_id", "print", "size", F.explode(cut).alias("w")).select("doc_id", "print", "size", "w.start", "w.h")
    return checkpointed(windows.select(F.monotonically_increasing_id().alias("window"), "doc_id", "print", "size", "start", simhash("h").alias("bits"), _numbered("h").alias("h")))


def _confirm(windows: DataFrame, items: DataFrame, similarity: float, radius: int) -> DataFrame:
    """The windows within the radius of an item, then those similar enough, and of them the best."""
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.shiftright("bits", 8 * b).bitwiseAND(F.lit(255)).alias("value")) for b in range(8)])
    marked = items.select("item", "item_id", "n_words", F.size("h").alias("size"), _numbered("h").alias("item_h"), simhash("h").alias("bits"))
    variants = F.array(*[F.lit(v).cast("long") for v in block_variants(radius)])
    index = marked.select("item", "size", F.col("bits").alias("item_bits"), F.explode(blocks).alias("b"))
    index = index.select("item", "size", "item_bits", "b.block", F.explode(F.transform(variants, lambda v: F.col("b.value").bitwiseXOR(v))).alias("value"))
    asked = windows.select("window", "size", "bits", F.explode(blocks).alias("b")).select("window", "size", "bits", "b.block", "b.value")
    apart = F.col("bits").bitwiseXOR(F.col("item_bits"))
    # a pair that meets on several blocks counts on the first one
    first = F.coalesce(*[F.when(F.bit_count(F.shiftright(apart, 8 * b).bitwiseAND(F.lit(255))) <= radius // 8, b) for b in range(8)])
    near = asked.join(index, ["size", "block", "value"]).where((F.bit_count(apart) <= radius) & (first == F.col("block")))
    near = near.select("window", "item", F.bit_count(apart).alias("distance"))
    both = near.join(windows.select("window", "doc_id", "print", "start", "h"), "window").join(marked.select("item", "item_h"), "item")
    same = F.size(F.array_intersect("h", "item_h"))
    alike = both.select("doc_id", "print", "item", "start", "distance", (same / (F.size("h") + F.size("item_h") - same)).alias("similarity"))
    best = alike.where(F.col("similarity") >= similarity).groupBy("doc_id", "print", "item").agg(F.max_by(F.struct("start", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("best"))
    return best.join(marked.select("item", "item_id", "n_words"), "item").select("doc_id", "print", "item_id", F.col("best.start").cast("long").alias("start"), F.col("n_words").cast("long"), F.col("best.distance").cast("long").alias("distance"), F.col("best.similarity").alias("similarity"))


def drop_leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``documents`` without the rows that hold a passage of ``benchmark``; other rows unchanged."""
    found = find_leaks(documents, benchmark, **options).select(F.coalesce("doc_id", F.lit(_LAST)).alias("_leak_doc"), F.col("print").alias("_leak_print")).distinct()
    same = (F.coalesce(documents["doc_id"].cast("long"), F.lit(_LAST)) == F.col("_leak_doc")) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == F.col("_leak_print"))
    return documents.join(found, same, "left_anti")
