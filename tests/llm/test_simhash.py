import random
import re

import xxhash
from pyspark.sql import functions as F

from dwell.llm.components import connected_components
from dwell.llm.simhash import drop_near_duplicates, near_duplicate_classes, near_links

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], DOCS)


def test_classes_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}é" for k in range(300)]
    texts = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 2])):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            texts.append("\t".join(copy))
    texts += [None, "", " \n", "A B", "a  b"]
    rows = list(enumerate(texts, start=10))
    prints = {i: slow_fingerprint(t) for i, t in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = slow_components(prints, linked)
    got = {r.doc_id: r for r in near_duplicate_classes(frame(spark, rows)).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == expected


def test_long_runs_lose_no_link(spark):
    rng = random.Random(6)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5, 7]))) for _ in range(250)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed], "bits long")
    expected = slow_components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    for most in (8, 4096):
        links = near_links(rows, 3, most)
        assert all((((r.bits ^ r.other) & (2**64 - 1)).bit_count() <= 3) for r in links.collect())
        got = {r.node: r.root for r in connected_components(links, "bits", "other").collect()}
        assert {v: got.get(v, v) for v in signed} == expected


def test_components_of_a_long_chain_and_of_nothing(spark):
    order = random.Random(1).sample(range(400), 400)
    chain = spark.createDataFrame(list(zip(order, order[1:])) + [(7, 7), (1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in connected_components(chain.repartition(7), "a", "b").collect()}
    assert got == {n: 0 for n in range(400)} | {1000: 1000, 1001: 1000}
    assert connected_components(chain.where("a < 0"), "a", "b").count() == 0


def test_odd_rows(spark):
    rows = frame(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (2, "a b c d"), (None, None)])
    rows = rows.withColumn("bits", F.lit("clash")).withColumn("component_id", F.lit(0)).withColumn("node", F.lit(1))
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicate_classes(rows).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "1"), ("None", "None"), ("None", "None")]
    kept = drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None", "None", "None"]
    assert near_duplicate_classes(rows.limit(0)).count() == 0
