import random
from collections import Counter

import numpy as np
from dwell.llm import near
from dwell.llm.simhash import near_links
from test_near import edited_texts, slow_classes, slow_set
from test_simhash import frame, slow_components


def test_links_at_seven_bits_match_brute_force(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(10))) for _ in range(rng.choice([1, 2, 5, 60]))}
    near_pairs = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 7]
    expected = slow_components(values, near_pairs)
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "bits long")
    for most in (4096, 4):
        links = [(r.bits % (1 << 64), r.other % (1 << 64)) for r in near_links(rows, 7, most).collect()]
        assert all((a ^ b).bit_count() <= 7 for a, b in links)
        assert slow_components(values, links) == expected


def test_signatures_alone_settle_what_is_within_their_radius(spark, monkeypatch):
    rows = edited_texts()
    sets = {i: slow_set(t) for i, t in rows}
    prints = {i: near._sketch(near.shingles(t.encode(), 5))[0] % (1 << 64) for i, t in rows if sets[i]}
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 7]
    alike = [(a, b) for a, b in close if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    families, whole = slow_components(prints, close), slow_classes(rows)
    monkeypatch.setattr(near, "_candidates", lambda similarity: lambda batches: iter(()))
    found = {r.doc_id: r.component_id for r in near.similar_classes(frame(spark, rows)).collect()}
    assert all(whole[i] == whole[found[i]] for i in prints)
    size = Counter(root for _, root in {(prints[i], root) for i, root in families.items()})
    sure = [(a, b) for a, b in alike if size[families[a]] < 3]
    assert all(found[a] == found[b] for a, b in sure)
    assert sum(sets[a] != sets[b] for a, b in sure) > 3
    assert len(set(found.values())) < len({frozenset(x) for x in sets.values()}) - 20


def test_pairs_between_blocks_of_a_signed_family_are_completed(spark, monkeypatch):
    rows = edited_texts()
    monkeypatch.setattr(near, "BLOCK", 4)
    found = near.similar_classes(frame(spark, rows))
    assert {r.doc_id: r.component_id for r in found.collect()} == slow_classes(rows)


def test_rows_of_one_class_are_no_candidates():
    bits = np.zeros(3, np.int64)
    cols = {"key": np.full(3, 5), "class": np.array([1, 1, 2]), "n": np.full(3, 40), **{k: bits for k in near._BITS}}
    run = near._candidates(0.8)
    pairs = [b.to_pydict() for b in run([near.batch(**cols)])]
    assert pairs == [{"class": [1], "other": [2]}] or pairs == [{"class": [2], "other": [1]}]
    assert [b.num_rows for b in run([near.batch(**{**cols, "class": np.ones(3, np.int64)})])] in ([], [0])
