import random

import numpy as np
import public_tokenizers

from dwell.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_statistics_cover_all_documents(spark):
    rng = random.Random(14)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(90)], k=rng.randrange(40))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    known = packing.statistics(docs)
    lists = [(t or "").encode().split() for t in texts]
    assert known.n == len(texts) and abs(known.mean - np.mean([len(x) for x in lists])) < 1e-9
    codes = packing.Codes()
    for w in {w for x in lists for w in x}:
        held = sum(w in x for x in lists)
        assert known.frequency[codes[w] & (packing.SLOTS - 1)] == held
    # an index of some documents weighs as one of all does
    few = packing.Index(lists[:20], known).scores(0, np.ones(20, bool))
    assert np.allclose(few, packing.Index(lists).scores(0, np.ones(len(lists), bool))[:20], atol=1e-4)


def test_seeds_reach_related_documents_in_other_partitions(spark):
    rng = random.Random(15)
    themes = [[f"{a}{k}" for k in range(60)] for a in "abcdefgh"]
    rows = [(i, " ".join(rng.choices(themes[i % 8], k=60))) for i in range(320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    size = sum(len(t) for _, t in rows) // 8
    pieces = packing.pack(docs, PATH, window=1024, shard_bytes=size).collect()
    together = {}
    for p in pieces:
        together.setdefault(p.sequence_id, set()).add(p.doc_id)
    pairs = [a % 8 == b % 8 for s in together.values() for a in s for b in s if a < b]
    assert np.mean(pairs) > 0.8
