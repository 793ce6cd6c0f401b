import random

import numpy as np

from dwell.llm import imatch


def test_near_copies_that_hold_a_third_of_the_rows_are_alike(spark):
    rng = random.Random(12)
    words = [f"t{k}" for k in range(4000)]
    hot = rng.sample([f"hot{k}" for k in range(500)], 80)
    copies = [" ".join(hot[:k] + [odd] + hot[k + 1 :]) for k, odd in ((rng.randrange(80), rng.choice(words)) for _ in range(300))]
    others = [" ".join(rng.choices(words, k=80)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(copies + others)), "doc_id long, text string")
    kept = imatch.lexicon(docs)
    make = imatch.Fingerprinter(kept)
    marks = [make(t.encode()) for t in copies]
    near = [imatch.likeness(a, b) for a, b in zip(marks, marks[1:])]
    assert min(near) > 0.4 and np.mean(near) > 0.7
    assert max(imatch.likeness(a, make(t.encode())) for a, t in zip(marks, others)) < 0.2


def test_near_copies_around_the_share_of_known_terms_stay_alike():
    import xxhash

    rng = random.Random(13)
    known, rare = [f"k{j}" for j in range(40)], [f"r{j}" for j in range(160)]
    make = imatch.Fingerprinter(np.sort(np.array([xxhash.xxh64_intdigest(w.encode()) for w in known], np.uint64)))
    for n in range(2, 40):
        text = known[:n] + rare
        fewer = text[:]
        fewer.remove(rng.choice(known[:n]))
        assert imatch.likeness(make(" ".join(text).encode()), make(" ".join(fewer).encode())) > 0.4, n


def test_short_texts_without_lexicon_terms_dont_collide():
    make = imatch.Fingerprinter(np.empty(0, np.uint64))
    for n in (1, 2):
        marks = {make(" ".join(f"x{i}_{k}" for k in range(n)).encode()) for i in range(100_000)}
        assert len(marks) == 100_000
    assert make(b"") == make(b" ") and sum(map(bool, make(b""))) == imatch.LEAST
    assert imatch.likeness(make(b"x1"), make(b"x2")) == 0.0
