import random

import corpus_pipeline
from dwell.llm import lines


def slow(rows, run, words):
    windows = lambda ls: [(s, tuple(ls[s : s + k])) for k in range(1, run + 1) for s in range(len(ls) - k + 1) if (sum(len(x.split()) for x in ls[s : s + k]) >= words if k < run else any(x.strip() for x in ls[s : s + k]))]
    first = {}
    for i, t in rows:
        for s, w in windows(t.split("\n")):
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = {}
    for i, t in rows:
        ls = t.split("\n")
        gone = {k for s, w in windows(ls) if first[w] < (i, s) for k in range(s, s + len(w))}
        out[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return out


def test_long_repeats_of_one_or_two_lines_go(spark):
    rng = random.Random(16)
    pool = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=n)) for n in (0, 1, 5, 20, 24, 26, 30, 49, 50, 51, 66, 90)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own{i} {k}" for k in range(rng.randrange(1, 7)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs, 3, 50).collect()}
    expected = slow(rows, 3, 50)
    assert got == expected
    staged = corpus_pipeline.cut_repeated_lines(spark, spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long"), "")
    assert {r.doc_id: (r.text, r.n_chars) for r in staged.collect()} == {i: (t, len(t)) for i, t in expected.items()}
