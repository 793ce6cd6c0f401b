import random

from dwell.llm.substrings import drop_repeats


def slow(rows, window):
    """Whether each word goes, from a table of first starts of all windows."""
    first = {}
    lists = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, words in lists:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, words in lists:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (i, s):
                gone[s : s + window] = [True] * window
        out.append((len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return out


def check(spark, rows, window, **sizes):
    frame = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, chunk long, docs binary")
    got = sorted((str(r[0]), *r[1:]) for r in drop_repeats(frame, window, **sizes).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, slow(rows, window)))


def test_matches_brute_force(spark):
    rng = random.Random(3)
    for window, sizes in ((20, {}), (20, {"chunk_bytes": 2000, "bucket_values": 500}), (5, {"chunk_bytes": 3000, "bucket_values": 300})):
        words = [f"v{k}" for k in range(150)] + ["é", " x"]
        passages = [[rng.choice(words) for _ in range(rng.randrange(window - 2, 3 * window))] for _ in range(8)]
        rows = []
        for i in rng.sample(range(1000), 60):
            text = []
            for _ in range(rng.randrange(0, 6)):
                text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(1, 40))]
            rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
        rows += [(2000, rows[0][1]), (2001, "ha " * 70), (2002, "ha " * 19), (2003, None), (2004, "")]
        check(spark, rows, window, **sizes)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(50))
    check(spark, [(1, long), (1, long), (None, long), (None, long), (None, None), (2, "A " + long)], 20)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeats(empty).count() == 0
