import random

import corpus_pipeline
from dwell.llm.near import drop_similar, similar_classes
from test_simhash import frame, slow_components


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def slow_classes(rows):
    sets = {i: slow_set(t) for i, t in rows}
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return slow_components(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])


def edited_texts():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([0, 3, 5, 8, 40, 120]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 1, 5])):
            copy = base[:]
            for _ in range(rng.choice([1, 1, 2, 3])):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            texts.append(" ".join(copy))
    hot = rng.choices(words, k=60)
    texts += [" ".join(hot[:k] + [f"odd{j}"] + hot[k + 1 :]) for j, k in enumerate(rng.choices(range(60), k=50))]
    rng.shuffle(texts)
    return list(enumerate(texts + [None, " \n"], start=3))


def test_stage_matches_brute_force_jaccard(spark, monkeypatch):
    rows = edited_texts()
    expected = slow_classes(rows)
    docs = frame(spark, rows)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, root in expected.items() if i == root}
    # runs that are cut into pieces lose nothing
    monkeypatch.setattr("dwell.llm.near.PIECE", 8)
    assert {r.doc_id: r.component_id for r in similar_classes(docs).collect()} == expected


def test_odd_rows_of_the_stage(spark):
    docs = frame(spark, [(1, "a b c d e f"), (1, "x y z"), (1, "x y z"), (2, "X y z"), (None, "x y z"), (None, None)])
    assert sorted((str(r.doc_id), str(r.text)) for r in drop_similar(docs).collect()) == [("1", "a b c d e f"), ("1", "x y z"), ("None", "None"), ("None", "x y z")]
    assert drop_similar(docs.limit(0)).count() == 0
