import random

import numpy as np
import pyarrow as pa

from dwell.llm import language, leaks, near, packing, toxicity
from test_near import slow_classes
from test_simhash import frame


def plain_chain(scores, trans):
    """P(tag 1) and expected pairs of one chain by the textbook recursions."""
    n = len(scores)
    psi = np.stack([np.ones(n), np.exp(scores)], 1)
    step = np.exp(trans)
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    alpha[0] = psi[0] / psi[0].sum()
    for t in range(1, n):
        alpha[t] = (alpha[t - 1] @ step) * psi[t]
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = step @ (psi[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    both = alpha * beta
    pairs = np.zeros((2, 2))
    for t in range(1, n):
        x = alpha[t - 1][:, None] * step * (psi[t] * beta[t])[None]
        pairs += x / x.sum()
    return both[:, 1] / both.sum(1), pairs


def test_a_chain_reaches_over_the_whole_text(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.array([3, 0, 1000, 1, 64, 65, 257])
    scores, trans = rng.normal(size=sizes.sum()) * 2, rng.normal(size=(2, 2))
    slow_p, slow_pairs, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        if n:
            p, pairs = plain_chain(scores[at : at + n], trans)
            slow_p.append(p)
            slow_pairs += pairs
        at += n
    for block in (64, 7, 1, 5000):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        p, pairs = toxicity._marginals(scores, sizes, trans, pairs=True)
        assert np.allclose(p, np.concatenate(slow_p)) and np.allclose(pairs, slow_pairs)


def test_scores_read_a_long_text_as_one():
    rng = np.random.default_rng(6)
    weights = [rng.normal(size=1 << 8) for _ in range(3)]
    model = toxicity.ToxicityModel(8, *weights, -1.0, rng.normal(size=(2, 2)), np.array([-1.0, 0.5, 1.0, 0.1]))
    words = [f"w{k}" for k in rng.integers(0, 50, 900)]
    text = "  " + " ".join(words) + "\n"
    score, p, first = toxicity._Scorer(model)(pa.array([text, "", "w1"]))
    own, before, after = (np.array([w[list(toxicity._features(x.encode(), 8))].sum() for x in words]) for w in weights)
    scores = -1.0 + own
    scores[1:] += before[:-1]
    scores[:-1] += after[1:]
    slow = plain_chain(scores, model.trans)[0]
    assert first.tolist() == [0, 900, 900, 901] and np.allclose(p[:900], slow)
    signs = np.array([1.0, np.log1p(slow.sum()), slow.max(), np.log1p(900)])
    assert np.isclose(score[0], 1 / (1 + np.exp(-signs @ model.reading))) and np.isclose(score[1], 1 / (1 + np.exp(1.0)))


def test_language_scores_dont_depend_on_slices(monkeypatch):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(3000)), "x" * 9000 + "1" + "y" * 9000, "", None]
    model = language.LanguageModel(("a", "b"), np.log([0.5, 0.5]), np.random.default_rng(1).normal(size=(1 << 16, 2)).astype(np.float32), 16)
    whole = language.score(texts, model)
    assert len(list(language._slices(texts, 1 << 30))) == 1
    monkeypatch.setattr(language, "SLICE", 1 << 14)
    cut = language.score(texts, model)
    assert np.allclose(whole[0], cut[0], atol=1e-3) and (whole[1] == cut[1]).all()
    for most in (1, 10, 1000):
        for i in (0, 1):
            assert "".join(p for run in language._slices(texts, most) for j, p in run if j == i) == texts[i]


def slow_order(scores, sizes, window):
    """The same greedy order, one document at a time, from a matrix of scores."""
    left, order, total = list(range(len(sizes))), [], 0

    def take(d):
        nonlocal total
        order.append(d)
        left.remove(d)
        total += sizes[d]

    while left:
        if total % window == 0:
            take(left[0])
            if total % window == 0:
                continue
        end, seed = -(-total // window) * window, order[-1]
        while total < end and left:
            best = max(left, key=lambda d: (scores[seed][d], -d))
            take(best if scores[seed][best] > 0 else left[0])
    return order


def test_greedy_order_matches_brute_force(monkeypatch):
    rng = random.Random(8)
    lists = [[f"w{min(rng.randrange(90), rng.randrange(90))}".encode() for _ in range(rng.randrange(0, 25))] for _ in range(80)]
    codes = packing.Codes()
    names = sorted({w for x in lists for w in x})
    table = np.zeros(packing.SLOTS, np.uint32)
    for w in names:
        table[codes[w] & (packing.SLOTS - 1)] = sum(w in x for x in lists)
    known = packing.Statistics(len(lists), float(np.mean([len(x) for x in lists])), table)
    term = np.array([names.index(w) for x in lists for w in x])
    first = np.cumsum([0, *map(len, lists)])
    sizes = np.array([rng.randrange(1, 40) for _ in lists])
    for dense in (1, 1000):  # terms as rows of a table, or as postings
        monkeypatch.setattr(packing, "_DENSE", dense)
        index = packing.Index.of(term, first, np.array([codes[w] for w in names]), known)
        scores = np.zeros((80, 80))
        for q in range(80):
            for d in range(80):
                for w in set(lists[q]) & set(lists[d]) if q != d else ():
                    tf, df = lists[d].count(w), table[codes[w] & (packing.SLOTS - 1)]
                    scores[q, d] += np.log1p((80 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(lists[d]) / known.mean))
        for q in range(80):
            found = index.scores(q, np.arange(80) != q)
            assert np.allclose(found, scores[q], atol=1e-4)
        index.scores = lambda q, unused: np.where(unused, scores[q], 0.0)
        assert packing.order_by_neighbours(index, sizes, 64) == slow_order(scores, sizes.tolist(), 64)


def test_word_hashes_follow_the_words(monkeypatch):
    rng = random.Random(9)
    texts = ["", " ", "a", "a\x1cb c", "é日 本\n\tx  "] + [" ".join("".join(rng.choices("abé ", k=9)) for _ in range(50)) for _ in range(20)]
    for block in (packing._BLOCK, 16):
        monkeypatch.setattr(packing, "_BLOCK", block)
        codes, first = packing.word_codes(pa.array(texts).slice(2))
        single = packing.Codes()
        assert [codes[a:b].tolist() for a, b in zip(first, first[1:])] == [[single[w] for w in t.encode().split()] for t in texts[2:]]


def test_large_families_are_compared_block_by_block(spark, monkeypatch):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(300)]
    base = rng.choices(words, k=70)
    rows = []
    for i in range(90):  # copies around the similarity, in several classes
        copy = base[:]
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(70)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "HOLDERS", 3)
    got = {r.doc_id: r.component_id for r in near.similar_classes(frame(spark, rows)).collect()}
    expected = slow_classes(rows)
    assert got == expected and len(set(expected.values())) > 1


def test_edited_passages_around_the_similarity_are_found(spark):
    rng = random.Random(11)
    words = [f"k{n}" for n in range(2000)]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([5, 6, 8, 12, 15, 30, 30, 60])))) for j in range(12)]
    rows = []
    for i in range(100):
        part = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(part))
            part[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
        text = rng.choices(words, k=rng.randrange(0, 40))
        at = rng.randrange(len(text) + 1)
        text[at:at] = part
        rows.append((i, " ".join(text)))
    rows.append((200, items[0][1] + " " + items[0][1]))

    def slow(a, b):
        a, b = a.split(), b.split()
        grams = lambda ws: [tuple(ws[s : s + 5]) for s in range(len(ws) - 4)]
        best = 0.0
        for s in range(max(1, len(a) - len(b) + 1)):
            x, y = grams(a[s : s + len(b)]), grams(b)
            low = sum(min(x.count(g), y.count(g)) for g in set(x))
            best = max(best, low / (len(x) + len(y) - low) if x or y else 0)
        return best

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks.find_leaks(docs, bench).collect()}
    brute = {(i, j): s for i, t in rows for j, x in items if (s := slow(t, x)) >= 0.8}
    assert set(got) == set(brute) and all(abs(got[k] - brute[k]) < 1e-9 for k in got)
    assert min(brute.values()) < 0.9
