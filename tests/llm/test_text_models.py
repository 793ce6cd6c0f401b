import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from dwell.llm import imatch, language, packing, tokens, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "   \n", "x", "123 !!", "a\x1cb\u00a0c <|endoftext|> d'll", "é" * 3000]


def frame(spark, rows, more="lang string"):
    return spark.createDataFrame(rows, f"doc_id long, text string, {more}")


def test_language_matches_a_plain_naive_bayes_and_is_right(spark):
    rng = random.Random(1)
    parts = {"aa": ["ba", "lo", "mi"], "bb": ["sch", "ung", "öt"], "cc": ["que", "ñi", "oz"]}
    rows = [(i, " ".join("".join(rng.choices(parts[n], k=3)) for _ in range(rng.randrange(3, 30))), n) for i, n in enumerate(rng.choices(list(parts), k=150))]
    docs = frame(spark, rows)
    model = language.train(docs.where(~language.held_out()), per_language=1000)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == n and 0 <= got[i].score <= 1 for i, _, n in rows)
    assert model.languages == ("aa", "bb", "cc")
    held = {r.doc_id for r in docs.where(language.held_out()).collect()}
    assert held == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    # the same sums, one n-gram at a time
    for _, text, _ in rows[:10]:
        keys = language.grams([text], model.bits)[0]
        slow = model.log_prior + sum(model.log_prob[k].astype(float) for k in keys)
        assert np.allclose(slow, language.score([text], model)[0][0], atol=1e-3)


def test_language_of_odd_rows(spark):
    rows = [(i, t, "aa") for i, t in enumerate(ODD)] + [(None, "abc", None), (None, None, None)]
    docs = frame(spark, rows)
    model = language.train(docs)
    got = [(r.text, r.lang_pred) for r in docs.join(language.identify(docs, model), "doc_id").collect()]
    assert all((p == "und") == (not any(c.isalpha() for c in t or "")) for t, p in got)
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_word_encoder_equals_whole_text_encoding():
    whole, words = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    rng = random.Random(2)
    alphabet = "abIİß'’sé́ 12.\t\n\u2003\x1c日本<|>"
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)] + ["we're <|startoftext|>x Don'T\n'll"]
    for t in texts:
        assert np.frombuffer(words.encode(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    words, whole = tokens.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for k in range(40):
        text = " ".join(f"w{k * 7 + j}" for j in range(20))
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(words.new) + len(words.old) <= 120


def test_token_histogram_answers_limits(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choices(["the", "tokenizer", "xyzzyq"], k=rng.randrange(400))) for _ in range(60)]
    whole = Tokenizer.from_file(PATH)
    sizes = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts)
    docs = frame(spark, [(None, t, None) for t in texts])
    sums = tokens.suffix_sums(tokens.length_histogram(docs, PATH), stride=16)
    got = {r.n_tokens: r for r in sums.collect()}
    assert sorted(got) == sorted(set(sizes))
    for n, r in got.items():
        assert (r.n_docs, r.docs_from, r.tokens_from, r.docs_to) == (sizes.count(n), sum(s >= n for s in sizes), sum(s for s in sizes if s >= n), sum(s <= n for s in sizes))
        assert r.truncated_tokens == sum(min(s, n) for s in sizes)
    limits = [0, 1, 7, 100, 10**6]
    answers = {r.context: r for r in tokens.at_limits(sums, limits).collect()}
    for c in limits:
        assert (answers[c].total_tokens, answers[c].truncated_tokens, answers[c].docs_cut) == (sum(sizes), sum(min(s, c) for s in sizes), sum(s > c for s in sizes))
    middle = {r.share: r.n_tokens for r in tokens.quantiles(sums, [0.0, 0.5, 1.0]).collect()}
    assert middle == {0.0: sizes[0], 0.5: sizes[-(-len(sizes) // 2) - 1], 1.0: sizes[-1]}
    assert tokens.suffix_sums(tokens.length_histogram(docs.limit(0), PATH)).count() == 0


def test_fingerprints_of_edits(spark):
    rng = random.Random(4)
    words = [f"t{k}" for k in range(400)]
    texts = ODD + [" ".join(rng.choices(words, k=rng.randrange(5, 200))) for _ in range(80)]
    rows = [(3 * i + 1, t, None) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    kept = imatch.lexicon(docs, low=0.02, high=0.5)
    # the lexicon is the band of exact document frequencies
    import xxhash

    seen: dict[bytes, int] = {}
    for _, t, _ in rows:
        for w in imatch.terms((t or "").encode()):
            seen[w] = seen.get(w, 0) + 1
    assert set(kept.tolist()) == {xxhash.xxh64_intdigest(w) for w, n in seen.items() if 0.02 <= n / len(rows) <= 0.5}
    make = imatch.Fingerprinter(kept)
    got = {r.doc_id: r for r in imatch.fingerprint_edits(docs, kept, rows=7).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (i, t, _), (_, u, _) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = make(t.encode()), make(edited.encode()), make(u.encode())
        assert (got[i].n_chars, got[i].fingerprint, got[i].edited_fingerprint) == (len(t), imatch.text_of(a), imatch.text_of(b))
        assert (got[i].near_edited, got[i].near_next) == (imatch.likeness(a, b), imatch.likeness(a, c))
    long = [r for r in got.values() if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 3 * np.mean([r.near_next for r in long])
    odd = frame(spark, [(1, "b", None), (1, "a", None), (None, "c", None), (None, None, None)])
    assert imatch.fingerprint_edits(odd, kept, rows=1).count() == 4
    assert imatch.fingerprint_edits(odd.limit(1), kept).first().near_next == 1.0
    assert imatch.fingerprint_edits(odd.limit(0), imatch.lexicon(odd.limit(0))).count() == 0


def check_packing(rows, pieces, window):
    whole = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc.pop(i), key=lambda p: p.start)
        at = 0
        for p in parts:
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or (at < window and at.bit_count() == 1)


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(5)
    themes = [[f"{a}{k}" for k in range(40)] for a in "abc"]
    texts = ODD + [" ".join(rng.choices(rng.choice(themes), k=rng.randrange(1, 120))) for _ in range(70)]
    rows = list(enumerate(texts))
    docs = frame(spark, [(i, t, None) for i, t in rows])
    for size in (1500, 8 << 20):
        check_packing(rows, packing.with_digest(packing.pack(docs, PATH, window=256, shard_bytes=size)).collect(), 256)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_neighbour_scores_match_brute_force():
    rng = random.Random(6)
    lists = [[f"w{min(rng.randrange(60), rng.randrange(60))}".encode() for _ in range(rng.randrange(0, 30))] for _ in range(50)]
    index = packing.Index(lists)
    mean = np.mean([len(x) for x in lists])
    unused = np.array([rng.random() < 0.7 for _ in lists])
    for q in range(10):
        slow = {}
        for d, words in enumerate(lists):
            total = 0.0
            for w in set(lists[q]):
                tf, df = words.count(w), sum(w in x for x in lists)
                total += np.log1p((len(lists) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if total and unused[d]:
                slow[d] = total
        found = index.scores(q, unused)
        assert set(np.flatnonzero(found).tolist()) == set(slow)
        assert all(abs(found[d] - s) < 1e-4 for d, s in slow.items())


def test_marginals_match_enumeration():
    rng = np.random.default_rng(7)
    n, width = 5, 6
    own, before, after, trans = rng.normal(size=40), rng.normal(size=40), rng.normal(size=40), rng.normal(size=(2, 2))
    first, lengths = np.array([0, 6, 12, 18, 24]), np.array([6, 1, 3, 5, 2])
    p = toxicity._chances(first, lengths, own, before, after, -0.3, trans)
    for c in range(n):
        k, f = lengths[c], first[c]
        scores = [-0.3 + own[f + t] + (before[f + t - 1] if t else 0) + (after[f + t + 1] if t + 1 < k else 0) for t in range(k)]
        total, ones = 0.0, np.zeros(width)
        for tags in np.ndindex(*[2] * k):
            w = np.exp(sum(s * t for s, t in zip(scores, tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            ones[:k] += w * np.array(tags)
        assert np.allclose(p[c], ones / total)


def test_toxicity_learns_held_out_documents(spark):
    rng = random.Random(8)
    plain, bad = [f"word{k}" for k in range(200)], ["Scumbag", "vileness!", "moronic"]
    rows, marks = [], []
    for i in range(500):
        words = rng.choices(plain, k=rng.randrange(10, 150))
        toxic = rng.random() < 0.3
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), None))
        marks.append((i, int(toxic), 1))
    docs = frame(spark, rows)
    labels = spark.createDataFrame(marks + [(None, 1, 0), (7, None, 0), (10**6, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs.where(~toxicity.held_out()), labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    assert held == {i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [got[i].predicted == t for i, t, _ in marks if i in held]
    assert np.mean(right) > 0.97
    texts = dict((i, t) for i, t, _ in rows)
    found = {texts[i][s.begin : s.end].lower().strip("!") for i, t, _ in marks if t for s in got[i].spans}
    assert {"scumbag", "vileness", "moronic"} <= {w.strip("!") for f in found for w in f.split()}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    odd = frame(spark, [(i, t, None) for i, t in enumerate(ODD)] + [(None, None, None)])
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in toxicity.score(odd, model).collect())
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
