import random

from dwell.llm import leaks, lines, urls
from dwell.llm.leaks import find_leaks


def slow_lines(rows, run):
    last = 2**63 - 1
    lists = [(last if i is None else i, t.split("\n") if t else []) for i, t in rows]
    first = {}
    windows = lambda ls: [(s, tuple(ls[s : s + run])) for s in range(len(ls) - run + 1) if any(x.strip(" \t\r\x0b\x0c") for x in ls[s : s + run])]
    for i, ls in lists:
        for s, w in windows(ls):
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for (i, ls), (_, t) in zip(lists, rows):
        gone = {k for s, w in windows(ls) if first[w] < (i, s) for k in range(s, s + run)}
        out.append((t if not gone else "\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone)))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in rng.sample(range(500), 90):
        rows.append((i, rng.choice(["\n", "\n", "\r\n"]).join(rng.choice(["a", "b", "c", "", " "]) + rng.choice(["", "", str(rng.randrange(3))]) for _ in range(rng.randrange(0, 14)))))
    rows += [(600, None), (601, ""), (602, "\n" * 9), (602, "a\nb\nc\nd"), (None, "a\nb\nc\nd"), (None, "a\nb\nc\nd"), (603, "é\n" * 500)]
    docs = spark.createDataFrame([(i, t, "x", 0, "p") for i, t in rows], "doc_id long, text string, `print` string, n_lines int, gone string")
    for run in (2, 3):
        got = sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_removed) for r in lines.drop_repeated_lines(docs, run).collect())
        assert got == sorted((str(i), str(x[0]), x[1], x[2]) for (i, _), x in zip(rows, slow_lines(rows, run)))
    assert lines.drop_repeated_lines(docs.limit(0), 3).count() == 0


def slow_url(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fits = [(len(h + p), h + p, v == "block", v) for v, h, p in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[3]) if fits else (host, path, None, default)


def test_urls_match_brute_force(spark):
    rng = random.Random(2)
    hosts = ["org", "a.org", "EXAMPLE.org", "x.example.ORG", "example.org.", "notexample.org", "com", "q.com", "", "É.com", "org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a", "/de/", "/de/?", "?x", "#y", "/en/#/en/1", "//", "/fr//?://org/"]
    pages = [(i, rng.choice(["http://", "https://", "", "ftp://u@", "x://y://"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(300)]
    pages += [(None, None), (None, ""), (5, "://"), (5, "http://example.org/en/1" + "a" * 5000)]
    frame = spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, host string")
    rules = urls.RULES + [("block", "org", "/"), ("allow", "q.com", "")]
    table = spark.createDataFrame(rules + [(None, "com", "/"), ("block", None, "/"), ("block", "", "/")], "verdict string, host string, path string")
    got = sorted(map(str, (tuple(r) for r in urls.judge_urls(frame, table).collect())))
    assert got == sorted(str((i, *slow_url(u, rules, "allow"))) for i, u in pages)
    bare = urls.judge_urls(frame, table.limit(0), default="block")
    assert {(r.rule, r.verdict) for r in bare.collect()} == {(None, "block")}
    assert urls.judge_urls(frame.limit(0), table).count() == 0


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(3)
    words = [f"k{n}" for n in range(3000)]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([3, 5, 20, 45, 80])))) for j in range(25)]
    rows, expected = [], set()
    for i in range(120):
        text = rng.choices(words, k=rng.randrange(0, 150))
        if i % 3 == 0:
            j, passage = rng.choice(items)
            part = passage.split()
            if len(part) > 60 and i % 2:
                part[len(part) // 2] = "changed"  # 5 of 76 shingles: similarity 0.88
            text[len(text) // 2 : len(text) // 2] = [w.upper() if i % 2 else w + "," for w in part]
            expected.add((i, j))
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (502, items[3][1][:10])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item int")
    bench = spark.createDataFrame(items + [(90, None), (91, " "), (None, items[0][1])], "item_id long, text string")

    def slow(text, item):
        """The best similarity over all item-sized windows."""
        clean = lambda t: [w for w in t.lower().replace(",", "").split() if w]
        a, b = clean(text or ""), clean(item)
        k = min(5, len(b))
        grams = lambda ws: [tuple(ws[s : s + k]) for s in range(len(ws) - k + 1)]
        best = 0.0
        for s in range(max(1, len(a) - len(b) + 1)):
            x, y = grams(a[s : s + len(b)]), grams(b)
            low = sum(min(x.count(g), y.count(g)) for g in set(x))
            best = max(best, low / (len(x) + len(y) - low) if x or y else 0)
        return best

    for options in ({}, {"block_shingles": 300}):
        got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(docs, bench, **options).where("item_id is not null").collect()}
        brute = {(i, j): s for i, t in rows for j, x in items if (s := slow(t, x)) >= 0.8}
        assert set(got) == set(brute) >= expected
        assert all(abs(got[k] - brute[k]) < 1e-9 for k in got)
    kept = leaks.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in brute}
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, items[2][1]), (None, items[2][1]), (1, "clean words only")], "doc_id long, text string")
    assert [r.doc_id for r in leaks.drop_leaks(twice, bench).collect()] == [1]


def test_hamming_blocks_miss_nothing_within_the_radius():
    rng = random.Random(4)
    masks = set(leaks.block_variants(19))
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(20)))
        assert any((diff >> 8 * k) & 255 in masks for k in range(8))
