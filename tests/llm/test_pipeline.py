import random

import corpus_pipeline
from dwell.llm import toxicity
from test_lines_urls_leaks import slow_lines
from test_simhash import slow_components, slow_fingerprint
from test_text_models import check_packing


def test_run_matches_brute_force_stage_by_stage(spark, tmp_path):
    rng = random.Random(9)
    plain, bad = [f"u{k}" for k in range(900)], ["scumlord", "wretch", "vermin"]
    sentence = lambda n: " ".join(rng.choices(plain, k=n))
    items = [(j, sentence(30)) for j in range(6)]
    shared = [sentence(9) for _ in range(3)]
    rows, marks = [], []
    for i in range(220):
        text = [sentence(rng.randrange(4, 30)) for _ in range(rng.randrange(1, 6))]
        toxic = i % 4 == 0
        if toxic:
            text = [t + " " + rng.choice(bad) + " " + rng.choice(bad) for t in text]
        elif i % 7 == 1:
            text[0:0] = shared
        elif i % 11 == 2:
            text.append(rng.choice(items)[1])
        elif i % 13 == 3:
            text = [rows[i - 1][1].replace("\n", " ") + " u1"]
        rows.append((i, "\n".join(text), "en", "s", 0))
        marks.append((i, 1, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), per_class=3000)
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert len(toxic ^ {i for i, _, t in marks if t}) <= 4
    kept = [(r[0], r[1]) for r in rows if r[0] not in toxic]
    kept = [(i, x[0]) for (i, _), x in zip(kept, slow_lines(kept, 3))]
    prints = {i: slow_fingerprint(t) for i, t in kept}
    near = slow_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    kept = [(i, t) for i, t in kept if near[i] == i]
    flat = lambda t: " ".join((t or "").split())
    kept = [(i, t) for i, t in kept if not any(x in flat(t) for _, x in items)]
    pieces = corpus_pipeline.run(spark, folder).collect()
    check_packing(kept, pieces, 2048)

    now = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, folder)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes, name
        now.write.parquet(str(tmp_path / f"stage{n}"))
        now = spark.read.parquet(str(tmp_path / f"stage{n}"))
    assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(kept)
    assert all(r.n_chars == len(r.text) for r in now.where("text is not null").collect())
