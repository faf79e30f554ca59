"""The pipeline against its operators run by hand, stage by stage."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    good, bad = "the quick house stands on many green hills near water and stone".split(), "$$$ click buy!!! free ### win".split()
    line = "this same line stands in a great many of the documents here"
    item = "which of the following statements about distant moons is certainly true"
    rows = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good) + str(rng.randrange(40)) for _ in range(60)) + (f"\n{line}" if i % 5 == 1 else "") + (f"\n{item.upper()}" if i % 11 == 1 else "")) for i in range(200)]
    rows += [(300, rows[2][1]), (301, rows[2][1]), (302, None), (303, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step, tables = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        step = f(spark, step, str(tmp_path))
        step.write.parquet(str(tmp_path / str(k)))
        step = spark.read.parquet(str(tmp_path / str(k)))
        tables.append({(r["doc_id"], r["text"]) if k < 4 else r["doc_id"] for r in step.collect()})
        assert k == 4 or step.columns == docs.columns
    good_ids = {i for i, _ in tables[0]}
    assert not any(i % 4 == 0 for i in good_ids if i < 200) and {1, 2, 3} <= good_ids
    holders = [i for i, t in tables[1] if t and line in t]
    assert holders == [max(i for i, t in tables[0] if t and line in t)]
    left = {i for i, _ in tables[2]}
    assert 2 in left and not {300, 301} & left
    assert {i for i, t in tables[3]} == {i for i, t in tables[2] if item.upper() not in (t or "")}
    assert tables[4] == {i for i, _ in tables[3]}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == tables[4]
