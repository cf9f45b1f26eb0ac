import random

import corpus_pipeline
from ledgerlark.llm.shared import stored


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    clean = [prose(rng.randint(60, 200)) for _ in range(40)]
    item = prose(30)
    shared = prose(60)
    near = clean[0].split()
    near[10] = "changed"
    texts = {k: t for k, t in enumerate(clean)} | {100: clean[1], 101: " ".join(near), 102: prose(20), 103: prose(60) + " " + item + " " + prose(60), 104: prose(80) + " " + shared, 105: shared + " " + prose(80), 106: None}
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id: r for r in out}
    assert set(left) == {*range(40), 104, 105}
    assert shared not in left[104].text and shared not in left[105].text and left[104].n_chars == len(left[104].text)
    assert left[5].text == clean[5] and all(r.rate > 0 for r in out)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "suffix_dedup", "decontamination", "mixing"]


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_repeated_ids_and_nulls(spark, tmp_path):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    rows = [(k, text(), "en", f"r{k}", "p", k) for k in range(30)] + [(3, text(), "en", "twice", "p", 1), (None, text(), None, "no id", "p", 2), (50, None, "en", "null", "p", 3), (51, "", "en", "empty", "p", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string, p_clean string, th int")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    done = docs
    for name, stage in corpus_pipeline.STAGES:
        done = stored(stage(spark, done, str(tmp_path)), name)
        if name != "mixing":
            assert done.columns == docs.columns, name
    assert len(set(done.columns)) == len(done.columns) and dict(done.dtypes)["rate"] == "double"
    assert done.count() == 32 and done.where("doc_id = 3").count() == 2 and done.where("doc_id IS NULL").count() == 1
