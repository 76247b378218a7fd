"""The corpus pipeline: every stage takes effect on what the one before it kept."""

import corpus_pipeline
from gridlake.llm import decontaminate, ngram_join

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        kept[name] = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept[name] <= before
        if name != "packing":
            assert after.columns == columns and kept[name] < before
        else:
            assert kept[name] == before
        if name == "toxicity":
            gone = {r.doc_id for r in labels.where("toxic = 1").collect()} - kept[name]
            assert len(gone) >= 0.7 * labels.where("toxic = 1").count()
        if name == "near_duplicates":
            assert ngram_join.components(after, 5, 80).where("doc_id <> component_id").count() == 0
        if name == "decontamination":
            assert decontaminate.annotate(after, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        docs = after


def test_stages_on_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if name == "packing" else spark.createDataFrame([], docs.schema)


def test_stages_on_nulls_and_repeated_rows(spark, tmp_path):
    """Labels teach that "vile" is toxic and "junk" poor; nulls, repeats, ties and clashing columns come through."""
    say = lambda i, n=40: " ".join(f"w{(i * 37 + j * j) % 900}" for j in range(n))
    texts = [(i, say(i) + (" vile words vile" if i % 5 == 0 else " junk junk junk junk" if i % 5 == 1 else "")) for i in range(200)]
    odd = [(1000, None), (1001, ""), (None, say(7000)), (None, None), (1002, say(8000)), (1002, say(8000)), (1003, say(8000)), (1004, say(9000) + " bench one two three four five six seven eight nine ten")]
    rows = [(i, t, "en", "s", 1.0, "x", "y") for i, t in texts + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, items string, _v string").repartition(4)
    spark.createDataFrame([(i, int(i % 5 != 1), int(i % 5 == 0)) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "bench one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=str)
        assert docs.columns == ["doc_id", "text", "lang", "source", "score", "items", "_v"]
    count = lambda name, *ids: [kept[name].count(i) for i in ids]
    assert sum(i is not None and i < 200 and i % 5 == 0 for i in kept["toxicity"]) <= 2 and count("toxicity", 1002, 1003, 1001, None) == [2, 1, 1, 2]
    assert sum(i is not None and i < 200 and i % 5 == 1 for i in kept["quality"]) <= 2
    assert count("near_duplicates", 1002, 1003) == [1, 0] and count("decontamination", 1004) == [0]
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in packed), key=str) == kept["decontamination"]
