import corpus_pipeline

from . import brute


def test_pipeline(spark, tmp_path):
    """Each stage on its predecessor's rows, against the rules it follows."""
    rows = [r[:5] for r in brute.awkward(3)]
    bench = [(1, " ".join(rows[7][1].split()[:20]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append(docs.collect())
    one, two, three, four, five = seen
    assert all(r["text"] for r in one) and {r["doc_id"] for r in one} >= {r[0] for r in rows[:60]}
    component, _ = brute.classes([(r["doc_id"], r["text"]) for r in one])
    assert len(two) == len({component[i] for i in range(len(one)) if brute.words(one[i]["text"])}) + sum(not brute.words(r["text"]) for r in one)
    bad = {d for d, *_, c in brute.decontaminated([(r["doc_id"], r["text"]) for r in two], bench) if c}
    assert bad and sorted(r["doc_id"] for r in three if r["doc_id"] is not None) == sorted(r["doc_id"] for r in two if r["doc_id"] is not None and r["doc_id"] not in bad)
    assert {r["doc_id"] for r in four} <= {r["doc_id"] for r in three} and len(five) == len(four)
    assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "size"}


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, shard string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_test_data(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("shard NOT BETWEEN 0 AND 39").count() == 0
