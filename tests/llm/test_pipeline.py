"""The pipeline against its stages' own checks on a small table."""

import corpus_pipeline as p
from folio.llm.neardup import alike


def test_each_stage_on_its_input(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in p.STAGES:
        out = stage(spark, docs, data)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs, before = spark.read.parquet(path), docs
        seen.append((name, docs.count()))
        if name != "bpe":
            assert sorted(docs.columns) == sorted(columns)
        if name == "near_duplicates":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            kept = {r["doc_id"] for r in docs.collect()}
            for i in set(texts) - kept:
                assert any(texts[i] == texts[k] or alike(texts[i], texts[k]) for k in kept)
            assert len({texts[i] for i in kept}) == len(kept)
        if name == "personal_data":
            assert docs.where("text LIKE '%@mail%.example.com%'").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    counts = dict(seen)
    assert counts["near_duplicates"] < counts["language_id"] and counts["bpe"] == counts["mixing"] and counts["personal_data"] == counts["near_duplicates"]


def test_odd_rows_pass(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the of and to be with this that was for " * 9, "en", None, 1), (3, "the of and to be with this that was for " * 9, "en", None, 1), (None, "der die und das ist mit von ein eine nicht " * 9, "de", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() >= 1


def test_an_empty_table_passes(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
