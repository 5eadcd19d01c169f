"""Row-local operators and de-duplication on streams of files."""

import pytest
from pyspark.sql import functions as F

from folio.operators import graph, meta, place, text
from folio.operators.search import find_pii, redact_text
from folio.streaming import streams


def test_redaction_on_a_stream_equals_the_batch(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    streams.run_available(stream, streams.redacted, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    want = batch.withColumn("text", redact_text(F.col("text"), ["email", "phone", "number"]))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_copies_within_the_watermark_pass_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "data string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.run_available(stream, lambda s: streams.dedupe_within(s, "at", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert sorted(r["data"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


ROW_LOCAL = {
    "find_pii": ("documents", lambda df: find_pii(df, ["email", "phone", "number"])),
    "protect": ("documents", lambda df: meta.unlock(meta.protect(df, "secret"), "secret").drop("cipher")),
    "digests": ("documents", meta.digests),
    "reflow": ("documents", lambda df: df.withColumn("text", text.reflow(text.fold_ligatures(F.col("text"))))),
    "normalise_url": ("pages", lambda df: df.select("page_id", place.normalise_url(F.regexp_replace("url", "^[a-z]+://", "")).alias("url"))),
    "parse_doc_date": ("events", lambda df: df.select("event_id", meta.parse_doc_date(F.date_format("ts", "'D:'yyyyMMddHHmm")).alias("at"))),
}


@pytest.mark.parametrize("name", sorted(ROW_LOCAL))
def test_row_local_operators_on_a_stream_equal_the_batch(spark, data, tmp_path, name):
    table, operator = ROW_LOCAL[name]
    spark.read.parquet(f"{data}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.run_available(stream, operator, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    want = operator(batch)
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_late_copies_are_told_their_keeper(spark, tmp_path):
    rows = [(i, f"asset {i % 7} " * 20 if i % 3 else f"own {i} " * 20) for i in range(60)]
    for part in range(4):
        spark.createDataFrame(rows[part * 15 : part * 15 + 15], "asset_id long, data string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.run_available(stream, streams.keepers, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    want = {r["asset_id"]: r["keeper"] for r in graph.dedupe_assets(batch, []).collect()}
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["asset_id"]: r["keeper"] for r in got} == want and len(got) == 60
