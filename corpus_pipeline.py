"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's input.

Cases, for every stage: a null or empty text has no language and goes with the first stage; the
later ones take it as empty.  Very long texts are read whole.  Repeated rows and equal ids are
separate rows until the near duplicates leave one of each text; ties go to the least id, null ids
last.  Columns other than those of ``documents`` are not carried on, whatever their names.  An
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.bpe import encode_decode, tokenizer_file
from folio.llm.common import written
from folio.llm.langid import UNKNOWN, fit, fold, identify
from folio.llm.mixing import mix
from folio.llm.neardup import keep_one
from folio.llm.pii import find_pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Part of a document's letters, weighted by confidence, that its language must have.
LEAST_SCORE = 0.34


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or in which none has a third of the letters, go; the others stay as they are."""
    found = identify(docs.select(*COLUMNS), fit(docs.where(fold() != 0)))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least id."""
    return keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; ``n_chars`` is counted again."""
    found = find_pii(docs.select(*COLUMNS)).withColumn("text", F.when(F.col("text").isNotNull(), F.col("sanitised")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number, in the order of the mix's slots."""
    none = F.lit(-(1 << 63))
    taken = mix(docs).withColumn("copies", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
    copies = taken.groupBy(F.coalesce("doc_id", none).alias("__id")).agg(F.round(F.avg("copies")).cast("int").alias("copies"), F.min("slot").alias("__slot")).where("copies > 0")
    rows = docs.select(*COLUMNS, F.coalesce("doc_id", none).alias("__id")).join(copies, "__id")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).orderBy("__copy", "__slot", "__id").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; the decoded text shows what a reader of the ids gets."""
    found = encode_decode(docs.select(*COLUMNS), tokenizer_file())
    return found.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixture),
    ("bpe", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
