"""What the operators of this subpackage share: the shared folder, written tables, text batches."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.tables import new_path, shared_dir, written  # noqa: F401

#: Characters that separate words in every contract of this subpackage: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java (and DuckDB) pattern for one word.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of text that a Python task holds at once, unless one text alone is larger.
CHUNK_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps: its cleaner follows the driver's garbage.
    What a plan alone held is garbage of the second round, once the events of its run are through."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts of a column: what numbers of partitions and buckets follow."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long")).alias("n")).first()["n"] or 0


def partitions_for(spark: SparkSession, n_bytes: float, each: int = 32 << 20) -> int:
    """Partitions for so many bytes, at most ``each`` in one: never fewer than a shuffle has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-n_bytes // each)))


def chunks(batch: pa.RecordBatch, texts: tuple[str, ...], most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes in all, one row at least."""
    import numpy as np

    lengths = np.zeros(batch.num_rows, np.int64)
    for text in texts:
        data = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        lengths += pa.compute.fill_null(pa.compute.binary_length(data), 0).to_numpy(zero_copy_only=False)
    ends, held = [], 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            ends.append(i)
            held = 0
        held += n
    start = 0
    for end in [*ends, batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def python_rows(df: DataFrame, function, schema: str, *, text: str | tuple[str, ...] = "text") -> DataFrame:
    """``mapInArrow`` over slices of bounded text: ``function(batches) -> batches``."""
    texts = (text,) if isinstance(text, str) else text

    def run(batches):
        import pyarrow.compute  # noqa: F401

        yield from function(piece for batch in batches for piece in chunks(batch, texts))

    return df.mapInArrow(run, schema)
