"""Row-local operators on streams, and de-duplication within a watermark.

Redaction, searches, metadata changes, links and encryption read one row at a time, so they take
a streaming DataFrame as they take a batch; ``run_available`` is how a job runs them over what
has arrived.  ``dedupe_within`` is the streaming form of asset de-duplication: the first asset
of a digest passes and later ones within the watermark do not; its state is bounded by the
watermark, not by the stream.  ``keepers`` drops nothing: it tells each copy's keeper, whenever it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.columns import PRESETS
from folio.operators.search import redact_text


def redacted(stream: DataFrame, kinds: list[str] | None = None, text: str = "text") -> DataFrame:
    return stream.withColumn(text, redact_text(F.col(text), kinds or list(PRESETS)))


def dedupe_within(stream: DataFrame, at: str, delay: str, data: str = "data") -> DataFrame:
    digest = F.sha2(F.col(data).cast("binary"), 256)
    return stream.withColumn("digest", digest).withWatermark(at, delay).dropDuplicatesWithinWatermark(["digest"])


def keepers(stream: DataFrame, key: str = "asset_id", data: str = "data") -> DataFrame:
    """(``key``, keeper) for every asset of a stream: the first of its bytes, also for a copy that comes late.
    The state is one id for each digest; a batch's assets of a digest are told in order of ``key``."""
    kind = dict(stream.dtypes)[key]

    def told(_, batches, state):
        import pandas as pd

        ids = pd.concat([b[key] for b in batches])
        keeper = state.get[0] if state.exists else int(ids.min())
        state.update((keeper,))
        yield pd.DataFrame({key: ids, "keeper": keeper})

    keyed = stream.select(F.sha2(F.col(data).cast("binary"), 256).alias("digest"), key)
    return keyed.groupBy("digest").applyInPandasWithState(told, f"{key} {kind}, keeper {kind}", f"keeper {kind}", "append", "NoTimeout")


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Runs a transform over what has arrived, into Parquet; exactly once by its checkpoint."""
    query = transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
