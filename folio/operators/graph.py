"""The object graph: reachability, renumbering, de-duplication of assets and what they take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import SPACE
from folio.sources.tables import written

LEAST_SHARED = 64
#: Recompression: least bits and area, and the longest side of each level.
LEAST_BITS, LEAST_AREA = 8, 120 * 120
LONGEST = {"medium": 2000, "strong": 1400}


def renumber(nodes: DataFrame, edges: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Dense ids from 1 in each group of ``nodes``, and the edges under the new ids."""
    ids = nodes.withColumn("new_id", F.row_number().over(Window.partitionBy(group).orderBy("node")).cast("int"))
    a, b = (ids.select(F.col("node").alias(k), F.col("new_id").alias(f"{k}_id"), F.col(group).alias(f"{k}_group")) for k in ("src", "dst"))
    return ids, edges.join(a, "src").join(b, "dst")


def dedupe_assets(assets: DataFrame, same: list[str]) -> DataFrame:
    """``keeper`` for each asset: the least id with the same bytes and attributes, for assets of
    64 bytes or more.  Only digests are shuffled."""
    keyed = assets.select("asset_id", F.sha2(F.col("data").cast("binary"), 256).alias("digest"), F.octet_length("data").alias("bytes"), *same)
    keepers = keyed.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest", "bytes", *same).agg(F.min("asset_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = keyed.join(keepers, ["digest", "bytes", *same], "left")
    return joined.select("asset_id", F.coalesce("keeper", "asset_id").alias("keeper"))


def dedupe_objects(objects: DataFrame, refs: DataFrame, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(object_id, keeper) of ``objects`` (object_id, data and the attributes ``same``), and the references
    (src, slot, dst) of the kept ones, each to a keeper.

    Objects of 64 bytes or more are one if bytes, attributes and references are equal.  Repaired references
    may make containers equal, so rounds go on until none is merged.  An object's references are
    compared by their number and 256 bits of sums and exclusive ors of hashes, so that one
    with very many is not gathered."""
    keyed = objects.select("object_id", F.sha2(F.col("data").cast("binary"), 256).alias("digest"), F.octet_length("data").alias("bytes"), *same)
    keyed = written(keyed, "objects")
    refs = written(refs.select("src", "slot", "dst"), "refs")
    state = keyed.select("object_id", F.col("object_id").alias("keeper"))
    marks = [F.xxhash64(F.lit(i), "slot", "to") for i in range(4)]
    sums = [F.sum(m.cast("decimal(38, 0)")).alias(f"m{i}") for i, m in enumerate(marks[:2])] + [F.bit_xor(m).alias(f"m{i + 2}") for i, m in enumerate(marks[2:])]
    while True:
        to = state.select(F.col("object_id").alias("dst"), F.col("keeper").alias("to"))
        repaired = refs.join(to, "dst", "left").select("src", "slot", F.coalesce("to", "dst").alias("to"))
        signs = repaired.groupBy(F.col("src").alias("object_id")).agg(F.count("*").alias("m"), *sums)
        signed = keyed.join(signs, "object_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("m", "m0", "m1", "m2", "m3")})
        group = ["digest", "bytes", *same, "m", "m0", "m1", "m2", "m3"]
        met = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
        first = signed.where(F.col("bytes") >= LEAST_SHARED).groupBy(*group).agg(F.min("object_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
        joined = signed.alias("a").join(first.alias("b"), met, "left")
        fresh = joined.select("a.object_id", F.coalesce("b.keeper", "a.object_id").alias("keeper"))
        fresh = written(fresh.join(state.withColumnRenamed("keeper", "was"), "object_id"), "keepers")
        changed = not fresh.where("keeper != was").isEmpty()
        state = fresh.drop("was")
        if not changed:
            kept = repaired.join(state.where("object_id != keeper").select(F.col("object_id").alias("src")), "src", "left_anti")
            return state, kept.select("src", "slot", F.col("to").alias("dst"))


def unique_images(uses: DataFrame) -> DataFrame:
    """Images by content with their number of uses, in first-seen order; masks do not count."""
    masks = uses.where("mask_of IS NOT NULL").select(F.col("mask_of").alias("asset_id")).distinct()
    kept = uses.join(masks, "asset_id", "left_anti").where(~F.col("is_mask"))
    found = kept.groupBy("doc_id", "content", "w", "h").agg(F.min("asset_id").alias("first_id"), F.count("*").alias("uses"))
    return found.withColumn("name", F.concat(F.lit("image-"), F.row_number().over(Window.partitionBy("doc_id").orderBy("first_id")).cast("string")))


def hide_small(images: DataFrame, least: int = 48) -> DataFrame:
    return images.where((F.col("w") >= least) & (F.col("h") >= least))


def channel_profile(pixels: DataFrame) -> DataFrame:
    """Whether an image is opaque and grey, and how many channels it needs."""
    seen = pixels.groupBy("image_id").agg(F.bool_and(F.col("a") == 255).alias("opaque"), F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("grey"))
    return seen.withColumn("channels", F.when(F.col("grey"), 1).otherwise(3) + F.when(F.col("opaque"), 0).otherwise(1))


def recompress_plan(images: DataFrame, level: str) -> DataFrame:
    """Images to encode again and the size that they get."""
    masks = images.where("mask_of IS NOT NULL").select(F.col("mask_of").alias("asset_id")).distinct()
    plan = images.join(masks, "asset_id", "left_anti").where(~F.col("is_mask") & (F.col("bits") >= LEAST_BITS) & (F.col("w") * F.col("h") >= LEAST_AREA))
    scale = F.least(F.lit(1.0), LONGEST[level] / F.greatest("w", "h"))
    return plan.select("asset_id", F.greatest(F.lit(1), F.floor(F.col("w") * scale + 0.5)).cast("int").alias("new_w"), F.greatest(F.lit(1), F.floor(F.col("h") * scale + 0.5)).cast("int").alias("new_h"))


def choose_variant(pairs: DataFrame, lossy: bool) -> DataFrame:
    """Replacement only where it is smaller: below 95 % of the old size if it loses detail."""
    take = F.col("new_size") < (F.col("old_size") * 0.95 if lossy else F.col("old_size"))
    return pairs.withColumn("taken", take).withColumn("size", F.when(take, F.col("new_size")).otherwise(F.col("old_size")))


def size_report(chosen: DataFrame, group: str) -> DataFrame:
    """Bytes before and after and percent saved, by group and in all."""
    sums = chosen.rollup(group).agg(F.sum("old_size").alias("before"), F.sum("size").alias("after"), F.count_if("taken").alias("recoded"))
    return sums.withColumn("saved", F.floor((1 - F.col("after") / F.col("before")) * 100 + 0.5).cast("int"))


def preview(texts: DataFrame, images: DataFrame) -> DataFrame:
    """The first 200 characters of a page with white space squeezed, and its largest image."""
    squeezed = texts.select("doc_id", "page_no", F.substring(F.trim(F.regexp_replace("text", f"[{SPACE}]+", " ")), 1, 200).alias("snippet"))
    best = images.groupBy("doc_id", "page_no").agg(F.max_by("asset_id", F.struct(F.col("w") * F.col("h"), -F.col("asset_id"))).alias("asset_id"))
    return squeezed.join(best, ["doc_id", "page_no"], "left")


def has_key(objects: DataFrame, test: Column) -> DataFrame:
    return objects.groupBy("doc_id").agg(F.bool_or(test).alias("found"))
