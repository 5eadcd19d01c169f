"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's words, in shuffled order of its documents, are cut into blocks of equal size (to a
word), ``BLOCK`` words or fewer, so a source of a few words has blocks of its own size.  A source
gets as many slots as blocks make up its target; the last one may take a part of its block.
Slots are placed by the points of a golden-ratio lattice: with M slots in all and g, prime to M,
next to M over the golden ratio, slot i has the point i * g mod M, and the cumulative numbers of
slots say whose it is.  The map is one to one, so every source gets all its slots, spread evenly.
It is read backwards: each place of the cumulative scale gives its slot, and no table of sources
is searched.  Slots are ranked for each source in slot order; rank r takes block r modulo the
number of the source's blocks, so blocks repeat only after all have been taken.

Only numbers are shuffled, never texts.  Documents of one id and size are one group with a count
until they are placed; ranks and places come from sums over spans whose number follows the rows,
so no task gets a source whole, and no source needs to fit anywhere.  The table of sources is
sorted by one task: weights are given by source, so it is as long as the recipe.

Cases: a null text has size 0 and is never taken; a null source is a source of its own, last
in order; sources without words get the target 0; repeated rows and equal ids are taken as
separate rows, ties in the shuffle in the order of id and size; texts of any length may spread
over many blocks; only the columns named are read, whatever the others are called; an empty
table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import load, n_words, written

#: Weights by rank of a source in code-point order, repeating, and repeats allowed of a document.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Words of a block at most; rows (about) of a span of the shuffled order, slots of a span of time.
BLOCK, SPAN_ROWS, SPAN_SLOTS = 1024, 1 << 15, 1 << 16
#: Slots of one schedule, so that products of slots fit in 64 bits (5 * 10**14 words at ``BLOCK``).
MOST_SLOTS = 1 << 39
GOLDEN = (math.sqrt(5) - 1) / 2


def with_targets(sources: DataFrame, weights=WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: each weight's part of all words, held at
    ``repeats`` times the source's size, with what is over shared again among the rest."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights))
    rows = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    # by the level at which each source fills up: all that fill below the common level are full
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, every = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    rows = rows.withColumn("level", left / open_weight).withColumn("open", F.col("most") > F.col("level") * F.col("weight")).withColumn("place", F.row_number().over(by_level))
    common = F.min_by("level", F.when(F.col("open"), F.col("place"))).over(every)
    rows = rows.withColumn("common", common).withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("most").cast("double"))))
    return rows.select("source", "source_size", "target")


def with_slots(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sources`` with numbers of blocks and slots: ``long`` of the blocks have ``words`` + 1 words,
    the others ``words``; the last slot takes the first ``last`` words of its block."""
    rows = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    rows = rows.withColumn("wanted", F.when(F.col("source_size") > 0, F.round("target")).otherwise(0).cast("long"))
    rows = rows.withColumn("blocks", F.greatest(F.expr(f"(source_size + {block - 1}) div {block}"), F.lit(1)))
    rows = rows.withColumns({"words": F.expr("source_size div blocks"), "long": F.expr("source_size % blocks")})
    rows = rows.withColumns({"rounds": F.expr("wanted div greatest(source_size, 1)"), "over": F.expr("wanted % greatest(source_size, 1)")})
    last = block_of(F.col("over") - 1)
    slots = F.when(F.col("over") > 0, F.col("rounds") * F.col("blocks") + last + 1).otherwise(F.coalesce(F.col("rounds") * F.col("blocks"), F.lit(0)))
    rows = rows.withColumns({"slots": slots.cast("long"), "last": F.when(F.col("over") > 0, F.col("over") - begin_of(last))})
    before = F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("first_slot", F.coalesce(before, F.lit(0))).drop("wanted", "rounds", "over")


def block_of(position: Column) -> Column:
    """The block of a word of a source."""
    edge = F.col("long") * (F.col("words") + 1)
    return F.when(position < edge, F.floor(position / (F.col("words") + 1))).otherwise(F.col("long") + F.floor((position - edge) / F.greatest("words", F.lit(1)))).cast("long")


def begin_of(block: Column) -> Column:
    return (block * F.col("words") + F.least(block, F.col("long"))).cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, source_no, rank, block, part): which block of which source each slot takes, and how
    many words of it if not all; slots are numbered from 0 in the order of the mix."""
    total = sources.agg(F.sum("slots")).first()[0] or 1
    if total > MOST_SLOTS:
        raise ValueError(f"a schedule has at most {MOST_SLOTS} slots: take longer blocks")
    step = max(1, round(total * GOLDEN))
    while math.gcd(step, total) > 1:
        step += 1
    back = pow(step, -1, total) if total > 1 else 0
    heads = sources.where("slots > 0").select("source_no", "blocks", "slots", "last", "first_slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1, F.lit(SPAN_SLOTS).cast("long"))).alias("head"))
    heads = heads.repartition(sources.sparkSession.sparkContext.defaultParallelism, "source_no", "head")
    places = heads.withColumn("place", F.explode(F.sequence("head", F.least(F.col("head") + SPAN_SLOTS, F.col("slots")) - 1))).withColumn("place", F.col("place") + F.col("first_slot"))
    # place * back mod total, in two steps that fit in 64 bits
    slot = F.expr(f"((shiftright(place, 16) * {back}L % {total}L) * 65536L + (place & 65535L) * {back}L) % {total}L")
    slots = places.select("source_no", "blocks", "slots", "last", slot.alias("slot")).withColumn("time", F.expr(f"slot div {SPAN_SLOTS}L"))
    ends = slots.groupBy("source_no", "time").agg(F.count("*").alias("n"))
    ends = ends.select("source_no", "time", (F.sum("n").over(Window.partitionBy("source_no").orderBy("time")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("source_no", "time").orderBy("slot")) - 1
    ranked = slots.withColumn("within", within).join(ends, ["source_no", "time"]).withColumn("rank", F.col("before") + F.col("within"))
    part = F.when(F.col("rank") == F.col("slots") - 1, F.col("last"))
    return ranked.select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block"), part.alias("part"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, repeats: int = MOST_REPEATS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row for each document: its key, source, ``size``, ``source_size``, ``target``, the number of
    its words that the mix takes (``taken``) and the first slot of the schedule that takes some of them
    (``slot``, null if none does): the mix in order of its slots is the mix in order of ``slot``."""
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    groups = written(sized.groupBy("source", "key", "size").agg(F.count("*").alias("n")), "mix-sizes")
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = written(with_slots(with_targets(sources, weights, repeats), block), "mix-sources")
    spans = max(1, groups.count() // SPAN_ROWS)
    placed = groups.withColumn("at", F.xxhash64(F.lit(seed), F.col("key"), F.col("size"))).join(sources.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    placed = placed.withColumn("span", F.floor((F.col("at") / 2.0**64 + 0.5) * spans))

    # where each group begins in its source's shuffled words: earlier spans, then its own
    ends = placed.groupBy("source_no", "span").agg(F.sum(F.col("size") * F.col("n")).alias("sum"))
    ends = ends.select("source_no", "span", (F.sum("sum").over(Window.partitionBy("source_no").orderBy("span")) - F.col("sum")).alias("before"))
    own = Window.partitionBy("source_no", "span").orderBy("at", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("within", F.sum(F.col("size") * F.col("n")).over(own) - F.col("size") * F.col("n")).join(ends, ["source_no", "span"])
    rows = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("start", F.col("before") + F.col("within") + F.col("nth") * F.col("size"))
    none = rows.where("size = 0").select("key", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("slot"))

    # words of each document in each block, times the slots of the block
    first, last = block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1)
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = begin_of(F.col("block"))
    low = F.greatest(F.col("start"), begin) - begin
    high = F.least(F.col("start") + F.col("size"), begin_of(F.col("block") + 1)) - begin
    cut = cut.select("key", "source", "size", "source_size", "target", "source_no", "start", "block", low.alias("low"), high.alias("high"))
    whole, partly = F.col("part").isNull(), F.col("part").isNotNull()
    uses = schedule(sources).groupBy("source_no", "block").agg(F.sum(whole.cast("long")).alias("whole"), F.max("part").alias("part"), F.min(F.when(whole, F.col("slot"))).alias("whole_at"), F.min(F.when(partly, F.col("slot"))).alias("part_at"))
    met = cut.join(uses, ["source_no", "block"], "left")
    words = F.coalesce("whole", F.lit(0)) * (F.col("high") - F.col("low")) + F.greatest(F.least(F.coalesce("part", F.lit(0)), F.col("high")) - F.col("low"), F.lit(0))
    at = F.least("whole_at", F.when(F.col("part") > F.col("low"), F.col("part_at")))
    taken = met.groupBy("source_no", "start").agg(*[F.first(c).alias(c) for c in ("key", "source", "size", "source_size", "target")], F.sum(words).cast("long").alias("taken"), F.min(at).alias("slot"))
    found = taken.select("key", "source", "size", "source_size", "target", "taken", "slot").union(none)
    return found.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken", "slot")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("slot").alias("first_slot"))
