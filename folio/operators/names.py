"""Unique names in order of arrival, worked out for whole sets of names at once.

The second of a name takes the first free of ``name_2``, ``name_3`` and so on.  A free number of
a stem is one that no earlier choice of the stem took and no arrived input owns.  An input ``name_k``
owns its name if it comes before the stem gets that far: if ``s`` inputs with lower numbers own theirs
and ``j`` choices were made before it came, the stem had passed ``k`` unless ``s <= k - 2 - j``.  So who
owns what is a running count, the ``j``-th choice is the ``j``-th number that nobody owns, and
only names with two numbers at their end wait for those with one.

Running counts are made in spans: a stem that holds most of the rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.tables import written

#: Places in the order that one task counts through.
SPAN = 1 << 16


def counted_before(rows: DataFrame, groups: list[str], at: str, value: Column, out: str, tie: str | None = None) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over the rows of the group before it in order of ``at``."""
    dealt = rows.withColumns({"__value": value.cast("long"), "__span": F.floor(F.col(at) / SPAN)})
    ends = dealt.groupBy(*groups, "__span").agg(F.sum("__value").alias("__sum"))
    ends = ends.select(*groups, "__span", (F.sum("__sum").over(Window.partitionBy(*groups).orderBy("__span")) - F.col("__sum")).alias("__before"))
    order = Window.partitionBy(*groups, "__span").orderBy(at, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.withColumn("__within", F.coalesce(F.sum("__value").over(order), F.lit(0))).join(ends, [*groups, "__span"])
    return met.withColumn(out, F.col("__before") + F.col("__within")).drop("__value", "__span", "__within", "__before")


def arrivals(fields: DataFrame) -> DataFrame:
    """``arrival``: the place of each field in its output, by document and node."""
    sizes = fields.groupBy("out_id", "doc_id").agg(F.count("*").alias("__n"))
    first = sizes.select("out_id", "doc_id", (F.sum("__n").over(Window.partitionBy("out_id").orderBy("doc_id")) - F.col("__n")).alias("__first"))
    own = F.row_number().over(Window.partitionBy("out_id", "doc_id").orderBy("node_id"))
    return fields.withColumn("__own", own).join(first, ["out_id", "doc_id"]).withColumn("arrival", F.col("__first") + F.col("__own")).drop("__first", "__own")


def owners(kids: DataFrame) -> DataFrame:
    """``kids`` (out_id, stem, k, passed) with ``own``: whether the input owns its name, and ``below``, how many of
    its stem with lower numbers do.  Guesses from above and below close in on the answer; each pass settles
    more of the low numbers, and a pass that changes nothing is the answer."""
    room = F.col("k") - 2 - F.col("passed")
    guess = written(kids.withColumn("own", room >= 0).withColumn("below", F.lit(0).cast("long")), "owners")
    while True:
        again = counted_before(guess.drop("below"), ["out_id", "stem"], "k", F.col("own").cast("int"), "below")
        guess = written(again.withColumn("was", F.col("own")).withColumn("own", F.col("below") <= room), "owners")
        if guess.where("own != was").isEmpty():
            return guess.drop("was")
        guess = guess.drop("was")


def dedupe_names(fields: DataFrame) -> DataFrame:
    """(out_id, node_id, name) for ``fields`` (out_id, arrival, node_id, t), as a walk in order of arrival names them."""
    rows = fields.select("out_id", F.col("arrival").cast("long").alias("arrival"), "node_id", "t")
    number = F.try_to_number(F.regexp_extract("t", r"(?s)^.*_([1-9][0-9]{0,17})$", 1), F.lit("9" * 18)).cast("long")
    heads = rows.groupBy("out_id", "t").agg(F.min("arrival").alias("first"), F.count("*").alias("n"))
    heads = written(heads.withColumn("k", number).withColumn("stem", F.when(F.col("k") >= 2, F.regexp_extract("t", r"(?s)^(.*)_[0-9]+$", 1))), "names")
    parents = heads.select("out_id", F.col("t").alias("stem"))
    level = heads.join(parents, ["out_id", "stem"], "left_anti").withColumn("own", F.lit(True))
    found = None
    while True:
        level = written(level.select("out_id", "t", "first", "n", "own"), "names")
        if level.isEmpty():
            return found if found is not None else rows.select("out_id", "node_id", F.col("t").alias("name"))
        takes_own = F.col("own") & (F.col("arrival") == F.col("first"))
        here = rows.join(level, ["out_id", "t"]).withColumn("takes_own", takes_own)
        named = here.where("takes_own").select("out_id", "node_id", F.col("t").alias("name"))
        chosen = here.where("NOT takes_own").select("out_id", F.col("t").alias("stem"), "arrival", "node_id")
        chosen = written(counted_before(chosen, ["out_id", "stem"], "arrival", F.lit(1), "j").withColumn("j", F.col("j") + 1), "names")
        kids = heads.join(level.select("out_id", F.col("t").alias("stem")), ["out_id", "stem"])
        events = chosen.select("out_id", "stem", F.col("arrival").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("k"))
        events = events.unionByName(kids.select("out_id", "stem", F.col("first").alias("at"), F.lit(0).alias("one"), "t", "first", "n", "k"))
        passed = counted_before(events, ["out_id", "stem"], "at", F.col("one"), "passed").where("one = 0").drop("at", "one")
        kids = owners(passed)
        # free numbers below an owned one, against the rank of each choice
        owned = kids.where("own").select("out_id", "stem", (F.col("k") - 1 - F.col("below")).alias("at"), F.lit(1).alias("one"), F.lit(None).cast(rows.schema["node_id"].dataType).alias("node_id"))
        marks = owned.unionByName(chosen.select("out_id", "stem", F.col("j").alias("at"), F.lit(0).alias("one"), "node_id"))
        marks = counted_before(marks.withColumn("late", 1 - F.col("one")), ["out_id", "stem"], "at", F.col("one"), "skipped", "late").where("one = 0")
        numbered = marks.select("out_id", "node_id", F.concat("stem", F.lit("_"), (F.col("at") + 1 + F.col("skipped")).cast("string")).alias("name"))
        found = named.unionByName(numbered) if found is None else found.unionByName(named).unionByName(numbered)
        level = kids
