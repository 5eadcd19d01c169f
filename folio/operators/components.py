"""Connected parts of graphs and of pixel masks, in rounds that follow the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.tables import written

#: Rounds after which the tables of a search are put together in one.
COMPACT = 4


def labels(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """``nodes`` (``group``, id) with ``label``, the least id of their connected part.

    ``edges`` (``group``, a, b) stand once in each direction.  A round is one job: every node offers the
    least grandparent among its neighbours to itself and to its parent, and moves up to its own
    grandparent, so that trees hook on each other and become flat at once."""
    ids = [group, "id"]
    first = edges.groupBy(group, F.col("a").alias("id")).agg(F.min("b").alias("b"))
    state = written(nodes.join(first, ids, "left").select(*ids, F.least("id", F.coalesce("b", "id")).alias("up")), "parts")
    while True:
        above = state.select(group, F.col("id").alias("up"), F.col("up").alias("top"))
        known = state.join(above, [group, "up"])
        offers = edges.join(known.select(group, F.col("id").alias("b"), "top"), [group, "b"]).groupBy(group, F.col("a").alias("id")).agg(F.min("top").alias("offer"))
        least = F.least("top", F.coalesce("offer", "top"))
        own = F.struct(F.col("id").alias("id"), least.alias("up"), F.col("up").alias("old"))
        parent = F.struct(F.col("up").alias("id"), least.alias("up"), F.lit(None).cast("long").alias("old"))
        moves = known.join(offers, ids, "left").select(group, F.explode(F.array(own, parent)).alias("m")).select(group, "m.*")
        state = written(moves.groupBy(*ids).agg(F.min("up").alias("up"), F.max("old").alias("old")), "parts")
        if state.where("up < old").isEmpty():
            return state.select(*ids, F.col("up").alias("label"))


def row_runs(px: DataFrame) -> DataFrame:
    """Pixels (image_id, x, y) as runs along rows: ``y``, ``x0``, ``x1`` and an id in reading order."""
    island = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    runs = px.withColumn("island", island).groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return runs.select("image_id", "y", "x0", "x1", (F.shiftleft(F.col("y").cast("long"), 31) + F.col("x0")).alias("id"))


def touching(runs: DataFrame) -> DataFrame:
    """(image_id, a, b) of runs in neighbouring rows that share a column, in both directions.  Of two that do,
    the later start lies in the other run, which is the last of its row to start by then."""
    sides = F.explode(F.array(F.struct(F.col("y").alias("row"), F.lit(0).alias("side")), F.struct((F.col("y") - 1).alias("row"), F.lit(1).alias("side"))))
    rows = runs.withColumn("at", sides).select("image_id", "at.row", "at.side", "x0", "x1", "id")
    until = Window.partitionBy("image_id", "row").orderBy("x0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side: F.max(F.when(F.col("side") == side, F.struct("x0", "x1", "id"))).over(until)
    other = F.when(F.col("side") == 0, F.col("__1")).otherwise(F.col("__0"))
    met = rows.withColumns({"__0": last(0), "__1": last(1)}).withColumn("other", other).where("other.x1 >= x0")
    ways = F.explode(F.array(F.struct(F.col("id").alias("a"), F.col("other.id").alias("b")), F.struct(F.col("other.id").alias("a"), F.col("id").alias("b"))))
    return met.select("image_id", ways.alias("e")).select("image_id", "e.a", "e.b").distinct()


def reached_runs(seeds: DataFrame, passable: DataFrame) -> DataFrame:
    """Runs (image_id, y, x0, x1) of passable pixels connected to a passable seed by steps to four neighbours."""
    runs = written(row_runs(passable), "runs")
    found = labels(runs.select("image_id", "id"), written(touching(runs), "touching"), "image_id")
    within = (F.col("sx") >= F.col("x0")) & (F.col("sx") <= F.col("x1"))
    at = seeds.select("image_id", F.col("x").alias("sx"), "y").distinct()
    hit = runs.join(at, ["image_id", "y"]).where(within).select("image_id", "id").distinct()
    parts = found.join(hit, ["image_id", "id"]).select("image_id", "label").distinct()
    return found.join(parts, ["image_id", "label"]).join(runs, ["image_id", "id"]).select("image_id", "y", "x0", "x1")


def pixels_of(runs: DataFrame) -> DataFrame:
    return runs.select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth) of what the roots reach, by the fewest steps.

    A node with one way in and one way out is part of a chain: pointer jumping gives each its distance
    from the node that the chain leaves, and the search crosses a chain in one round.  A round
    joins the nodes that the round before brought nearer; their table is put together as it grows."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    roots = roots.select("node").distinct()
    degrees = edges.select(F.col("dst").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out"), F.col("src").alias("before")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out"), F.lit(None).cast(edges.schema["src"].dataType).alias("before")))
    single = degrees.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out"), F.max("before").alias("anchor")).where("into = 1 AND out = 1").join(roots, "node", "left_anti")
    chain = written(single.select("node", "anchor", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("ended")), "chain")
    for _ in range(max(1, chain.count()).bit_length() + 1):  # a circle of such nodes has no way in and never ends
        above = chain.select(F.col("node").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"))
        ended = F.col("next").isNull()
        chain = written(chain.join(above, "anchor", "left").select("node", F.coalesce("next", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), ended.alias("ended")), "chain")
        if chain.where("NOT ended").isEmpty():
            break
    chain = chain.where("ended").drop("ended")
    inside = chain.select(F.col("node").alias("dst"))
    ends = edges.join(inside, "dst", "left_anti").join(chain.select(F.col("node").alias("src"), "anchor", "steps"), "src", "left")
    short = written(ends.select(F.coalesce("anchor", "src").alias("src"), "dst", (F.coalesce("steps", F.lit(0)) + 1).alias("steps")).groupBy("src", "dst").agg(F.min("steps").alias("steps")), "edges")
    best = near = written(roots.select("node", F.lit(0).cast("long").alias("depth")), "reach")
    turn = 0
    while True:
        found = near.join(short, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
        known = best.groupBy("node").agg(F.min("depth").alias("known"))
        near = written(found.join(known, "node", "left").where("known IS NULL OR depth < known").drop("known"), "reach")
        if near.isEmpty():
            break
        best, turn = best.unionByName(near), turn + 1
        if turn % COMPACT == 0:
            best = written(best.groupBy("node").agg(F.min("depth").alias("depth")), "reach")
    best = best.groupBy("node").agg(F.min("depth").alias("depth"))
    within = chain.join(best.withColumnRenamed("node", "anchor"), "anchor").select("node", (F.col("depth") + F.col("steps")).alias("depth"))
    return best.unionByName(within).select("node", F.col("depth").cast("int").alias("depth"))
