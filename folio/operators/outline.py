"""Outline trees: reading linked lists, named targets, re-targeting and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.tables import written


def rounds(nodes: DataFrame) -> range:
    """Rounds of pointer jumping that reach the end of any list or path of so many nodes."""
    return range(nodes.count().bit_length() + 1)


def sibling_ranks(nodes: DataFrame) -> DataFrame:
    """Rank of each node in its list, from ``prev`` pointers, by pointer jumping: each round
    doubles the distance that is known, so a list of n nodes takes log n joins.  What has no first
    node, as a damaged list that runs in a circle, is not reached and left out."""
    at = written(nodes.select("node_id", F.col("prev").alias("jump"), F.when(F.col("prev").isNull(), 0).otherwise(1).alias("rank")), "ranks")
    for _ in rounds(at):
        if at.where("jump IS NOT NULL").isEmpty():
            break
        # never broadcast, as each of the rounds would send a table to the driver; what has arrived is not joined
        back = at.select(F.col("node_id").alias("jump"), F.col("jump").alias("further"), F.col("rank").alias("more")).hint("merge")
        further = at.where("jump IS NOT NULL").join(back, "jump", "left").select("node_id", F.col("further").alias("jump"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"))
        at = written(further.unionByName(at.where("jump IS NULL")), "ranks")
    return at.where("jump IS NULL").select("node_id", "rank")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(node_id, total) from (node_id, up, value): each node's own value and those of all below it,
    by doubling: a round adds what lies as far again below.  A tree of depth d takes log d rounds;
    nodes above which there is no end, as in a circle, are left out."""
    at = written(nodes.select("node_id", "up", F.col("value").cast("long").alias("total")), "sums")
    for _ in rounds(at):
        if at.where("up IS NOT NULL").isEmpty():
            break
        more = at.where("up IS NOT NULL").groupBy(F.col("up").alias("node_id")).agg(F.sum("total").alias("more"))
        above = at.select(F.col("node_id").alias("up"), F.col("up").alias("further"))
        new = at.join(more, "node_id", "left").join(above, "up", "left")
        at = written(new.select("node_id", F.col("further").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "sums")
    return at.where("up IS NULL").select("node_id", "total")


def nearest_above(nodes: DataFrame) -> DataFrame:
    """(node_id, above) from (node_id, up, held): the nearest node above that is held, or null, by
    pointer jumping over nodes that are not."""
    at = written(nodes.select("node_id", F.col("up").alias("above"), F.lit(False).alias("done"), "held"), "above")
    for _ in rounds(at):
        if at.where("NOT done").isEmpty():
            break
        back = at.select(F.col("node_id").alias("above"), F.col("above").alias("further"), F.col("held").alias("there"), F.col("done").alias("known"))
        stay = F.col("done") | F.coalesce("there", F.lit(False))
        end = F.col("above").isNull() | F.col("known").isNull()  # no parent, or one that isn't there
        step = F.when(stay, F.col("above")).otherwise(F.col("further"))
        at = written(at.join(back, "above", "left").select("node_id", step.alias("above"), (stay | end | F.coalesce("known", F.lit(False))).alias("done"), "held"), "above")
    return at.where("done").select("node_id", "above")


def read_outline(nodes: DataFrame) -> DataFrame:
    """Ordered tree with depth from (node_id, parent_id, prev): lists first, then levels."""
    ranked = written(nodes.join(sibling_ranks(nodes).hint("merge"), "node_id").select("node_id", "parent_id", "title", F.col("rank").cast("int").alias("ord")), "outline")
    level = ranked.where("parent_id IS NULL").select("node_id", "title", F.lit(0).alias("depth"), F.array("ord").alias("path"))
    done = level
    while not (level := written(
        ranked.alias("n").join(level.alias("l"), F.col("n.parent_id") == F.col("l.node_id"))
        .select("n.node_id", "n.title", (F.col("l.depth") + 1).alias("depth"), F.array_append("l.path", F.col("n.ord")).alias("path")), "outline")).isEmpty():
        done = done.unionByName(level)
    return done


def resolve_dest(outline: DataFrame, older: DataFrame, newer: DataFrame) -> DataFrame:
    """Targets by name: the older table first, then the newer."""
    a = older.select("name", F.col("page_no").alias("page_a"))
    b = newer.select("name", F.col("page_no").alias("page_b"))
    return outline.join(a, "name", "left").join(b, "name", "left").withColumn("target_page", F.coalesce("page_a", "page_b")).drop("page_a", "page_b")


def remap_outline(outline: DataFrame, page_map: DataFrame) -> DataFrame:
    """New targets and parents: a node whose page is gone is dropped and its children go to the
    nearest kept ancestor; a node without a page stays while a kept node is below it.  Nodes above
    which there is no root, as in a circle, are not reached and go."""
    mapped = written(outline.join(page_map.select(F.col("page").alias("target"), "new_page"), "target", "left"), "remap")
    alive = F.when(F.col("new_page").isNotNull(), 1).otherwise(0)
    below = subtree_sums(mapped.select("node_id", F.col("parent_id").alias("up"), alive.alias("value")))
    kept = F.col("new_page").isNotNull() | (F.col("target").isNull() & (F.col("total") > 0))
    marked = written(mapped.join(below, "node_id").withColumn("kept", kept), "kept")
    parents = nearest_above(marked.select("node_id", F.col("parent_id").alias("up"), F.col("kept").alias("held")))
    return marked.where("kept").join(parents, "node_id").select("node_id", F.col("above").alias("new_parent"), "new_page")


def merge_outlines(outlines: DataFrame, inputs: DataFrame) -> DataFrame:
    """A top node for each input (doc_id, title, first_seq), that input's own tree beneath it."""
    tops = inputs.select("doc_id", F.lit(-1).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), "title", F.col("first_seq").alias("target"))
    own = outlines.select("doc_id", "node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "title", F.lit(None).cast("int").alias("target"))
    return tops.unionByName(own)


def link_outline(outline: DataFrame) -> DataFrame:
    """Neighbours, ends of the child list, and the count of visible descendants: negative for closed
    nodes, whose own children are what it counts."""
    by = Window.partitionBy("parent_id").orderBy("ord", "node_id")
    links = outline.select("node_id", "parent_id", "is_open", F.lag("node_id").over(by).alias("prev"), F.lead("node_id").over(by).alias("next"))
    ends = outline.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("first"), F.max_by("node_id", F.struct("ord", "node_id")).alias("last"))
    # a descendant counts for an ancestor if every node between them is open
    parents = outline.select(F.col("node_id").alias("parent_id"), F.col("is_open").alias("through"))
    passing = outline.join(parents, "parent_id", "left").select("node_id", "parent_id", F.when(F.col("through"), F.col("parent_id")).alias("up"), F.lit(1).alias("value"))
    shown = subtree_sums(passing).join(outline.select("node_id", "parent_id"), "node_id")
    seen = shown.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("ancestor")).agg(F.sum("total").alias("n"))
    out = links.join(ends.withColumnRenamed("parent_id", "node_id"), "node_id", "left").join(seen.withColumnRenamed("ancestor", "node_id"), "node_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("node_id", "prev", "next", "first", "last", F.when(F.col("is_open"), n).otherwise(-n).alias("count"))
