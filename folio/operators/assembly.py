"""Assembling documents from pages: merges, orders, splits and what refers to dropped pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import quarter_turns

BLANK = (612, 792)


def renumber(rows: DataFrame, by: str, *order) -> DataFrame:
    """``seq`` from 1 within each ``by`` in the given order."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("int"))


def assemble(page_ops: DataFrame, pages: DataFrame, parts: int | None = None) -> DataFrame:
    """Resolves (out_id, seq, src_doc, src_page, rotation, blank_w, blank_h) against the pages;
    ``status`` is page, blank or missing.  Pages count from 1, so what names no page gets keys of its own
    below: nulls would all meet in one task.  ``parts`` is the number of partitions to join in, where it is to follow the input."""
    p = pages.select(F.col("doc_id").alias("__doc"), F.col("page_no").alias("__page"), "x0", "y0", "x1", "y1", "rotate", F.lit(True).alias("there"))
    named = F.col("src_doc").isNotNull() & F.col("src_page").isNotNull()
    keyed = page_ops.withColumns({"__doc": F.when(named, F.col("src_doc")).otherwise(F.lit(0)), "__page": F.when(named, F.col("src_page")).otherwise(-F.col("seq"))})
    if parts:
        keyed, p = (side.repartition(parts, "__doc", "__page") for side in (keyed, p))
    rows = keyed.join(p, ["__doc", "__page"], "left")
    blank = F.col("src_page").isNull()
    return rows.select(
        "out_id", "seq", "src_doc", "src_page",
        F.when(blank, F.coalesce("blank_w", F.lit(BLANK[0]))).otherwise(F.col("x1") - F.col("x0")).cast("int").alias("w"),
        F.when(blank, F.coalesce("blank_h", F.lit(BLANK[1]))).otherwise(F.col("y1") - F.col("y0")).cast("int").alias("h"),
        F.pmod(F.coalesce("rotate", F.lit(0)) + F.coalesce("rotation", F.lit(0)), F.lit(360)).cast("int").alias("rotate"),
        F.when(blank, "blank").when(F.col("there"), "page").otherwise("missing").alias("status"),
    )


def merge(pages: DataFrame, order: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Pages of the documents in ``order(out_id, doc_ord, doc_id)``, all or those of
    ``ranges(doc_id, ord, page_no)`` in their order."""
    own = pages.select("doc_id", "page_no")
    own = own.withColumn("ord", F.col("page_no")) if ranges is None else own.join(ranges, ["doc_id", "page_no"])
    return renumber(own.join(order, "doc_id"), "out_id", "doc_ord", "ord", "page_no").select("out_id", "seq", "doc_id", "page_no")


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0)), lambda t: F.when(t.rlike("^[0-9]"), F.lpad(F.regexp_replace(t, "^0+(?=.)", ""), 20, "0")).otherwise(t)), "")


def organize(page_ops: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages by list position; a page left out is deleted, a repeated one is doubled."""
    return renumber(page_ops.join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"]), "doc_id", "ord").select("doc_id", "seq", "page_no")


def reverse(pages: DataFrame) -> DataFrame:
    return renumber(pages, "doc_id", F.desc("page_no")).select("doc_id", "seq", "page_no")


def move_selected(pages: DataFrame, selected: Column, where: str) -> DataFrame:
    first = F.when(selected, 0).otherwise(1) if where == "start" else F.when(selected, 1).otherwise(0)
    return renumber(pages, "doc_id", first, "page_no").select("doc_id", "seq", "page_no")


def duplicate(pages: DataFrame, selected: Column) -> DataFrame:
    copies = pages.select("doc_id", "page_no", F.explode(F.when(selected, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return renumber(copies, "doc_id", "page_no", "copy").select("doc_id", "seq", "page_no", "copy")


def delete(pages: DataFrame, selected: Column) -> DataFrame:
    """Drops the selected pages; a document that would lose all keeps all."""
    left = F.sum(F.when(selected, 0).otherwise(1)).over(Window.partitionBy("doc_id"))
    return renumber(pages.withColumn("__left", left).where(~selected | (F.col("__left") == 0)), "doc_id", "page_no").select("doc_id", "seq", "page_no")


def insert_blank(dims: DataFrame, after: Column) -> DataFrame:
    """A blank of the size at which its neighbour is shown, after each page where ``after`` holds."""
    rows = dims.select("doc_id", "page_no", "dw", "dh", F.explode(F.when(after, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("blank"))
    return renumber(rows, "doc_id", "page_no", "blank").select("doc_id", "seq", F.when(~F.col("blank"), F.col("page_no")).alias("page_no"), "blank", "dw", "dh")


def splice(pages: DataFrame, other: DataFrame, selected: Column) -> DataFrame:
    """Pages of ``other(doc_id, src_doc, page_no)`` after the last selected page, else at the end."""
    own = pages.select("doc_id", F.col("doc_id").alias("src_doc"), "page_no", F.coalesce(F.max(F.when(selected, F.col("page_no"))).over(Window.partitionBy("doc_id")), F.max("page_no").over(Window.partitionBy("doc_id"))).alias("after"))
    at = own.groupBy("doc_id").agg(F.first("after").alias("after"))
    both = own.select("doc_id", "src_doc", "page_no", F.when(F.col("page_no") <= F.col("after"), 0).otherwise(2).alias("part")).unionByName(other.join(at, "doc_id").select("doc_id", "src_doc", "page_no", F.lit(1).alias("part")))
    return renumber(both, "doc_id", "part", "src_doc", "page_no").select("doc_id", "seq", "src_doc", "page_no")


def rotate(pages: DataFrame, delta: int, scope: str) -> DataFrame:
    hit = {"all": F.lit(True), "odd": F.col("page_no") % 2 == 1, "even": F.col("page_no") % 2 == 0}[scope]
    turned = quarter_turns(F.col("rotate"))
    return pages.withColumn("rotate", F.when(hit, F.pmod(turned + delta, F.lit(360))).otherwise(turned).cast("int"))


def in_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, ord, page_no) of ranges(doc_id, ord, from_page, to_page): an equi-join on the document."""
    return pages.select("doc_id", "page_no").join(ranges, "doc_id").where(F.col("page_no").between(F.col("from_page"), F.col("to_page"))).select("doc_id", "ord", "page_no")


def extract(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    return renumber(in_ranges(pages, ranges), "doc_id", "ord", "page_no").select("doc_id", "seq", "page_no")


def split_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """One output for each range; a page may fall into several."""
    order = Window.partitionBy("doc_id", "ord").orderBy("page_no")
    return in_ranges(pages, ranges).select("doc_id", F.col("ord").alias("out_id"), F.row_number().over(order).cast("int").alias("seq"), "page_no")


def split_every(pages: DataFrame, n: int) -> DataFrame:
    return pages.select("doc_id", F.floor((F.col("page_no") - 1) / n).cast("int").alias("out_id"), "page_no")


def split_each(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", F.col("page_no").alias("out_id"), "page_no")


def page_file(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """The first output that each page lands in."""
    return in_ranges(pages, ranges).groupBy("doc_id", "page_no").agg(F.min("ord").alias("out_id"))


def null_dangling(refs: DataFrame, kept: DataFrame) -> DataFrame:
    """References to pages that are not kept become null."""
    k = kept.select("doc_id", F.col("page_no").alias("target_page"), F.lit(True).alias("there"))
    return refs.join(k, ["doc_id", "target_page"], "left").withColumn("target_page", F.when(F.col("there"), F.col("target_page"))).drop("there")
