"""The page relation: scans and sinks, boxes and rotations, page ranges and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import quarter_turns
from folio.operators.assembly import page_file
from folio.sources.tables import written

#: The page size where none is given, and the least side of a usable crop.
WIDTH, HEIGHT, LEAST_SIDE = 612, 792, 1


def valid_documents(docs: DataFrame, header: str = r"^\p{L}") -> DataFrame:
    """Rows whose content begins as a document of the kind must."""
    return docs.where(F.col("text").rlike(header))


def latest_revision(objects: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row that defines each key: the first in ``order``."""
    return objects.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def split_bad(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the names of the checks they fail."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    marked = df.withColumn("warnings", failed)
    return marked.where(F.size("warnings") == 0).drop("warnings"), marked.where(F.size("warnings") > 0)


def pick_root(objects: DataFrame, precedence: dict[str, int]) -> DataFrame:
    """For each document the object of the first type in ``precedence``, the earliest of those."""
    rank = F.create_map(*[F.lit(x) for kv in precedence.items() for x in kv])
    ranked = objects.withColumn("rank", F.coalesce(F.element_at(rank, F.col("type")), F.lit(99)))
    return ranked.groupBy("doc_id").agg(F.min_by(F.struct("obj_key", "type"), F.struct("rank", "ord")).alias("root")).select("doc_id", "root.obj_key", "root.type")


def bundle_names(parts: DataFrame, stem: Column, suffix: str) -> DataFrame:
    """``out_name`` for each part of a document: numbered with zeros to the width of the count,
    or without a number if the document has one part."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    number = F.lpad(F.col("page_no").cast("string"), 12, "0").substr(F.lit(13) - F.length(n.cast("string")), F.lit(12))
    return parts.withColumn("out_name", F.when(n == 1, F.concat(stem, F.lit(suffix))).otherwise(F.concat(stem, F.lit("-"), number, F.lit(suffix))))


def write_bundle(df: DataFrame, path: str) -> None:
    """One folder for each output name."""
    df.repartition("out_name").write.partitionBy("out_name").parquet(path)


def document_text(lines: DataFrame, markers: bool) -> DataFrame:
    """Pages joined into one text, an empty line between, each under its marker if asked for."""
    page = F.concat(F.lit("——— Page "), F.col("page_no").cast("string"), F.lit(" ———\n\n"), F.col("body")) if markers else F.col("body")
    pages = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", page.alias("body")))).alias("pages"))
    return pages.select("doc_id", F.array_join("pages.body", "\n\n").alias("text"))


def flatten_pages(nodes: DataFrame, inherited: list[str]) -> DataFrame:
    """Leaves of page trees in depth-first order, with what they inherit from the nearest
    ancestor; a node met again on its own path is left out.  One join for each level."""
    level = nodes.where("parent IS NULL").select(F.col("node").alias("doc_id"), "node", F.array("ord").alias("path"), F.array("node").alias("seen"), "is_page", *inherited)
    done = level
    while not (level := written(
        nodes.alias("n").join(level.alias("l"), F.col("n.parent") == F.col("l.node"))
        .where(~F.array_contains("l.seen", F.col("n.node")))
        .select("l.doc_id", "n.node", F.array_append("l.path", F.col("n.ord")).alias("path"), F.array_append("l.seen", F.col("n.node")).alias("seen"),
                "n.is_page", *[F.coalesce(f"n.{c}", f"l.{c}").alias(c) for c in inherited]), "tree")).isEmpty():
        done = done.unionByName(level)
    order = Window.partitionBy("doc_id").orderBy("path")
    return done.where("is_page").select("doc_id", F.row_number().over(order).cast("int").alias("page_no"), "node", *inherited)


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))


def visible_box(pages: DataFrame) -> DataFrame:
    """Crop within media, corners in order; the media box where that leaves a side of 1 or less."""
    def corners(a: str, b: str, low: int, high: int):
        x, y = F.coalesce(F.col(a), F.lit(low)), F.coalesce(F.col(b), F.lit(high))
        return F.least(x, y), F.greatest(x, y)

    (mx0, mx1), (my0, my1) = corners("x0", "x1", 0, WIDTH), corners("y0", "y1", 0, HEIGHT)
    bx0, bx1 = F.greatest(mx0, F.least("cx0", "cx1")), F.least(mx1, F.greatest("cx0", "cx1"))
    by0, by1 = F.greatest(my0, F.least("cy0", "cy1")), F.least(my1, F.greatest("cy0", "cy1"))
    use = F.col("cx0").isNotNull() & (bx1 - bx0 > LEAST_SIDE) & (by1 - by0 > LEAST_SIDE)
    boxes = [F.when(use, c).otherwise(m).alias(n) for n, c, m in (("vx0", bx0, mx0), ("vy0", by0, my0), ("vx1", bx1, mx1), ("vy1", by1, my1))]
    return pages.select("*", *boxes)


def norm_rotation(pages: DataFrame) -> DataFrame:
    return pages.withColumn("rotate", quarter_turns(F.col("rotate")))


def page_dims(pages: DataFrame) -> DataFrame:
    box = norm_rotation(visible_box(pages))
    return box.select("doc_id", "page_no", F.round(F.col("vx1") - F.col("vx0"), 2).alias("w"), F.round(F.col("vy1") - F.col("vy0"), 2).alias("h"), "rotate")


def display_dims(dims: DataFrame) -> DataFrame:
    turned = F.col("rotate") % 180 != 0
    return dims.select("doc_id", "page_no", F.when(turned, F.col("h")).otherwise(F.col("w")).alias("dw"), F.when(turned, F.col("w")).otherwise(F.col("h")).alias("dh"))


def parse_ranges(specs: DataFrame, spec: str = "spec", total: str = "total") -> DataFrame:
    """``ord, from_page, to_page, error`` for each part of "1-3, 5", as written; a part is in error
    if it is no range, begins below 1 or after its end, or ends after the last page.  An empty
    specification is one part in error."""
    parts = specs.select("*", F.posexplode(F.split(F.trim(F.coalesce(F.col(spec), F.lit(""))), ",")).alias("ord", "part"))
    token = F.trim("part")
    first = F.expr("try_cast(nullif(regexp_extract(trim(part), '^([0-9]+)', 1), '') AS int)")
    last = F.expr("try_cast(nullif(regexp_extract(trim(part), '([0-9]+)$', 1), '') AS int)")
    shape = token.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$")
    ok = F.coalesce(shape & (first >= 1) & (last >= first) & (last <= F.col(total)), F.lit(False))
    return parts.select(*specs.columns, F.col("ord").cast("int").alias("ord"), F.when(ok, first).alias("from_page"), F.when(ok, last).alias("to_page"), (~ok).alias("error"))


def format_ranges(selected: DataFrame) -> DataFrame:
    """"1-3, 5" of each document's selected pages."""
    runs = selected.select("doc_id", "page_no").distinct().withColumn("run", F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")))
    runs = runs.groupBy("doc_id", "run").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))), lambda r: r["s"]), ", ").alias("ranges"))


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """One row for each page of each range, in written order."""
    return ranges.where("from_page <= to_page").select("*", F.explode(F.sequence("from_page", "to_page")).alias("page_no")).drop("from_page", "to_page")


def pick_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages of ``ranges(doc_id, ord, from_page, to_page)`` that exist, each once, by first mention.  All steps
    are by document, so pages that come dealt that way are not dealt again."""
    order = Window.partitionBy("doc_id").orderBy("out_id", "page_no")
    return page_file(pages, ranges).select("doc_id", "page_no", F.row_number().over(order).cast("int").alias("seq"))


def select_pages(pages: DataFrame, how: str | list[int]) -> DataFrame:
    """all, odd, even (counted from 1) or a list of page numbers."""
    if how == "all":
        return pages
    if how in ("odd", "even"):
        return pages.where(F.col("page_no") % 2 == (1 if how == "odd" else 0))
    return pages.where(F.col("page_no").isin(list(how)))


def toggle_preset(pages: DataFrame, selected: DataFrame, how: str) -> DataFrame:
    """A new selection; ``invert`` is what was not selected."""
    if how == "none":
        return pages.where(F.lit(False))
    if how == "invert":
        return pages.join(selected.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")
    return select_pages(pages, how)


