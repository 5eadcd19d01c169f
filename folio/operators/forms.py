"""Form records: fields and widgets, types, filling, display and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.tables import written

DEEPEST = 32
# Flag bits of fields.
READ_ONLY, REQUIRED, MULTILINE, PASSWORD, RADIO, PUSH, COMBO = 1, 2, 1 << 12, 1 << 13, 1 << 15, 1 << 16, 1 << 17


def read_fields(nodes: DataFrame) -> DataFrame:
    """Terminal fields with dotted names and inherited attributes."""
    level = nodes.where("parent_id IS NULL").select("doc_id", "node_id", F.col("t").alias("name"), "ft", "ff", "v", "max_len", "terminal")
    done, depth = level, 0
    while not (level := written(
        nodes.alias("n").join(level.alias("l"), F.col("n.parent_id") == F.col("l.node_id"))
        .select("n.doc_id", "n.node_id", F.concat_ws(".", "l.name", "n.t").alias("name"),
                *[F.coalesce(f"n.{c}", f"l.{c}").alias(c) for c in ("ft", "ff", "v", "max_len")], "n.terminal"), "fields")).isEmpty() and depth < DEEPEST:
        done, depth = done.unionByName(level), depth + 1
    return done.where("terminal").drop("terminal")


def has(ff: Column, bit: int) -> Column:
    return F.coalesce(ff, F.lit(0)).bitwiseAND(F.lit(bit)) != 0


def field_type(fields: DataFrame) -> DataFrame:
    ff = F.col("ff")
    kind = (
        F.when(F.col("ft") == "Tx", "text")
        .when(F.col("ft") == "Ch", F.when(has(ff, COMBO), "combo").otherwise("list"))
        .when(F.col("ft") == "Sig", "signature")
        .when(F.col("ft") == "Btn", F.when(has(ff, PUSH), "button").when(has(ff, RADIO), "radio").otherwise("checkbox"))
    )
    return fields.withColumns({"type": kind, "read_only": has(ff, READ_ONLY), "required": has(ff, REQUIRED), "multiline": has(ff, MULTILINE), "password": has(ff, PASSWORD)})


def place_widgets(widgets: DataFrame) -> DataFrame:
    """The page of a widget: where a page lists it, else its own pointer; others are dropped."""
    return widgets.withColumn("page_no", F.coalesce("listed_page", "own_page")).where("page_no IS NOT NULL").drop("listed_page", "own_page")


def widget_rects(widgets: DataFrame, height: int = 792) -> DataFrame:
    """Rectangles in display space, corners in order."""
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    return widgets.select("node_id", "page_no", left.alias("dx"), (F.lit(height) - high).alias("dy"), (right - left).alias("dw"), (high - low).alias("dh"))


def fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Values by name; read-only and unknown names are passed over, texts are cut to their limit."""
    given = fields.join(values.select("doc_id", "name", "value", F.lit(True).alias("given")), ["doc_id", "name"], "left")
    take = F.coalesce(F.col("given"), F.lit(False)) & ~F.col("read_only")
    text = F.coalesce("value", F.lit(""))
    cut = F.when(F.col("max_len") > 0, F.substr(text, F.lit(1), F.col("max_len"))).otherwise(text)
    new = F.when(F.col("type").isin("text", "combo", "list"), cut).when(F.col("type") == "checkbox", F.when(F.col("value").isin("true", "on", "Yes"), "Yes").otherwise("Off")).when(F.col("type") == "radio", text).otherwise(F.col("v"))
    return given.withColumn("v", F.when(take, new).otherwise(F.col("v"))).drop("value", "given")


def display_value(fields: DataFrame) -> DataFrame:
    """What a field shows: an option's label, bullets for a password, a list joined by commas."""
    label = F.get(F.filter("options", lambda o: o["value"] == F.col("v")), F.lit(0))["label"]
    shown = (
        F.when(F.col("type").isin("combo", "list"), F.coalesce(label, F.col("v")))
        .when(F.col("password"), F.repeat(F.lit("•"), F.length("v")))
        .otherwise(F.col("v"))
    )
    return fields.withColumn("shown", shown)


def flatten(fields: DataFrame, widgets: DataFrame, runs: DataFrame, annots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visible values become runs of their pages; the widgets' annotations go."""
    seen = widgets.where(~F.col("hidden")).join(fields.select("node_id", "v"), "node_id").where("v IS NOT NULL AND v <> ''")
    added = seen.select("doc_id", "page_no", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("v").alias("str"))
    return runs.select("doc_id", "page_no", "x", "y", "str").unionByName(added), annots.join(widgets.select("node_id"), "node_id", "left_anti")


def keep_included(fields: DataFrame, widgets: DataFrame, pages: DataFrame) -> DataFrame:
    """Fields with a widget on a page that is included."""
    there = widgets.join(pages, ["doc_id", "page_no"], "left_semi")
    return fields.join(there.select("node_id"), "node_id", "left_semi")
