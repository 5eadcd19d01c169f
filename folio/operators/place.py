"""Placement on pages: labels, watermarks, crops, geometry and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Page sizes in points.
SIZES = {"a3": (842, 1191), "a4": (595, 842), "a5": (420, 595), "letter": (612, 792), "legal": (612, 1008)}
MOST_MARGIN = 0.45


def page_labels(pages: DataFrame, style: str = "n-of-total", start: int = 1, skip_first: bool = False, custom: str = "{n}") -> DataFrame:
    """A label for each page; with the cover skipped it has none and does not count."""
    skip = 1 if skip_first else 0
    n = (F.col("page_no") - 1 + start - skip).cast("string")
    t = (F.count("*").over(Window.partitionBy("doc_id")) - skip + start - 1).cast("string")
    shown = {
        "n": n,
        "n-of-total": F.concat(n, F.lit(" / "), t),
        "page-n": F.concat(F.lit("Page "), n),
        "page-n-of-total": F.concat(F.lit("Page "), n, F.lit(" of "), t),
        "custom": F.replace(F.replace(F.lit(custom), F.lit("{n}"), n), F.lit("{t}"), t),
    }[style]
    return pages.withColumn("label", shown).where(F.col("page_no") > skip)


def label_positions(labels: DataFrame, pos: str = "br", margin: float = 18, size: float = 10, advance: int = 600, mirror: bool = False) -> DataFrame:
    """x and y of labels at the six places; even pages swap left and right if mirrored."""
    wide = F.length("label") * advance / 1000 * size
    side = F.lit(pos[1])
    if mirror and pos[1] != "c":
        side = F.when(F.col("page_no") % 2 == 0, "r" if pos[1] == "l" else "l").otherwise(pos[1])
    x = F.when(side == "l", float(margin)).when(side == "r", F.col("dw") - margin - wide).otherwise(F.col("dw") / 2 - wide / 2)
    y = F.col("dh") - margin - size * 0.72 if pos[0] == "t" else F.lit(float(margin))
    return labels.withColumns({"lx": x, "ly": y})


def watermark_grid(dims: DataFrame, width: float, size: float, tiled: bool = True) -> DataFrame:
    """Anchor points: the centre, or rows of tiles of which every other is half a step along."""
    if not tiled:
        return dims.select("doc_id", "page_no", (F.col("dw") / 2).alias("wx"), (F.col("dh") / 2).alias("wy"))
    step_x, step_y = max(width, size * 4) * 1.4, max(size * 5, width * 0.6)
    rows = dims.select("doc_id", "page_no", "dw", F.explode(F.sequence(F.lit(0), F.ceil((F.col("dh") + step_y / 2) / step_y).cast("int") - 1)).alias("i"))
    shift = F.floor(F.col("i") + 1.0) % 2 * step_x / 2
    rows = rows.select("doc_id", "page_no", (step_y / 2 + F.col("i") * step_y).alias("wy"), shift.alias("shift"), F.explode(F.sequence(F.lit(0), F.ceil((F.col("dw") + step_x - shift) / step_x).cast("int") - 1)).alias("j"))
    return rows.select("doc_id", "page_no", (F.col("shift") + F.col("j") * step_x).alias("wx"), "wy")


def layer_order(content: DataFrame, stamps: DataFrame) -> DataFrame:
    """Content lists with stamps under or over them; what was there is set apart between two marks."""
    both = content.join(stamps, ["doc_id", "page_no"], "left")
    apart = F.concat(F.array(F.lit("save")), F.col("content"), F.array(F.lit("restore")))
    return both.withColumn("content", F.when(F.col("stamp").isNull(), F.col("content")).when(F.col("under"), F.array_prepend(apart, F.col("stamp"))).otherwise(F.array_append(apart, F.col("stamp"))))


def to_display(df: DataFrame) -> DataFrame:
    """Page space (px, py) to display space (dx, dy) for the page's box and rotation."""
    r, x, y = F.col("rotate"), F.col("px"), F.col("py")
    dx = F.when(r == 90, y - F.col("vy0")).when(r == 180, F.col("vx1") - x).when(r == 270, F.col("vy1") - y).otherwise(x - F.col("vx0"))
    dy = F.when(r == 90, x - F.col("vx0")).when(r == 180, y - F.col("vy0")).when(r == 270, F.col("vx1") - x).otherwise(F.col("vy1") - y)
    return df.withColumns({"dx": dx, "dy": dy})


def to_user(df: DataFrame) -> DataFrame:
    """Display space back to page space."""
    r, x, y = F.col("rotate"), F.col("dx"), F.col("dy")
    px = F.when(r == 90, y + F.col("vx0")).when(r == 180, F.col("vx1") - x).when(r == 270, F.col("vx1") - y).otherwise(x + F.col("vx0"))
    py = F.when(r == 90, x + F.col("vy0")).when(r == 180, y + F.col("vy0")).when(r == 270, F.col("vy1") - x).otherwise(F.col("vy1") - y)
    return df.withColumns({"px": px, "py": py})


def compose(m: Column, n: Column) -> Column:
    """The transform that applies ``n`` and then ``m``; six numbers each."""
    a, b = (lambda i: F.get(m, F.lit(i))), (lambda i: F.get(n, F.lit(i)))
    return F.array(
        a(0) * b(0) + a(2) * b(1), a(1) * b(0) + a(3) * b(1),
        a(0) * b(2) + a(2) * b(3), a(1) * b(2) + a(3) * b(3),
        a(0) * b(4) + a(2) * b(5) + a(4), a(1) * b(4) + a(3) * b(5) + a(5),
    )


def apply_chain(points: DataFrame, chain: str = "chain") -> DataFrame:
    """Points through a list of nested transforms, the innermost last."""
    whole = F.aggregate(chain, F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]), compose)
    m = points.withColumn("m", whole)
    at = lambda i: F.get("m", F.lit(i))
    return m.withColumns({"tx": at(0) * F.col("x") + at(2) * F.col("y") + at(4), "ty": at(1) * F.col("x") + at(3) * F.col("y") + at(5)}).drop("m")


def crop(pages: DataFrame, rects: DataFrame) -> DataFrame:
    """Crop boxes in page space from display rectangles (rx, ry, rw, rh); those of a side of 1 or
    less change nothing."""
    rows = pages.join(rects, ["doc_id", "page_no"]).where("rw > 1 AND rh > 1")
    one = to_user(rows.withColumns({"dx": F.col("rx"), "dy": F.col("ry")})).withColumnsRenamed({"px": "ax", "py": "ay"})
    two = to_user(one.withColumns({"dx": F.col("rx") + F.col("rw"), "dy": F.col("ry") + F.col("rh")}))
    r3 = lambda c: F.round(c, 3)
    return two.select("doc_id", "page_no", r3(F.least("ax", "px")).alias("cx0"), r3(F.least("ay", "py")).alias("cy0"), r3(F.greatest("ax", "px")).alias("cx1"), r3(F.greatest("ay", "py")).alias("cy1"))


def margins_to_rects(dims: DataFrame, margins: dict[str, float], scope: str = "all") -> DataFrame:
    """Margins as parts of the page to rectangles, for pages in scope; none if all are zero."""
    left, top, right, bottom = (margins.get(k, 0.0) for k in "ltrb")
    hit = {"all": F.lit(True), "odd": F.col("page_no") % 2 == 1, "even": F.col("page_no") % 2 == 0}[scope]
    some = bool(left or top or right or bottom)
    return dims.where(hit & F.lit(some)).select("doc_id", "page_no", (F.col("dw") * left).alias("rx"), (F.col("dh") * top).alias("ry"), (F.col("dw") * (1 - left - right)).alias("rw"), (F.col("dh") * (1 - top - bottom)).alias("rh"))


def content_margins(px: DataFrame, pad: float = 0.015, level: int = 245) -> DataFrame:
    """Margins around what is darker than ``level``; zero for a blank page."""
    dark = (F.col("r") < level) | (F.col("g") < level) | (F.col("b") < level)
    x, y = F.when(dark, F.col("x")), F.when(dark, F.col("y"))
    b = px.groupBy("image_id").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    held = lambda v: F.when(F.col("x0").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(MOST_MARGIN), v)))
    w, h = F.col("w"), F.col("h")
    return b.select("image_id", held(F.col("x0") / w - pad).alias("l"), held(F.col("y0") / h - pad).alias("t"), held(1 - (F.col("x1") + 1) / w - pad).alias("r"), held(1 - (F.col("y1") + 1) / h - pad).alias("b"))


def image_pages(images: DataFrame, size: str = "a4", orient: str = "auto", margin: float = 0, fit: str = "contain", dpi: float = 96) -> DataFrame:
    """A page for each image and the matrix that places it, turned by its ``turn``."""
    turned = F.col("turn") % 180 != 0
    vw, vh = F.when(turned, F.col("h")).otherwise(F.col("w")), F.when(turned, F.col("w")).otherwise(F.col("h"))
    if size in ("native", "fit"):
        k = 1.0 if size == "native" else 72 / dpi
        pw, ph = vw * k + margin * 2, vh * k + margin * 2
    else:
        low, high = sorted(SIZES.get(size, SIZES["a4"]))
        wide = F.lit(orient == "landscape") | (F.lit(orient == "auto") & (vw > vh))
        pw, ph = F.when(wide, float(high)).otherwise(float(low)), F.when(wide, float(low)).otherwise(float(high))
    rows = images.withColumns({"vw": vw, "vh": vh, "pw": pw, "ph": ph})
    cw, ch = F.greatest(F.lit(1.0), F.col("pw") - margin * 2), F.greatest(F.lit(1.0), F.col("ph") - margin * 2)
    if fit == "stretch":
        dw, dh = cw, ch
    else:
        scale = (F.greatest if fit == "cover" else F.least)(cw / F.col("vw"), ch / F.col("vh"))
        dw, dh = F.col("vw") * scale, F.col("vh") * scale
    rows = rows.withColumns({"dw": dw, "dh": dh})
    x, y, dw, dh, zero = (F.col("pw") - F.col("dw")) / 2, (F.col("ph") - F.col("dh")) / 2, F.col("dw"), F.col("dh"), F.lit(0.0)
    m = (
        F.when(F.col("turn") == 90, F.array(zero, -dh, dw, zero, x, y + dh))
        .when(F.col("turn") == 180, F.array(-dw, zero, zero, -dh, x + dw, y + dh))
        .when(F.col("turn") == 270, F.array(zero, dh, -dw, zero, x + dw, y))
        .otherwise(F.array(dw, zero, zero, dh, x, y))
    )
    return rows.withColumn("matrix", m)


def turn(shapes: DataFrame, width: float, height: float) -> DataFrame:
    """Shapes turned clockwise with their page; sizes swap, or the shape's own rotation grows."""
    own = F.col("t").isin("stamp", "polygon")
    nx, ny = height - F.col("y") - F.col("h"), F.col("x")
    return shapes.withColumns({
        "x": F.when(own, nx + F.col("h") / 2 - F.col("w") / 2).otherwise(nx),
        "y": F.when(own, ny + F.col("w") / 2 - F.col("h") / 2).otherwise(ny),
        "w": F.when(own, F.col("w")).otherwise(F.col("h")),
        "h": F.when(own, F.col("h")).otherwise(F.col("w")),
        "rot": F.when(own, (F.col("rot") + 90) % 360).otherwise(F.col("rot")),
    })


def cut_paths(points: DataFrame, discs: DataFrame, width: float = 2) -> DataFrame:
    """Pieces of paths (path_id, n, x, y) outside their disc; long segments get points in between
    first, and pieces of one point are dropped."""
    order = Window.partitionBy("path_id").orderBy("n")
    rows = points.join(discs, "path_id").withColumns({"x0": F.lag("x").over(order), "y0": F.lag("y").over(order)})
    length = F.sqrt((F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0")))
    steps = F.greatest(F.lit(1), F.coalesce(F.floor(length / F.greatest(F.lit(1.0), F.col("r") / 2)), F.lit(1))).cast("int")
    dense = rows.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    last, part = F.col("k") == F.col("steps"), F.col("k") / F.col("steps")
    at = lambda c: F.when(last, F.col(c)).otherwise(F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * part)
    dense = dense.select("path_id", "n", "k", at("x").alias("x"), at("y").alias("y"), "dx", "dy", "r")
    far = (F.col("x") - F.col("dx")) * (F.col("x") - F.col("dx")) + (F.col("y") - F.col("dy")) * (F.col("y") - F.col("dy"))
    reach = F.col("r") + width / 2
    by = Window.partitionBy("path_id").orderBy("n", "k")
    kept = dense.withColumn("gone", far <= reach * reach).withColumn("piece", F.sum(F.when(F.col("gone"), 1).otherwise(0)).over(by)).where("NOT gone")
    return kept.groupBy("path_id", "piece").agg(F.count("*").alias("points"), F.min_by("x", F.struct("n", "k")).alias("x_first"), F.max_by("x", F.struct("n", "k")).alias("x_last")).where("points > 1")


def smooth(points: Column, passes: int = 2) -> Column:
    """Corner cutting of an array of (x, y), ends kept."""
    for _ in range(passes):
        pairs = F.arrays_zip(F.slice(points, 1, F.size(points) - 1).alias("a"), F.slice(points, 2, F.size(points) - 1).alias("b"))
        near = lambda a, b, t: F.struct(*[(a[c] * (1 - t) + b[c] * t).alias(c) for c in "xy"])
        cut = F.flatten(F.transform(pairs, lambda p: F.array(near(p["a"], p["b"], 0.25), near(p["a"], p["b"], 0.75))))
        points = F.when(F.size(points) > 2, F.concat(F.slice(points, 1, 1), cut, F.slice(points, -1, 1))).otherwise(points)
    return points


def normalise_url(url: Column) -> Column:
    """``https://`` where an address has no scheme."""
    return F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), url).otherwise(F.concat(F.lit("https://"), url))
