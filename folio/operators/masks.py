"""Masks (image_id, x, y, m) with m from 0 to 255: shapes, combination, growth and use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import half_up
from folio.operators.components import pixels_of, reached_runs
from folio.operators.raster import KEY, box_sums, by_column, by_row


def mask_rect(grid: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    x0, x1, y0, y1 = (half_up(F.lit(float(v))) for v in (min(x, x + w), max(x, x + w), min(y, y + h), max(y, y + h)))
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    return grid.withColumn("m", F.when(inside, 255).otherwise(0))


def mask_ellipse(grid: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Each row filled between the rounded ends of its chord through the pixels' centres."""
    cx, cy, rx, ry = x + w / 2, y + h / 2, abs(w / 2), abs(h / 2)
    if rx < 0.5 or ry < 0.5:
        return grid.withColumn("m", F.lit(0))
    dy = (F.col("y") + 0.5 - cy) / ry
    half = F.sqrt(F.greatest(1 - dy * dy, F.lit(0.0))) * rx
    inside = (dy * dy <= 1) & (F.col("x") >= half_up(cx - half)) & (F.col("x") < half_up(cx + half))
    return grid.withColumn("m", F.when(inside, 255).otherwise(0))


def mask_polygon(grid: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """Even-odd fill: a pixel is inside if an odd number of rounded crossings lie at or before it."""
    sy, crossed = F.col("y") + 0.5, F.lit(0)
    for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]]):
        if yi != yj:
            at = half_up(xi + (sy - yi) / (yj - yi) * (xj - xi))
            crosses = (F.lit(yi) > sy) != (F.lit(yj) > sy)
            crossed = crossed + F.when(crosses & (at <= F.col("x")), 1).otherwise(0)
    return grid.withColumn("m", F.when(crossed % 2 == 1, 255).otherwise(0))


def combine(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """replace, add, subtract or intersect; pixels that one lacks count as 0."""
    both = a.join(b.withColumnRenamed("m", "n"), KEY, "full").na.fill(0, ["m", "n"])
    m, n = F.col("m"), F.col("n")
    how = {"replace": n, "add": F.greatest(m, n), "subtract": F.least(m, 255 - n), "intersect": F.least(m, n)}
    return both.withColumn("m", how[mode]).drop("n")


def invert(mask: DataFrame) -> DataFrame:
    return mask.withColumn("m", 255 - F.col("m"))


def mask_bounds(mask: DataFrame, above: int = 0) -> DataFrame:
    """The box of each image's pixels above a level, null if it has none."""
    seen = F.col("m") > above
    x, y = F.when(seen, F.col("x")), F.when(seen, F.col("y"))
    return mask.groupBy("image_id").agg(F.min(x).alias("bx"), F.min(y).alias("by"), (F.max(x) - F.min(x) + 1).alias("bw"), (F.max(y) - F.min(y) + 1).alias("bh"))


def feather(mask: DataFrame, radius: int) -> DataFrame:
    """Two box passes each way, edges repeated."""
    return box_sums(mask, radius, 2, "m").withColumn("m", half_up(F.col("m") / (2 * radius + 1) ** 4).cast("int"))


def grow(mask: DataFrame, radius: int) -> DataFrame:
    """Square dilation (radius above 0) or erosion (below); outside counts as 0."""
    n, rows = abs(radius), mask.repartition("image_id")
    for order in (by_row(), by_column()):
        near, whole = order.rowsBetween(-n, n), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        inner = (F.row_number().over(order) > n) & (F.row_number().over(order) <= F.count("*").over(whole) - n)
        v = F.max("m").over(near) if radius > 0 else F.when(inner, F.min("m").over(near)).otherwise(0)
        rows = rows.withColumn("m", v)
    return rows


def outline(mask: DataFrame) -> DataFrame:
    """Boundary segments (image_id, x1, y1, x2, y2), runs merged along rows and columns."""
    inside = mask.where("m >= 128").select(*KEY)

    def runs(dx: int, dy: int, along: str, across: str) -> DataFrame:
        # both sides of every inside pixel; a side that two pixels share is no boundary
        sides = inside.select("image_id", F.explode(F.array(F.struct("x", "y"), F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")))).alias("s")).select("image_id", "s.x", "s.y")
        edge = sides.groupBy("image_id", "x", "y").agg(F.count("*").alias("n")).where("n = 1")
        order = Window.partitionBy("image_id", across).orderBy(along)
        run = edge.withColumn("run", F.col(along) - F.row_number().over(order)).groupBy("image_id", across, "run").agg(F.min(along).alias("a"), (F.max(along) + 1).alias("b"))
        c, a, b = F.col(across), F.col("a"), F.col("b")
        ends = (a, c, b, c) if along == "x" else (c, a, c, b)
        return run.select("image_id", *[e.alias(n) for e, n in zip(ends, ("x1", "y1", "x2", "y2"))])

    return runs(0, 1, "x", "y").unionByName(runs(1, 0, "y", "x"))


def near_seed(px: DataFrame, seeds: DataFrame, tolerance: int) -> DataFrame:
    """Pixels within a tolerance of their image's seed colour (image_id, sx, sy); transparent ones
    are alike whatever their colour."""
    at = seeds.withColumnsRenamed({"sx": "x", "sy": "y"})
    colour = px.join(at, KEY).select("image_id", *[F.col(c).alias(f"s{c}") for c in "rgba"])
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"s{c}")) for c in "rgba"])
    alike = ((F.col("sa") == 0) & (F.col("a") == 0)) | (far <= tolerance)
    return px.join(colour, "image_id").where(alike).select(*KEY)


def similar(px: DataFrame, seeds: DataFrame, tolerance: int = 32) -> DataFrame:
    hit = near_seed(px, seeds, tolerance).withColumn("hit", F.lit(True))
    return px.select(*KEY).join(hit, KEY, "left").select(*KEY, F.when(F.col("hit"), 255).otherwise(0).alias("m"))


def flood(px: DataFrame, seeds: DataFrame, tolerance: int = 32) -> DataFrame:
    """The part of ``similar`` that is connected to the seed."""
    reached = pixels_of(reached_runs(seeds.withColumnsRenamed({"sx": "x", "sy": "y"}), near_seed(px, seeds, tolerance))).withColumn("hit", F.lit(True))
    return px.select(*KEY).join(reached, KEY, "left").select(*KEY, F.when(F.col("hit"), 255).otherwise(0).alias("m"))


def blend_masked(dst: DataFrame, src: DataFrame, mask: DataFrame) -> DataFrame:
    rows = dst.join(src.select(*KEY, *[F.col(c).alias(f"s{c}") for c in "rgba"]), KEY).join(mask, KEY, "left")
    t = F.coalesce("m", F.lit(0)) / 255
    return rows.withColumns({c: half_up(F.col(c) + (F.col(f"s{c}") - F.col(c)) * t).cast("int") for c in "rgba"}).select(*KEY, *"rgba")


def clear_masked(px: DataFrame, mask: DataFrame) -> DataFrame:
    return px.join(mask, KEY, "left").withColumn("a", half_up(F.col("a") * (1 - F.coalesce("m", F.lit(0)) / 255)).cast("int")).select(*KEY, *"rgba")


def fill_masked(px: DataFrame, mask: DataFrame, color: tuple[int, int, int, int]) -> DataFrame:
    flat = px.select(*KEY, *[F.lit(v).alias(c) for c, v in zip("rgba", color)])
    return blend_masked(px, flat, mask)


def alpha_mask(px: DataFrame) -> DataFrame:
    return px.select(*KEY, F.col("a").alias("m"))


def extract_layer(px: DataFrame, mask: DataFrame, cut: bool) -> DataFrame:
    """The selected pixels as a layer above; cut out of the one below if asked for."""
    taken = px.join(mask.where("m > 0"), KEY).withColumn("a", half_up(F.col("a") * F.col("m") / 255).cast("int")).select(*KEY, *"rgba", F.lit(1).alias("z"))
    below = clear_masked(px, mask) if cut else px.select(*KEY, *"rgba")
    return below.withColumn("z", F.lit(0)).unionByName(taken)


