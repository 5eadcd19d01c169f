"""Drawn objects on pages: their primitives with vertices, bounds at any angle, hits and containment.

A shape has ``t`` (stroke, highlight, hlrects, line, rect, ellipse, poly, whiteout, text, image, mark,
stamp, note, link, imgremove), a box ``x, y, w, h``, ``rot`` in degrees clockwise about the
centre, ``pts`` (x, y, w) of strokes and lines, ``rects`` of text highlights, and its looks.

Joins of points with areas go through cells of several levels (``in_areas``): an area is dealt to four
cells at most of its own size, a point looked up once for each size that occurs on its page.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds that turn about their centre, sizes and strengths where none is given.
TURNING = ("text", "image", "rect", "ellipse", "whiteout", "stamp", "mark", "poly")
WIDTH, HIGHLIGHT_ALPHA, INNER, NOTE = 2.0, 0.4, 0.45, 22.0
#: Side of the smallest cell, in points.
CELL = 32.0


def in_areas(points: DataFrame, areas: DataFrame, keys: list[str], px: str = "px", py: str = "py") -> DataFrame:
    """Pairs of a point and an area (``x0, y0, x1, y1``) around it, edges included, of equal ``keys``,
    each once.  Widths and heights have their own levels, so thin areas get thin cells.  Cells are many
    more rows than Spark expects of their table, so neither join may broadcast them."""

    def level(size: Column) -> Column:
        return F.ceil(F.log2(F.greatest(size, F.lit(CELL)) / CELL)).cast("int")

    def cell(at: Column, level: Column) -> Column:
        return F.floor(at / (F.pow(F.lit(2.0), level) * CELL))

    leveled = areas.withColumns({"__lx": level(F.col("x1") - F.col("x0")), "__ly": level(F.col("y1") - F.col("y0"))})
    dealt = leveled.withColumn("__cx", F.explode(F.sequence(cell(F.col("x0"), F.col("__lx")), cell(F.col("x1"), F.col("__lx")))))
    dealt = dealt.withColumn("__cy", F.explode(F.sequence(cell(F.col("y0"), F.col("__ly")), cell(F.col("y1"), F.col("__ly")))))
    there = leveled.groupBy(*keys).agg(F.collect_set(F.struct("__lx", "__ly")).alias("__levels"))
    asked = points.join(there.hint("merge"), keys).withColumn("__level", F.explode("__levels")).drop("__levels")
    asked = asked.withColumns({"__lx": F.col("__level.__lx"), "__ly": F.col("__level.__ly")}).drop("__level")
    asked = asked.withColumns({"__cx": cell(F.col(px), F.col("__lx")), "__cy": cell(F.col(py), F.col("__ly"))})
    met = asked.join(dealt.hint("merge"), [*keys, "__lx", "__ly", "__cx", "__cy"]).drop("__lx", "__ly", "__cx", "__cy")
    return met.where(F.col(px).between(F.col("x0"), F.col("x1")) & F.col(py).between(F.col("y0"), F.col("y1")))


def width_of(*given) -> Column:
    return F.coalesce(*given, F.lit(WIDTH))


def with_box(shapes: DataFrame) -> DataFrame:
    """``bx, by, bw, bh``: the box along the axes before the shape is turned."""
    t = F.col("t")

    def ends(axis: str, size: str) -> tuple[Column, Column]:
        half = lambda p: width_of(p["w"], F.col("width")) / 2 + 1
        at = lambda i: F.get("pts", F.lit(i))[axis]
        grow = width_of(F.col("width")) / 2 + 3
        low = F.when(t.isin("stroke", "highlight"), F.array_min(F.transform("pts", lambda p: p[axis] - half(p)))).when(t == "line", F.least(at(0), at(1)) - grow)
        high = F.when(t.isin("stroke", "highlight"), F.array_max(F.transform("pts", lambda p: p[axis] + half(p)))).when(t == "line", F.greatest(at(0), at(1)) + grow)
        low = low.when(t == "hlrects", F.array_min(F.transform("rects", lambda r: r[axis]))).otherwise(F.col(axis))
        high = high.when(t == "hlrects", F.array_max(F.transform("rects", lambda r: r[axis] + r[size])))
        return low, high.when(t == "note", F.col(axis) + NOTE).otherwise(F.col(axis) + F.col(size))

    (x0, x1), (y0, y1) = ends("x", "w"), ends("y", "h")
    return shapes.withColumns({"bx": x0, "by": y0, "__bx1": x1, "__by1": y1}).withColumns({"bw": F.col("__bx1") - F.col("bx"), "bh": F.col("__by1") - F.col("by")}).drop("__bx1", "__by1")


def angle() -> Column:
    """Radians that a shape is turned by."""
    return F.when(F.col("t").isin(*TURNING), F.radians(F.coalesce(F.col("rot"), F.lit(0)).cast("double"))).otherwise(0.0)


def with_frame(shapes: DataFrame) -> DataFrame:
    """The box, its centre and the sine and cosine of the turn, each computed once."""
    return with_box(shapes).withColumns({"mx": F.col("bx") + F.col("bw") / 2, "my": F.col("by") + F.col("bh") / 2, "sine": F.sin(angle()), "cosine": F.cos(angle())})


def extent(grow=0.0) -> tuple[Column, Column]:
    """Half the width and height of the turned box, after it has grown."""
    w, h, s, c = F.col("bw") / 2 + grow, F.col("bh") / 2 + grow, F.abs("sine"), F.abs("cosine")
    return w * c + h * s, w * s + h * c


def bounds(shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``ox, oy, ow, oh``, the box along the axes around the turned shape."""
    ex, ey = extent()
    return with_frame(shapes).withColumns({"ox": F.col("mx") - ex, "oy": F.col("my") - ey, "ow": 2 * ex, "oh": 2 * ey}).drop("bx", "by", "bw", "bh", "mx", "my", "sine", "cosine")


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """How far a point is from the segment between two others."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    part = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / square))).otherwise(0.0)
    ax, ay = a["x"] + part * dx - x, a["y"] + part * dy - y
    return F.sqrt(ax * ax + ay * ay)


def hits(points: DataFrame, shapes: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(point_id, shape_id) of points on shapes of their page: along strokes and lines by distance, on
    the outline of hollow shapes, in full ones, in the shape's own turned frame; never on
    hidden or locked ones or marks of removal."""
    live = ~F.coalesce("hidden", F.lit(False)) & ~F.coalesce("locked", F.lit(False)) & (F.col("t") != "imgremove")
    t, hollow = F.col("t"), F.col("t").isin("rect", "ellipse", "poly") & ~F.coalesce("filled", F.lit(False))
    band = width_of(F.col("width")) / 2 + tolerance
    # a segment is as wide as its second point, so the widest one reaches beyond the box at any other
    widest = F.greatest(F.array_max(F.transform("pts", lambda p: width_of(p["w"], F.col("width")))), width_of(F.col("width"))) / 2
    reach = F.when(hollow, band).when(t.isin("stroke", "highlight"), widest + max(tolerance, 2.0)).when(t == "line", F.lit(max(tolerance, 1.0))).when(t == "hlrects", 0.0).otherwise(2.0)
    framed = with_frame(shapes.where(live)).withColumn("reach", reach)
    ex, ey = extent(F.col("reach"))
    areas = framed.withColumns({"x0": F.col("mx") - ex, "y0": F.col("my") - ey, "x1": F.col("mx") + ex, "y1": F.col("my") + ey}).drop("x", "y", "w", "h")
    near = in_areas(points.select("page_key", "point_id", "px", "py"), areas, ["page_key"])
    dx, dy = F.col("px") - F.col("mx"), F.col("py") - F.col("my")
    near = near.withColumns({"lx": F.col("mx") + dx * F.col("cosine") + dy * F.col("sine"), "ly": F.col("my") - dx * F.col("sine") + dy * F.col("cosine")})
    x, y, x1, y1 = F.col("lx"), F.col("ly"), F.col("bx") + F.col("bw"), F.col("by") + F.col("bh")
    first, many = F.get("pts", F.lit(0)), F.size("pts")
    alone = F.hypot(x - first["x"], y - first["y"]) < F.greatest(F.lit(tolerance), width_of(F.col("width")) / 2 + 2)
    along = F.zip_with(F.slice("pts", F.lit(1), F.greatest(many - 1, F.lit(0))), F.slice("pts", F.lit(2), F.greatest(many - 1, F.lit(0))), lambda a, b: segment_distance(x, y, a, b) < width_of(b["w"], F.col("width")) / 2 + tolerance)
    around = lambda by: x.between(F.col("bx") - by, x1 + by) & y.between(F.col("by") - by, y1 + by)
    within = (x > F.col("bx") + band) & (x < x1 - band) & (y > F.col("by") + band) & (y < y1 - band)
    hit = (
        F.when(t.isin("stroke", "highlight"), F.when(many == 1, alone).otherwise(F.exists(along, lambda on: on)))
        .when(t == "line", segment_distance(x, y, first, F.get("pts", F.lit(1))) < F.greatest(F.lit(tolerance), width_of(F.col("width")) / 2 + 3))
        .when(t == "hlrects", F.exists("rects", lambda r: x.between(r["x"], r["x"] + r["w"]) & y.between(r["y"], r["y"] + r["h"])))
        .when(hollow, around(band) & ~within)
        .otherwise(around(F.lit(2.0)))
    )
    return near.where(hit).select("point_id", "shape_id")


def contained(shapes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box_id, shape_id) of shapes wholly inside a box of their page; hidden and locked ones never.
    A shape is looked up by its centre, so it meets a box in one cell only."""
    live = ~F.coalesce("hidden", F.lit(False)) & ~F.coalesce("locked", F.lit(False)) & (F.col("t") != "imgremove")
    inner = bounds(shapes.where(live)).select("page_key", "shape_id", "ox", "oy", "ow", "oh", (F.col("ox") + F.col("ow") / 2).alias("px"), (F.col("oy") + F.col("oh") / 2).alias("py"))
    areas = boxes.select("page_key", "box_id", F.col("qx").alias("x0"), F.col("qy").alias("y0"), (F.col("qx") + F.col("qw")).alias("x1"), (F.col("qy") + F.col("qh")).alias("y1"))
    inside = (F.col("ox") >= F.col("x0")) & (F.col("oy") >= F.col("y0")) & (F.col("ox") + F.col("ow") <= F.col("x1")) & (F.col("oy") + F.col("oh") <= F.col("y1"))
    return in_areas(inner, areas, ["page_key"]).where(inside).select("box_id", "shape_id")


def vertex(cmd, x, y, width=None) -> Column:
    return F.struct(F.lit(cmd).cast("string").alias("cmd"), x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(None) if width is None else width).cast("double").alias("width"))


def path(points: Column, closed: bool = False) -> Column:
    """(x, y) points as vertices: a move, then lines."""
    made = F.transform(points, lambda p, i: F.struct(F.when(i == 0, "M").otherwise("L").alias("cmd"), p["x"].alias("x"), p["y"].alias("y"), F.lit(None).cast("double").alias("width")))
    return F.concat(made, F.array(vertex("Z", F.lit(None), F.lit(None)))) if closed else made


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(*[vertex("L" if i else "M", a, b) for i, (a, b) in enumerate([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])])


def polygon(x: Column, y: Column, w: Column, h: Column, kind: Column, sides: Column, inner: Column) -> Column:
    """Corners (x, y) of a triangle, star or regular polygon in a box, the first at the top."""
    n = F.greatest(F.lit(3), F.least(F.lit(24), F.coalesce(sides, F.when(kind == "triangle", 3).otherwise(5))))
    cx, cy, rx, ry = x + w / 2, y + h / 2, w / 2, h / 2

    def ring(count: Column, part) -> Column:
        def at(i):
            turn = F.lit(-math.pi / 2) + i * F.lit(2 * math.pi) / count
            return F.struct((cx + F.cos(turn) * rx * part(i)).alias("x"), (cy + F.sin(turn) * ry * part(i)).alias("y"))

        return F.transform(F.sequence(F.lit(0), count - 1), at)

    star = ring(n * 2, lambda i: F.when(i % 2 == 1, F.coalesce(inner, F.lit(INNER))).otherwise(1.0))
    triangle = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((cx, y), (x + w, y + h), (x, y + h))])
    return F.when(kind == "triangle", triangle).when(kind == "star", star).otherwise(ring(n, lambda i: F.lit(1.0)))


def expand_shapes(shapes: DataFrame) -> DataFrame:
    """Primitives of each shape, a row for each vertex where it comes to lie: ``n`` and ``kind`` of the
    primitive, ``part`` (whole, or fill and outline where the fill is translucent), line width,
    strength, then ``v``, ``cmd``, ``vx``, ``vy`` and ``vwidth`` of the vertex."""
    x, y, w, h, t, kind, width, alpha = (F.col(c) for c in ("x", "y", "w", "h", "t", "kind", "width", "alpha"))
    filled, stroked = F.coalesce("filled", F.lit(False)), F.coalesce("stroked", F.lit(False))
    double = lambda c: c.cast("double")

    def prim(name, points, lw=None, strength=alpha, part="whole") -> Column:
        return F.struct(F.lit(name).cast("string").alias("kind") if isinstance(name, str) else name.alias("kind"), F.lit(part).alias("part"), double(F.lit(None) if lw is None else lw).alias("lw"), double(strength).alias("alpha"), points.alias("points"))

    def filled_or_split(name, points, lw) -> Column:
        """A fill of its own strength is drawn apart from the outline."""
        strength = F.coalesce(alpha, F.lit(1.0))
        fill, line = prim(name, points, lw, strength * F.col("fill_alpha"), "fill"), prim(name, points, lw, strength, "outline")
        split = F.when(stroked & (lw > 0), F.array(fill, line)).otherwise(F.array(fill))
        return F.when(filled & (F.col("fill_alpha") < 1), split).otherwise(F.array(prim(name, points, lw)))

    box = corners(x, y, w, h)
    size = h * 0.5
    made = (
        F.when(F.coalesce("hidden", F.lit(False)) | (t == "imgremove"), F.lit(None))
        .when(t == "stroke", F.array(prim("vstroke", F.transform("pts", lambda p, i: F.struct(F.when(i == 0, "M").otherwise("L").alias("cmd"), p["x"].alias("x"), p["y"].alias("y"), double(F.coalesce(p["w"], width)).alias("width"))))))
        .when(t == "highlight", F.array(prim("highlight", path(F.col("pts")), width, F.coalesce(alpha, F.lit(HIGHLIGHT_ALPHA)))))
        .when(t == "hlrects", F.transform("rects", lambda r: prim("highlight", F.array(vertex("M", r["x"], r["y"] + r["h"] / 2), vertex("L", r["x"] + r["w"], r["y"] + r["h"] / 2)), r["h"], F.coalesce(alpha, F.lit(HIGHLIGHT_ALPHA)))))
        .when(t == "line", F.array(prim("line", path(F.col("pts")), width)))
        .when(t.isin("rect", "ellipse"), filled_or_split(t, box, width))
        .when(t == "poly", filled_or_split("path", path(polygon(x, y, w, h, kind, F.col("sides"), F.col("inner")), closed=True), F.when(stroked, width).otherwise(0.0)))
        .when(t == "whiteout", F.array(prim("rect", box, F.lit(0.0), F.lit(1.0))))
        .when((t == "mark") & (kind == "dot"), F.array(prim("ellipse", corners(x + w * 0.12, y + h * 0.12, w * 0.76, h * 0.76))))
        .when(t == "mark", F.array(prim("path", F.when(kind == "cross", F.array(vertex("M", x + w * 0.18, y + h * 0.18), vertex("L", x + w * 0.82, y + h * 0.82), vertex("M", x + w * 0.82, y + h * 0.18), vertex("L", x + w * 0.18, y + h * 0.82))).otherwise(F.array(vertex("M", x + w * 0.12, y + h * 0.55), vertex("L", x + w * 0.4, y + h * 0.82), vertex("L", x + w * 0.9, y + h * 0.2))), F.greatest(F.lit(1.0), F.least(w, h) * 0.12))))
        .when(t == "stamp", F.array(prim("rect", box, F.greatest(F.lit(1.0), h * 0.06)), prim("text", corners(x, y + h / 2 - size * 0.45, w, size * 0.9))))
        .when(t == "note", F.array(prim("note", F.array(vertex("M", x, y)), strength=F.lit(None))))
        .when(t == "link", F.array(prim("link", box, strength=F.lit(None))))
        .when(t.isin("image", "text"), F.array(prim(t, box)))
    )
    framed = with_frame(shapes).withColumn("made", made)
    prims = framed.select("page_key", "shape_id", "mx", "my", "sine", "cosine", F.posexplode("made").alias("n", "p"))
    rows = prims.select("page_key", "shape_id", "mx", "my", "sine", "cosine", "n", "p.kind", "p.part", "p.lw", "p.alpha", F.posexplode("p.points").alias("v", "at"))
    dx, dy = F.col("at.x") - F.col("mx"), F.col("at.y") - F.col("my")
    turned = {"vx": F.col("mx") + dx * F.col("cosine") - dy * F.col("sine"), "vy": F.col("my") + dx * F.col("sine") + dy * F.col("cosine")}
    return rows.withColumns(turned).select("page_key", "shape_id", "n", "kind", "part", "lw", "alpha", "v", "at.cmd", "vx", "vy", F.col("at.width").alias("vwidth"))


def drop_matching(uses: DataFrame, regions: DataFrame, least: float = 0.8) -> DataFrame:
    """``asset_id`` of images whose box and a region of their page share at least ``least`` of their union.
    Such boxes differ by a factor of 1 / ``least`` at most in width and height, and by 1 - ``least`` of the
    region in the place of their centres: size classes are keys, and the centre is looked up near the region's."""
    base = -math.log(least) * 1.000001
    size = lambda c: F.floor(F.log(F.col(c)) / base).cast("int")
    around = lambda c: F.explode(F.sequence(size(c) - 1, size(c) + 1))
    off = max(1 - least, (1 / least - 1) / 2) + 1e-9
    mx, my = F.col("rx") + F.col("rw") / 2, F.col("ry") + F.col("rh") / 2
    areas = regions.where("rw > 0 AND rh > 0").withColumn("__w", around("rw")).withColumn("__h", around("rh"))
    areas = areas.withColumns({"x0": mx - F.col("rw") * off, "x1": mx + F.col("rw") * off, "y0": my - F.col("rh") * off, "y1": my + F.col("rh") * off})
    points = uses.where("w > 0 AND h > 0").withColumns({"__w": size("w"), "__h": size("h"), "px": F.col("x") + F.col("w") / 2, "py": F.col("y") + F.col("h") / 2})
    near = in_areas(points.select("doc_id", "page_no", "__w", "__h", "px", "py", "asset_id", "x", "y", "w", "h"), areas, ["doc_id", "page_no", "__w", "__h"])
    ix = F.least(F.col("x") + F.col("w"), F.col("rx") + F.col("rw")) - F.greatest("x", "rx")
    iy = F.least(F.col("y") + F.col("h"), F.col("ry") + F.col("rh")) - F.greatest("y", "ry")
    inter = F.greatest(ix, F.lit(0)) * F.greatest(iy, F.lit(0))
    union = F.col("w") * F.col("h") + F.col("rw") * F.col("rh") - inter
    return near.where(inter >= least * union).select("asset_id").distinct()
