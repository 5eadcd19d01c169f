"""Queries of placement on pages, geometry and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import pages as pg
from folio.operators import place as pl
from folio.plans.pages import BOX_SQL
from folio.plans.registry import query

DIMS_SQL = f"SELECT doc_id, page_no, CASE WHEN rotate % 180 <> 0 THEN vy1 - vy0 ELSE vx1 - vx0 END AS dw, CASE WHEN rotate % 180 <> 0 THEN vx1 - vx0 ELSE vy1 - vy0 END AS dh FROM ({BOX_SQL})"


def dims(t):
    return pg.display_dims(pg.page_dims(t.fx_pages))


@query("stamp_number", "SELECT doc_id, page_no, concat('Page ', page_no - 1 + 5 - 1, ' of ', n - 1 + 5 - 1) AS label FROM (SELECT doc_id, page_no, count(*) OVER (PARTITION BY doc_id) AS n FROM fx_pages) WHERE page_no > 1", "fx_pages")
def stamp_number(t):
    return pl.page_labels(t.fx_pages.select("doc_id", "page_no"), "page-n-of-total", 5, True)


@query("stamp_number_pos", f"""
SELECT doc_id, page_no, CASE WHEN page_no % 2 = 0 THEN 18.0::DOUBLE ELSE dw - 18 - length(label) * 6.0::DOUBLE END AS lx, dh - 18 - 7.2::DOUBLE AS ly FROM (SELECT *, concat(page_no, ' / ', count(*) OVER (PARTITION BY doc_id)) AS label FROM ({DIMS_SQL}))""", "fx_pages")  # fmt: skip
def stamp_number_pos(t):
    return pl.label_positions(pl.page_labels(dims(t)), "tr", mirror=True).select("doc_id", "page_no", "lx", "ly")


@query("stamp_watermark", f"""
WITH r AS (SELECT doc_id, page_no, dw, dh, unnest(range(0, 40)) AS i FROM ({DIMS_SQL})), y AS (SELECT *, 60.0::DOUBLE + i * 120.0::DOUBLE AS wy, (i + 1) % 2 * 280.0::DOUBLE / 2 AS s FROM r WHERE 60 + i * 120 < dh + 120),
x AS (SELECT *, unnest(range(0, 40)) AS j FROM y) SELECT doc_id, page_no, s + j * 280.0::DOUBLE AS wx, wy FROM x WHERE s + j * 280 < dw + 280""", "fx_pages")  # fmt: skip
def stamp_watermark(t):
    return pl.watermark_grid(dims(t), 200, 24)


@query("stamp_layering", """
SELECT doc_id, page_no, CASE WHEN page_no % 3 = 0 THEN 'body' || page_no WHEN page_no % 3 = 1 THEN 'mark,save,body' || page_no || ',restore' ELSE 'save,body' || page_no || ',restore,mark' END AS content FROM fx_pages""", "fx_pages")  # fmt: skip
def stamp_layering(t):
    p = t.fx_pages.select("doc_id", "page_no", F.array(F.concat(F.lit("body"), F.col("page_no").cast("string"))).alias("content"))
    stamps = t.fx_pages.where("page_no % 3 <> 0").select("doc_id", "page_no", F.lit("mark").alias("stamp"), (F.col("page_no") % 3 == 1).alias("under"))
    return pl.layer_order(p, stamps).select("doc_id", "page_no", F.array_join("content", ",").alias("content"))


@query("geom_display", f"""
SELECT doc_id, page_no, CASE rotate WHEN 90 THEN 70 - vy0 WHEN 180 THEN vx1 - 50 WHEN 270 THEN vy1 - 70 ELSE 50 - vx0 END AS dx, CASE rotate WHEN 90 THEN 50 - vx0 WHEN 180 THEN 70 - vy0 WHEN 270 THEN vx1 - 50 ELSE vy1 - 70 END AS dy, 50 AS px, 70 AS py FROM ({BOX_SQL})""", "fx_pages")  # fmt: skip
def geom_display(t):
    box = pg.norm_rotation(pg.visible_box(t.fx_pages)).withColumns({"px": F.lit(50), "py": F.lit(70)})
    return pl.to_user(pl.to_display(box).drop("px", "py")).select("doc_id", "page_no", "dx", "dy", "px", "py")


@query("geom_affine", "SELECT doc_id, page_no, 2.0::DOUBLE * (x1 - y1) + page_no AS tx, 2.0::DOUBLE * (x1 + y1) + 10 AS ty FROM fx_pages", "fx_pages")
def geom_affine(t):
    outer = F.array(*[F.lit(v) for v in (2.0, 0.0, 0.0, 2.0)], F.col("page_no").cast("double"), F.lit(10.0))
    inner = F.array(*[F.lit(v) for v in (1.0, 1.0, -1.0, 1.0, 0.0, 0.0)])
    rows = t.fx_pages.select("doc_id", "page_no", F.col("x1").alias("x"), F.col("y1").alias("y"), F.array(outer, inner).alias("chain"))
    return pl.apply_chain(rows).select("doc_id", "page_no", "tx", "ty")


RECTS_SQL = "SELECT doc_id, page_no, 20 AS rx, 30 AS ry, CAST(doc_id % 60 AS INT) AS rw, 90 AS rh FROM fx_pages"
USER_X = "CASE rotate WHEN 90 THEN {y} + vx0 WHEN 180 THEN vx1 - {x} WHEN 270 THEN vx1 - {y} ELSE {x} + vx0 END"
USER_Y = "CASE rotate WHEN 90 THEN {x} + vy0 WHEN 180 THEN {y} + vy0 WHEN 270 THEN vy1 - {x} ELSE vy1 - {y} END"


@query("crop_pages", f"""
SELECT doc_id, page_no, least(ax, ox) AS cx0, least(ay, oy) AS cy0, greatest(ax, ox) AS cx1, greatest(ay, oy) AS cy1 FROM (
SELECT b.doc_id, b.page_no, {USER_X.format(x='rx', y='ry')} AS ax, {USER_Y.format(x='rx', y='ry')} AS ay, {USER_X.format(x='(rx + rw)', y='(ry + rh)')} AS ox, {USER_Y.format(x='(rx + rw)', y='(ry + rh)')} AS oy
FROM ({BOX_SQL}) b JOIN ({RECTS_SQL}) r ON b.doc_id = r.doc_id AND b.page_no = r.page_no WHERE rw > 1 AND rh > 1)""", "fx_pages")  # fmt: skip
def crop_pages(t):
    return pl.crop(pg.norm_rotation(pg.visible_box(t.fx_pages)), t.sql(RECTS_SQL))


@query("crop_margins", f"SELECT doc_id, page_no, dw * 0.125::DOUBLE AS rx, dh * 0.25::DOUBLE AS ry, dw * 0.75::DOUBLE AS rw, dh * 0.75::DOUBLE AS rh FROM ({DIMS_SQL}) WHERE page_no % 2 = 0", "fx_pages")
def crop_margins(t):
    return pl.margins_to_rects(dims(t), {"l": 0.125, "r": 0.125, "t": 0.25}, "even")


INK_SQL = "SELECT image_id, x, y, CASE WHEN x < image_id % 4 OR y > 6 - image_id % 3 OR image_id % 40 = 0 THEN 255 ELSE r END AS r, CASE WHEN x < image_id % 4 OR y > 6 - image_id % 3 OR image_id % 40 = 0 THEN 255 ELSE g END AS g, CASE WHEN x < image_id % 4 OR y > 6 - image_id % 3 OR image_id % 40 = 0 THEN 255 ELSE b END AS b FROM fx_pixels"


@query("crop_auto", f"""
SELECT image_id, {', '.join(f"CASE WHEN x0 IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(0.45::DOUBLE, {v} - 0.015::DOUBLE)) END AS {n}" for n, v in (('l', 'x0 / 8.0::DOUBLE'), ('t', 'y0 / 8.0::DOUBLE'), ('r', '1 - (x1 + 1) / 8.0::DOUBLE'), ('b', '1 - (y1 + 1) / 8.0::DOUBLE')))} FROM (
SELECT image_id, min(CASE WHEN d THEN x END) AS x0, max(CASE WHEN d THEN x END) AS x1, min(CASE WHEN d THEN y END) AS y0, max(CASE WHEN d THEN y END) AS y1 FROM (SELECT *, r < 245 OR g < 245 OR b < 245 AS d FROM ({INK_SQL})) GROUP BY image_id)""", "fx_pixels")  # fmt: skip
def crop_auto(t):
    return pl.content_margins(t.sql(INK_SQL))


TURNED_SQL = "SELECT asset_id, w, h, CAST(90 * (asset_id % 4) AS INT) AS turn FROM fx_images"


@query("image_layout", f"""
WITH v AS (SELECT asset_id, turn, CASE WHEN turn % 180 <> 0 THEN h ELSE w END AS vw, CASE WHEN turn % 180 <> 0 THEN w ELSE h END AS vh FROM ({TURNED_SQL})),
p AS (SELECT *, CASE WHEN vw > vh THEN 842.0::DOUBLE ELSE 595.0::DOUBLE END AS pw, CASE WHEN vw > vh THEN 595.0::DOUBLE ELSE 842.0::DOUBLE END AS ph FROM v),
s AS (SELECT *, least((pw - 40) / vw, (ph - 40) / vh) AS k FROM p)
SELECT asset_id, pw, ph, round(vw * k, 4) AS dw, round(vh * k, 4) AS dh, round(CASE turn WHEN 0 THEN (pw - vw * k) / 2 WHEN 90 THEN (pw - vw * k) / 2 ELSE (pw - vw * k) / 2 + vw * k END, 4) AS mx, round(CASE WHEN turn IN (90, 180) THEN (ph - vh * k) / 2 + vh * k ELSE (ph - vh * k) / 2 END, 4) AS my FROM s""", "fx_images")  # fmt: skip
def image_layout(t):
    done = pl.image_pages(t.sql(TURNED_SQL), "a4", "auto", 20)
    return done.select("asset_id", "pw", "ph", F.round("dw", 4).alias("dw"), F.round("dh", 4).alias("dh"), F.round(F.get("matrix", F.lit(4)), 4).alias("mx"), F.round(F.get("matrix", F.lit(5)), 4).alias("my"))


@query("shape_turn", """
SELECT shape_id, CASE WHEN o THEN 792 - y - h + h / 2 - w / 2 ELSE 792 - y - h END AS x, CASE WHEN o THEN x + w / 2 - h / 2 ELSE x END AS y, CASE WHEN o THEN w ELSE h END AS w, CASE WHEN o THEN h ELSE w END AS h, CASE WHEN o THEN (rot + 90) % 360 ELSE rot END AS rot FROM (SELECT *, t IN ('stamp', 'polygon') AS o FROM fx_shapes)""", "fx_shapes")  # fmt: skip
def shape_turn(t):
    return pl.turn(t.fx_shapes, 612, 792).select("shape_id", "x", "y", "w", "h", "rot")


PATHS_SQL = "SELECT user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS n, CAST(event_id % 97 AS DOUBLE) AS x, CAST(event_id * 7 % 89 AS DOUBLE) AS y FROM events"
DISCS_SQL = "SELECT DISTINCT user_id AS path_id, CAST(user_id % 90 AS DOUBLE) AS dx, CAST(user_id % 70 AS DOUBLE) AS dy, CAST(6 + user_id % 9 AS DOUBLE) AS r FROM events"


@query("path_cut", f"""
WITH a AS (SELECT p.*, dx, dy, r, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM ({PATHS_SQL}) p JOIN ({DISCS_SQL}) d ON p.path_id = d.path_id WINDOW w AS (PARTITION BY p.path_id ORDER BY n)),
b AS (SELECT *, CAST(greatest(1, coalesce(floor(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) / greatest(1.0, r / 2)), 1)) AS INT) AS steps FROM a), c AS (SELECT *, unnest(range(1, steps + 1)) AS k FROM b),
d AS (SELECT path_id, n, k, CASE WHEN k = steps THEN x ELSE x0 + (x - x0) * (k / steps::DOUBLE) END AS x, CASE WHEN k = steps THEN y ELSE y0 + (y - y0) * (k / steps::DOUBLE) END AS y, dx, dy, r FROM c),
e AS (SELECT *, (x - dx) * (x - dx) + (y - dy) * (y - dy) <= (r + 1) * (r + 1) AS gone FROM d), f AS (SELECT *, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY n, k) AS BIGINT) AS piece FROM e)
SELECT path_id, piece, count(*) AS points, arg_min(x, n * 1000 + k) AS x_first, arg_max(x, n * 1000 + k) AS x_last FROM f WHERE NOT gone GROUP BY path_id, piece HAVING count(*) > 1""")  # fmt: skip
def path_cut(t):
    return pl.cut_paths(t.sql(PATHS_SQL), t.sql(DISCS_SQL))


def smooth_sql(src: str) -> str:
    return f"""SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY n, k) AS INT) AS n, x, y, count(*) OVER (PARTITION BY path_id) AS total FROM (
 SELECT path_id, n, 0 AS k, x, y FROM ({src}) WHERE n = 1 UNION ALL SELECT path_id, n, 9, x, y FROM ({src}) WHERE n = total
 UNION ALL SELECT path_id, n, j, x + (nx - x) * CASE WHEN j = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END, y + (ny - y) * CASE WHEN j = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END FROM (SELECT *, lead(x) OVER (PARTITION BY path_id ORDER BY n) AS nx, lead(y) OVER (PARTITION BY path_id ORDER BY n) AS ny FROM ({src})), (VALUES (1), (2)) v(j) WHERE nx IS NOT NULL)"""


LONG_SQL = f"SELECT *, count(*) OVER (PARTITION BY path_id) AS total FROM ({PATHS_SQL})"


@query("path_smooth", f"""
SELECT path_id, n, round(x, 6) AS x, round(y, 6) AS y FROM ({smooth_sql(smooth_sql(f'SELECT * FROM ({LONG_SQL}) WHERE total > 2'))})
UNION ALL SELECT path_id, n, round(x, 6), round(y, 6) FROM ({LONG_SQL}) WHERE total <= 2""")  # fmt: skip
def path_smooth(t):
    paths = t.sql(PATHS_SQL).groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("p"))
    each = paths.select("path_id", F.posexplode(pl.smooth(F.col("p"))).alias("n", "q"))
    return each.select("path_id", (F.col("n") + 1).alias("n"), F.round("q.x", 6).alias("x"), F.round("q.y", 6).alias("y"))


@query("link_normalise", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://' || substr(url, position('//' IN url) + 2) ELSE url END AS url FROM pages")
def link_normalise(t):
    bare = F.when(F.col("page_id") % 3 == 0, F.expr("substr(url, locate('//', url) + 2)")).otherwise(F.col("url"))
    return t.pages.select("page_id", pl.normalise_url(bare).alias("url"))
