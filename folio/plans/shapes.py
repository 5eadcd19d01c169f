"""Queries of drawn objects: primitives, bounds, hits, containment, images under regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import shapes as sh
from folio.plans.registry import query

KIND = "CASE o_orderkey % 14 WHEN 0 THEN 'rect' WHEN 1 THEN 'ellipse' WHEN 2 THEN 'poly' WHEN 3 THEN 'mark' WHEN 4 THEN 'stamp' WHEN 5 THEN 'line' WHEN 6 THEN 'stroke' WHEN 7 THEN 'highlight' WHEN 8 THEN 'hlrects' WHEN 9 THEN 'whiteout' WHEN 10 THEN 'image' WHEN 11 THEN 'note' WHEN 12 THEN 'link' ELSE 'imgremove' END"
#: Shapes of every kind, 64 on a page, so that pages follow the table; for both engines, without lists.
FLAT_SQL = f"""
SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS page_key, o_orderkey AS shape_id, {KIND} AS t, CAST(o_orderkey * 91 % 523 AS DOUBLE) + 0.37 AS x, CAST(o_orderkey * 29 % 769 AS DOUBLE) + 0.53 AS y,
  CAST(20 + o_custkey % 97 AS DOUBLE) + 0.25 AS w, CAST(14 + o_orderkey * 3 % 71 AS DOUBLE) + 0.5 AS h, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey * 37 % 360 AS INT) END AS rot,
  o_orderkey % 17 = 0 AS hidden, o_orderkey % 19 = 3 AS locked, o_orderkey % 3 = 0 AS filled, o_orderkey % 4 <> 1 AS stroked, CASE WHEN o_orderkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) WHEN o_orderkey % 7 > 0 THEN CAST(1 AS DOUBLE) END AS fill_alpha,
  CASE WHEN o_orderkey % 11 > 0 THEN CAST(1 + o_orderkey % 4 AS DOUBLE) END AS width, CASE WHEN o_orderkey % 6 > 1 THEN CAST(0.75 AS DOUBLE) END AS alpha,
  CASE o_orderkey % 3 WHEN 0 THEN 'triangle' WHEN 1 THEN 'star' ELSE 'polygon' END AS poly_kind, CASE o_custkey % 3 WHEN 0 THEN 'check' WHEN 1 THEN 'cross' ELSE 'dot' END AS mark_kind,
  CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey % 27 AS INT) END AS sides, CASE WHEN o_custkey % 5 > 0 THEN CAST(0.3 AS DOUBLE) END AS inner_part,
  CASE WHEN o_orderkey % 14 = 5 THEN 2 ELSE CAST(1 + o_custkey % 6 AS INT) END AS n_pts, CAST(1 + o_custkey % 3 AS INT) AS n_rects FROM orders"""
SHAPES_SQL = f"""
SELECT * EXCLUDE (poly_kind, mark_kind), CASE t WHEN 'mark' THEN mark_kind ELSE poly_kind END AS kind,
  list_transform(range(0, n_pts), lambda i: {{'x': x + 11 * (i * i % 7), 'y': y + 9 * (i * 5 % 11), 'w': CASE WHEN (shape_id + i) % 3 > 0 THEN CAST(1 + (shape_id + i) % 5 AS DOUBLE) END}}) AS pts,
  list_transform(range(0, n_rects), lambda i: {{'x': x + 3 * i, 'y': y + 12.5::DOUBLE * i, 'w': 30.0::DOUBLE + i, 'h': 9.75::DOUBLE}}) AS rects FROM ({FLAT_SQL})"""


def shapes(t):
    def point(i):
        w = F.when((F.col("shape_id") + i) % 3 > 0, (1 + (F.col("shape_id") + i) % 5).cast("double"))
        return F.struct((F.col("x") + 11 * (i * i % 7)).alias("x"), (F.col("y") + 9 * (i * 5 % 11)).alias("y"), w.alias("w"))

    def rect(i):
        return F.struct((F.col("x") + 3 * i).alias("x"), (F.col("y") + 12.5 * i).alias("y"), (30.0 + i).alias("w"), F.lit(9.75).alias("h"))

    flat = t.sql(FLAT_SQL).withColumn("kind", F.when(F.col("t") == "mark", F.col("mark_kind")).otherwise(F.col("poly_kind"))).withColumnRenamed("inner_part", "inner")
    return flat.withColumn("pts", F.transform(F.sequence(F.lit(0), F.col("n_pts") - 1), point)).withColumn("rects", F.transform(F.sequence(F.lit(0), F.col("n_rects") - 1), rect))


ROTATES = "t IN ('text', 'image', 'rect', 'ellipse', 'whiteout', 'stamp', 'mark', 'poly')"
#: The box before the turn, then the frame: centre and angle.
FRAME_SQL = f"""SELECT *, bx + bw / 2 AS mx, by0 + bh / 2 AS my, CASE WHEN {ROTATES} THEN coalesce(rot, 0) * pi() / 180 ELSE 0 END AS turn FROM (SELECT *, bx1 - bx AS bw, by1 - by0 AS bh FROM (SELECT *,
 CASE WHEN t IN ('stroke', 'highlight') THEN list_min(list_transform(pts, lambda p: p.x - coalesce(p.w, width, 2) / 2 - 1)) WHEN t = 'line' THEN least(pts[1].x, pts[2].x) - coalesce(width, 2) / 2 - 3 WHEN t = 'hlrects' THEN list_min(list_transform(rects, lambda r: r.x)) ELSE x END AS bx,
 CASE WHEN t IN ('stroke', 'highlight') THEN list_min(list_transform(pts, lambda p: p.y - coalesce(p.w, width, 2) / 2 - 1)) WHEN t = 'line' THEN least(pts[1].y, pts[2].y) - coalesce(width, 2) / 2 - 3 WHEN t = 'hlrects' THEN list_min(list_transform(rects, lambda r: r.y)) ELSE y END AS by0,
 CASE WHEN t IN ('stroke', 'highlight') THEN list_max(list_transform(pts, lambda p: p.x + coalesce(p.w, width, 2) / 2 + 1)) WHEN t = 'line' THEN greatest(pts[1].x, pts[2].x) + coalesce(width, 2) / 2 + 3 WHEN t = 'hlrects' THEN list_max(list_transform(rects, lambda r: r.x + r.w)) WHEN t = 'note' THEN x + 22 ELSE x + w END AS bx1,
 CASE WHEN t IN ('stroke', 'highlight') THEN list_max(list_transform(pts, lambda p: p.y + coalesce(p.w, width, 2) / 2 + 1)) WHEN t = 'line' THEN greatest(pts[1].y, pts[2].y) + coalesce(width, 2) / 2 + 3 WHEN t = 'hlrects' THEN list_max(list_transform(rects, lambda r: r.y + r.h)) WHEN t = 'note' THEN y + 22 ELSE y + h END AS by1
FROM ({SHAPES_SQL})))"""
#: Bounds from the four turned corners.
BOUNDS_SQL = f"""SELECT *, list_min(cx) AS ox, list_min(cy) AS oy, list_max(cx) - list_min(cx) AS ow, list_max(cy) - list_min(cy) AS oh FROM (SELECT *,
 list_transform([[-1, -1], [1, -1], [-1, 1], [1, 1]], lambda s: mx + s[1] * bw / 2 * cos(turn) - s[2] * bh / 2 * sin(turn)) AS cx,
 list_transform([[-1, -1], [1, -1], [-1, 1], [1, 1]], lambda s: my + s[1] * bw / 2 * sin(turn) + s[2] * bh / 2 * cos(turn)) AS cy FROM ({FRAME_SQL}))"""


@query("shape_bounds", f"SELECT shape_id, round(ox, 4) AS ox, round(oy, 4) AS oy, round(ow, 4) AS ow, round(oh, 4) AS oh FROM ({BOUNDS_SQL})")
def shape_bounds(t):
    return sh.bounds(shapes(t)).select("shape_id", *[F.round(c, 4).alias(c) for c in ("ox", "oy", "ow", "oh")])


POINTS_SQL = "SELECT o_orderkey AS point_id, CAST(floor(o_orderkey / 64) AS BIGINT) AS page_key, CAST(o_orderkey * 53 % 557 AS DOUBLE) + 0.11 AS px, CAST((o_orderkey * 71 + o_custkey) % 809 AS DOUBLE) + 0.29 AS py FROM orders"
AWAY = "sqrt(pow(p.x + greatest(0, least(1, coalesce(((lx - p.x) * (q.x - p.x) + (ly - p.y) * (q.y - p.y)) / nullif(pow(q.x - p.x, 2) + pow(q.y - p.y, 2), 0), 0))) * (q.x - p.x) - lx, 2) + pow(p.y + greatest(0, least(1, coalesce(((lx - p.x) * (q.x - p.x) + (ly - p.y) * (q.y - p.y)) / nullif(pow(q.x - p.x, 2) + pow(q.y - p.y, 2), 0), 0))) * (q.y - p.y) - ly, 2))"


@query("shape_hit", f"""
WITH c AS (SELECT *, mx + (px - mx) * cos(turn) + (py - my) * sin(turn) AS lx, my - (px - mx) * sin(turn) + (py - my) * cos(turn) AS ly, coalesce(width, 2) / 2 + 5 AS band
  FROM ({POINTS_SQL}) JOIN ({FRAME_SQL}) USING (page_key) WHERE NOT hidden AND NOT locked AND t <> 'imgremove'),
s AS (SELECT *, unnest(pts[1:len(pts) - 1]) AS p, unnest(pts[2:]) AS q FROM c WHERE t IN ('stroke', 'highlight', 'line') AND len(pts) > 1),
r AS (SELECT *, unnest(rects) AS one FROM c WHERE t = 'hlrects')
SELECT DISTINCT point_id, shape_id FROM s WHERE {AWAY} < CASE t WHEN 'line' THEN greatest(5, coalesce(width, 2) / 2 + 3) ELSE coalesce(q.w, width, 2) / 2 + 5 END
UNION ALL SELECT point_id, shape_id FROM c WHERE t IN ('stroke', 'highlight') AND len(pts) = 1 AND sqrt(pow(lx - pts[1].x, 2) + pow(ly - pts[1].y, 2)) < greatest(5, coalesce(width, 2) / 2 + 2)
UNION ALL SELECT DISTINCT point_id, shape_id FROM r WHERE lx BETWEEN one.x AND one.x + one.w AND ly BETWEEN one.y AND one.y + one.h
UNION ALL SELECT point_id, shape_id FROM c WHERE t IN ('rect', 'ellipse', 'poly') AND NOT filled AND lx BETWEEN bx - band AND bx1 + band AND ly BETWEEN by0 - band AND by1 + band AND NOT (lx > bx + band AND lx < bx1 - band AND ly > by0 + band AND ly < by1 - band)
UNION ALL SELECT point_id, shape_id FROM c WHERE t NOT IN ('stroke', 'highlight', 'line', 'hlrects') AND NOT (t IN ('rect', 'ellipse', 'poly') AND NOT filled) AND lx BETWEEN bx - 2 AND bx1 + 2 AND ly BETWEEN by0 - 2 AND by1 + 2""")  # fmt: skip
def shape_hit(t):
    return sh.hits(t.sql(POINTS_SQL), shapes(t))


BOXES_SQL = "SELECT o_orderkey AS box_id, CAST(floor(o_orderkey / 64) AS BIGINT) AS page_key, CAST(o_orderkey * 17 % 300 AS DOUBLE) AS qx, CAST(o_orderkey * 23 % 500 AS DOUBLE) AS qy, CAST(10 + o_custkey * 7 % 291 AS DOUBLE) AS qw, CAST(10 + o_orderkey * 11 % 353 AS DOUBLE) AS qh FROM orders WHERE o_orderkey % 4 = 1"


@query("shape_contained", f"SELECT box_id, shape_id FROM ({BOUNDS_SQL}) s JOIN ({BOXES_SQL}) b ON s.page_key = b.page_key WHERE NOT hidden AND NOT locked AND t <> 'imgremove' AND ox >= qx AND oy >= qy AND ox + ow <= qx + qw AND oy + oh <= qy + qh")
def shape_contained(t):
    return sh.contained(shapes(t), t.sql(BOXES_SQL))


def box_sql(x="x", y="y", w="w", h="h"):
    return f"[{{'c': 'M', 'x': {x}, 'y': {y}}}, {{'c': 'L', 'x': {x} + {w}, 'y': {y}}}, {{'c': 'L', 'x': {x} + {w}, 'y': {y} + {h}}}, {{'c': 'L', 'x': {x}, 'y': {y} + {h}}}]"


def path_sql(*points):
    return "[" + ", ".join(f"{{'c': '{c}', 'x': x + w * {a}, 'y': y + h * {b}}}" for c, a, b in points) + "]"


CORNER = "greatest(3, least(24, coalesce(sides, CASE kind WHEN 'triangle' THEN 3 ELSE 5 END)))"
LINES = "list_transform(pts, lambda p, i: {'c': CASE i WHEN 1 THEN 'M' ELSE 'L' END, 'x': p.x, 'y': p.y})"


@query("shape_expand", f"""
WITH v AS (SELECT *, {CORNER} AS corners, coalesce(alpha, 1) AS solid, stroked AND coalesce(width, 0) > 0 AS lined, filled AND coalesce(fill_alpha, 1) < 1 AS splits FROM ({FRAME_SQL}) WHERE NOT hidden),
g AS (SELECT * REPLACE (CASE kind WHEN 'triangle' THEN [{{'c': 'M', 'x': x + w / 2, 'y': y}}, {{'c': 'L', 'x': x + w, 'y': y + h}}, {{'c': 'L', 'x': x, 'y': y + h}}]
  WHEN 'star' THEN list_transform(range(0, 2 * corners), lambda i: {{'c': CASE i WHEN 0 THEN 'M' ELSE 'L' END, 'x': x + w / 2 + cos(-pi() / 2 + i * pi() / corners) * w / 2 * CASE WHEN i % 2 = 1 THEN coalesce(inner_part, 0.45::DOUBLE) ELSE 1 END, 'y': y + h / 2 + sin(-pi() / 2 + i * pi() / corners) * h / 2 * CASE WHEN i % 2 = 1 THEN coalesce(inner_part, 0.45::DOUBLE) ELSE 1 END}})
  ELSE list_transform(range(0, corners), lambda i: {{'c': CASE i WHEN 0 THEN 'M' ELSE 'L' END, 'x': x + w / 2 + cos(-pi() / 2 + i * 2 * pi() / corners) * w / 2, 'y': y + h / 2 + sin(-pi() / 2 + i * 2 * pi() / corners) * h / 2}}) END || [{{'c': 'Z', 'x': NULL::DOUBLE, 'y': NULL::DOUBLE}}] AS poly, {box_sql()} AS box)
  FROM (SELECT *, NULL AS poly, NULL AS box FROM v)),
f AS (SELECT *, CASE t WHEN 'poly' THEN 'path' ELSE t END AS k, CASE t WHEN 'poly' THEN poly ELSE box END AS points, CASE WHEN t = 'poly' AND NOT stroked THEN 0 ELSE width END AS lw FROM g WHERE t IN ('rect', 'ellipse', 'poly')),
m AS (
 SELECT page_key, shape_id, mx, my, turn, 0 AS n, k AS kind, 'whole' AS part, lw, alpha, points FROM f WHERE NOT splits
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, k, 'fill', lw, solid * fill_alpha, points FROM f WHERE splits
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 1, k, 'outline', lw, solid, points FROM f WHERE splits AND lined
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, 'vstroke', 'whole', NULL, alpha, {LINES} FROM v WHERE t = 'stroke'
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, 'highlight', 'whole', width, coalesce(alpha, 0.4), {LINES} FROM v WHERE t = 'highlight'
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, 'line', 'whole', width, alpha, {LINES} FROM v WHERE t = 'line'
 UNION ALL SELECT page_key, shape_id, mx, my, turn, n, 'highlight', 'whole', rects[n + 1].h, coalesce(alpha, 0.4), [{{'c': 'M', 'x': rects[n + 1].x, 'y': rects[n + 1].y + rects[n + 1].h / 2}}, {{'c': 'L', 'x': rects[n + 1].x + rects[n + 1].w, 'y': rects[n + 1].y + rects[n + 1].h / 2}}] FROM (SELECT *, unnest(range(0, len(rects))) AS n FROM v WHERE t = 'hlrects')
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, 'rect', 'whole', 0, 1, box FROM g WHERE t = 'whiteout'
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, t, 'whole', NULL, CASE t WHEN 'link' THEN NULL ELSE alpha END, box FROM g WHERE t IN ('link', 'image')
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, 'note', 'whole', NULL, NULL, box[1:1] FROM g WHERE t = 'note'
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, 'ellipse', 'whole', NULL, alpha, {box_sql('x + w * 0.12', 'y + h * 0.12', 'w * 0.76', 'h * 0.76')} FROM g WHERE t = 'mark' AND kind = 'dot'
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, 'path', 'whole', greatest(1, least(w, h) * 0.12), alpha, CASE kind WHEN 'cross' THEN {path_sql(('M', 0.18, 0.18), ('L', 0.82, 0.82), ('M', 0.82, 0.18), ('L', 0.18, 0.82))} ELSE {path_sql(('M', 0.12, 0.55), ('L', 0.4, 0.82), ('L', 0.9, 0.2))} END FROM g WHERE t = 'mark' AND kind <> 'dot'
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 0, 'rect', 'whole', greatest(1, h * 0.06), alpha, box FROM g WHERE t = 'stamp'
 UNION ALL SELECT page_key, shape_id, mx, my, turn, 1, 'text', 'whole', NULL, alpha, {box_sql('x', 'y + h / 2 - h * 0.225', 'w', 'h * 0.45')} FROM g WHERE t = 'stamp'),
u AS (SELECT *, unnest(points) AS p, unnest(range(0, len(points))) AS v FROM m)
SELECT page_key, shape_id, CAST(n AS INT) AS n, kind, part, round(lw, 4) AS lw, round(alpha, 4) AS alpha, CAST(v AS INT) AS v, p.c AS cmd,
  round(mx + (p.x - mx) * cos(turn) - (p.y - my) * sin(turn), 4) AS vx, round(my + (p.x - mx) * sin(turn) + (p.y - my) * cos(turn), 4) AS vy, NULL::DOUBLE AS vwidth FROM u WHERE kind <> 'vstroke'
UNION ALL SELECT u.page_key, u.shape_id, CAST(n AS INT), u.kind, part, lw, u.alpha, CAST(v AS INT), p.c, round(p.x, 4), round(p.y, 4), coalesce(s.pts[v + 1].w, s.width) FROM u JOIN v s ON u.shape_id = s.shape_id WHERE u.kind = 'vstroke'""")  # fmt: skip
def shape_expand(t):
    made = sh.expand_shapes(shapes(t))
    return made.select("page_key", "shape_id", "n", "kind", "part", F.round("lw", 4).alias("lw"), F.round("alpha", 4).alias("alpha"), "v", "cmd", F.round("vx", 4).alias("vx"), F.round("vy", 4).alias("vy"), "vwidth")


#: Images on pages that follow the table, ten or so on each, and a region near each.
USES_SQL = "SELECT p_partkey AS asset_id, CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id, CAST(p_partkey % 2 + 1 AS INT) AS page_no, CAST(3 * (p_partkey * 7 % 31) AS INT) AS x, CAST(2 * (p_partkey * 11 % 37) AS INT) AS y, CAST(40 + p_size AS INT) AS w, CAST(60 + p_partkey % 23 AS INT) AS h FROM part"
NEAR_SQL = f"SELECT asset_id AS rid, doc_id, page_no, CAST(x + asset_id % 9 - 4 AS INT) AS rx, CAST(y + asset_id % 14 - 7 AS INT) AS ry, CAST(w + asset_id % 5 AS INT) AS rw, CAST(h - asset_id % 17 AS INT) AS rh FROM ({USES_SQL}) AS u"


@query("redact_drop_image", f"""
SELECT DISTINCT asset_id FROM (SELECT asset_id, w * h + rw * rh AS s, greatest(least(x + w, rx + rw) - greatest(x, rx), 0) * greatest(least(y + h, ry + rh) - greatest(y, ry), 0) AS i FROM ({USES_SQL}) m JOIN ({NEAR_SQL}) r ON m.doc_id = r.doc_id AND m.page_no = r.page_no) WHERE s > i AND i / (s - i) >= 0.8""")
def redact_drop_image(t):
    return sh.drop_matching(t.sql(USES_SQL), t.sql(NEAR_SQL))
