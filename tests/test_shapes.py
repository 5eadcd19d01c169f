"""Drawn objects: distances, turned frames, vertices, and joins of points with areas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import shapes as sh

SCHEMA = (
    "page_key long, shape_id long, t string, x double, y double, w double, h double, rot int, hidden boolean, locked boolean, filled boolean, stroked boolean, fill_alpha double, width double, alpha double, "
    "kind string, sides int, inner double, pts array<struct<x:double,y:double,w:double>>, rects array<struct<x:double,y:double,w:double,h:double>>"
)
NAMES = [p.split()[0] for p in SCHEMA.split(", ")]


def table(spark, *shapes):
    return spark.createDataFrame([tuple({"page_key": 1, "shape_id": i, **s}.get(n) for n in NAMES) for i, s in enumerate(shapes)], SCHEMA)


def at(spark, *points):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "page_key long, point_id long, px double, py double")


def hit(spark, shape, *points, tolerance=5.0):
    return {r["point_id"] for r in sh.hits(at(spark, *points), table(spark, shape), tolerance).collect()}


RECT = {"t": "rect", "x": 0.0, "y": 0.0, "w": 100.0, "h": 100.0, "width": 2.0, "stroked": True}
LINE = {"t": "line", "pts": [(0.0, 0.0, None), (100.0, 100.0, None)], "width": 2.0}


def test_hits_respect_outlines_fills_and_distance(spark):
    assert hit(spark, RECT, (0, 50), (50, 50), (-5, 50), (107, 50)) == {0, 2}
    assert hit(spark, RECT | {"filled": True}, (50, 50), (102, 50), (103, 50)) == {0, 1}
    assert hit(spark, LINE, (50, 52), (90, 10), (103, 103), (110, 110)) == {0, 2}
    assert hit(spark, RECT | {"hidden": True}, (0, 50)) == hit(spark, RECT | {"locked": True}, (0, 50)) == set()


def test_strokes_are_hit_by_the_width_of_their_points(spark):
    stroke = {"t": "stroke", "pts": [(0.0, 0.0, None), (50.0, 0.0, 20.0), (50.0, 50.0, None)], "width": 2.0}
    assert hit(spark, stroke, (25, 14), (56.5, 30), (55, 30), (25, 25)) == {0, 2}
    dot = {"t": "highlight", "pts": [(10.0, 10.0, None)], "width": 12.0}
    assert hit(spark, dot, (17, 10), (18.5, 10)) == {0}


def test_hits_follow_the_turn_of_a_shape(spark):
    box = {"t": "image", "x": 0.0, "y": 40.0, "w": 200.0, "h": 20.0, "rot": 90}
    assert hit(spark, box, (100, -40), (100, 140), (10, 50), (190, 50)) == {0, 1}
    assert hit(spark, box | {"t": "link"}, (100, -40), (10, 50)) == {1}


@pytest.mark.parametrize("angle", [0, 30, 90, 135, 211])
def test_bounds_at_any_angle(spark, angle):
    r = sh.bounds(table(spark, RECT | {"w": 80.0, "h": 30.0, "rot": angle})).first()
    s, c = abs(math.sin(math.radians(angle))), abs(math.cos(math.radians(angle)))
    assert (r["ow"], r["oh"]) == pytest.approx((80 * c + 30 * s, 80 * s + 30 * c))
    assert (r["ox"] + r["ow"] / 2, r["oy"] + r["oh"] / 2) == pytest.approx((40, 15))


def made(spark, shape):
    rows = sh.expand_shapes(table(spark, shape)).orderBy("n", "v").collect()
    return [(r["n"], r["kind"], r["part"], r["cmd"], None if r["vx"] is None else (round(r["vx"], 6), round(r["vy"], 6))) for r in rows]


def test_vertices_of_shapes(spark):
    triangle = made(spark, RECT | {"t": "poly", "kind": "triangle"})
    assert [r[3:] for r in triangle] == [("M", (50, 0)), ("L", (100, 100)), ("L", (0, 100)), ("Z", None)]
    star = made(spark, RECT | {"t": "poly", "kind": "star", "sides": 4, "inner": 0.5})
    assert len(star) == 9 and star[0][4] == (50, 0) and star[2][4] == (100, 50) and star[1][4] == pytest.approx((50 + 25 * math.sqrt(0.5), 50 - 25 * math.sqrt(0.5)), abs=1e-5)
    assert len(made(spark, RECT | {"t": "poly", "kind": "polygon", "sides": 99})) == 25
    turned = made(spark, RECT | {"rot": 90})
    assert [r[4] for r in turned] == [(100, 0), (100, 100), (0, 100), (0, 0)]
    assert [r[3] for r in made(spark, RECT | {"t": "mark", "kind": "cross"})] == ["M", "L", "M", "L"]
    assert made(spark, RECT | {"hidden": True}) == made(spark, {"t": "imgremove"}) == []


def test_translucent_fills_are_drawn_apart(spark):
    both = made(spark, RECT | {"filled": True, "fill_alpha": 0.5})
    assert {r[:3] for r in both} == {(0, "rect", "fill"), (1, "rect", "outline")}
    assert {r[:3] for r in made(spark, RECT | {"filled": True, "fill_alpha": 0.5, "stroked": False})} == {(0, "rect", "fill")}
    assert {r[:3] for r in made(spark, RECT | {"filled": True})} == {(0, "rect", "whole")}


def test_points_meet_areas_of_every_size_once(spark):
    rng = random.Random(1)
    areas = [(rng.randrange(3), i, x, y, x + 2 ** rng.uniform(-3, 11), y + 2 ** rng.uniform(-3, 11)) for i in range(300) for x, y in [(rng.uniform(-500, 500), rng.uniform(-500, 500))]]
    areas += [(0, 900, 0.0, 0.0, 32.0, 64.0), (0, 901, -32.0, 0.0, 0.0, 0.0), (0, 902, 5.0, 5.0, 5.0, 5.0)]
    points = [(rng.randrange(3), i, rng.uniform(-600, 1500), rng.uniform(-600, 1500)) for i in range(400)] + [(0, 900, 32.0, 64.0), (0, 901, 0.0, 0.0), (0, 902, 5.0, 5.0)]
    a = spark.createDataFrame(areas, "page_key long, area_id long, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "page_key long, point_id long, px double, py double")
    got = [(r["point_id"], r["area_id"]) for r in sh.in_areas(p, a, ["page_key"]).collect()]
    want = {(j, i) for k, i, x0, y0, x1, y1 in areas for m, j, x, y in points if k == m and x0 <= x <= x1 and y0 <= y <= y1}
    assert len(got) == len(set(got)) and set(got) == want


def test_images_near_regions_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    uses = [(1, rng.randrange(2), i, rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([0.0, 20.0, 25.0, rng.uniform(15, 40)]), rng.choice([20.0, 16.0, rng.uniform(15, 40)])) for i in range(300)]
    near = [(1, rng.randrange(2), rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([20.0, 16.0, rng.uniform(15, 40)]), rng.choice([20.0, 25.0, rng.uniform(15, 40)])) for _ in range(200)] + [(u[0], u[1], *u[3:]) for u in uses[:40]]

    def share(u, r):
        i = max(0, min(u[3] + u[5], r[2] + r[4]) - max(u[3], r[2])) * max(0, min(u[4] + u[6], r[3] + r[5]) - max(u[4], r[3]))
        whole = u[5] * u[6] + r[4] * r[5] - i
        return i / whole if whole > 0 else 0

    want = {u[2] for u in uses if any(u[1] == r[1] and share(u, r) >= 0.8 for r in near)}
    a = spark.createDataFrame(uses, "doc_id long, page_no int, asset_id long, x double, y double, w double, h double")
    b = spark.createDataFrame(near, "doc_id long, page_no int, rx double, ry double, rw double, rh double")
    assert {r["asset_id"] for r in sh.drop_matching(a, b).collect()} == want


def test_candidates_stay_near_the_hits(spark):
    """Ten times the shapes on ten times the pages makes ten times the candidates, on one page too few to matter."""
    n = 4000
    shapes = spark.range(n).select(F.lit(1).cast("long").alias("page_key"), F.col("id").alias("area_id"), (F.col("id") % 97 * 20.0).alias("x0"), (F.col("id") % 89 * 20.0).alias("y0")).withColumns({"x1": F.col("x0") + 15, "y1": F.col("y0") + 15})
    points = spark.range(n).select(F.lit(1).cast("long").alias("page_key"), F.col("id").alias("point_id"), (F.col("id") % 97 * 20.0 + 7).alias("px"), (F.col("id") % 89 * 20.0 + 7).alias("py"))
    assert sh.in_areas(points, shapes, ["page_key"]).count() == n


def test_a_wide_segment_is_hit_beyond_its_narrow_points(spark):
    stroke = {"t": "stroke", "width": 2.0, "pts": [(0.0, 0.0, 1.0), (100.0, 0.0, 9.0), (100.0, 100.0, 1.0)]}
    # the first segment is as wide as its second point: 9 / 2 + 5
    assert hit(spark, stroke, (-9, 0), (-10, 0), (50, 9), (100, 105)) == {0, 2, 3}
    assert hit(spark, {"t": "highlight", "width": 30.0, "pts": [(0.0, 0.0, 1.0)]}, (16, 0), (18, 0)) == {0}


def test_cells_of_areas_are_never_broadcast(spark):
    # rows whose number is known: Spark takes the tables for small ones
    uses = spark.range(1).selectExpr("id AS asset_id", "id AS doc_id", "1 AS page_no", "0 AS x", "0 AS y", "50 AS w", "50 AS h")
    regions = spark.range(1).selectExpr("id AS doc_id", "1 AS page_no", "1 AS rx", "1 AS ry", "50 AS rw", "50 AS rh")
    found = sh.drop_matching(uses, regions)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["asset_id"] for r in found.collect()] == [0]
