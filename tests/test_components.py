"""Connected parts, floods and reachability against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import components, masks


def rounds(monkeypatch):
    """Counts the tables that are written."""
    made = []
    real = components.written
    monkeypatch.setattr(components, "written", lambda df, name: made.append(name) or real(df, name))
    return made


def spiral(n):
    """Pixels of a path one wide that winds inwards, its walls as wide."""
    open_, x, y, dx, dy = {(0, 0)}, 0, 0, 1, 0
    while True:
        turned = 0
        while turned < 2:
            a, b = (x + dx, y + dy), (x + 2 * dx, y + 2 * dy)
            if 0 <= a[0] < n and 0 <= a[1] < n and a not in open_ and b not in open_:
                x, y = a
                open_.add(a)
                turned = 0
            else:
                dx, dy = -dy, dx
                turned += 1
                if turned == 2:
                    return open_, (x, y)


def walk(passable, seeds):
    seen, left = set(), [s for s in seeds if s in passable]
    while left:
        i, x, y = p = left.pop()
        if p not in seen:
            seen.add(p)
            left += [q for q in ((i, x + 1, y), (i, x - 1, y), (i, x, y + 1), (i, x, y - 1)) if q in passable]
    return seen


def test_random_masks(spark):
    rng = random.Random(1)
    passable = {(i, x, y) for i in range(6) for x in range(17) for y in range(13) if rng.random() < 0.3 + 0.1 * i}
    seeds = [(i, rng.randrange(17), rng.randrange(13)) for i in range(6) for _ in range(3)]
    px = spark.createDataFrame(sorted(passable), "image_id int, x int, y int")
    got = components.pixels_of(components.reached_runs(spark.createDataFrame(seeds, "image_id int, x int, y int"), px)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == walk(passable, seeds)


def test_rounds_follow_the_logarithm_of_a_spiral(spark, monkeypatch):
    path, end = spiral(120)
    made = rounds(monkeypatch)
    px = spark.createDataFrame([(1, x, y) for x, y in path], "image_id int, x int, y int")
    assert len(path) > 6000
    assert components.pixels_of(components.reached_runs(spark.createDataFrame([(1, *end)], "image_id int, x int, y int"), px)).count() == len(path)
    assert len(made) < 22


def test_parts_of_a_star_and_paths(spark):
    rng = random.Random(2)
    pairs = [(0, 1000, i) for i in range(200)] + [(1, i, i + 1) for i in range(300)] + [(2, rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    edges = spark.createDataFrame([e for g, a, b in pairs for e in ((g, a, b), (g, b, a))], "g int, a long, b long").distinct()
    nodes = spark.createDataFrame(sorted({(g, n) for g, a, b in pairs for n in (a, b)}), "g int, id long")
    got = {(r["g"], r["id"]): r["label"] for r in components.labels(nodes, edges, "g").collect()}
    up = {k: k for k in got}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for g, a, b in pairs:
        low, high = sorted([root((g, a)), root((g, b))])
        up[high] = low
    assert got == {k: root(k)[1] for k in got}


def plain_depths(roots, edges):
    out, near, depth = {}, set(roots), 0
    while near:
        out |= {n: depth for n in near}
        near = {b for a, b in edges if a in near} - set(out)
        depth += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_depths_of_random_graphs_with_chains_and_circles(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)]
    for k in range(6):
        chain = [f"n{rng.randrange(40)}", *(f"c{k}_{i}" for i in range(rng.randrange(12))), f"n{rng.randrange(40)}"]
        edges += list(zip(chain, chain[1:]))
    edges += [("o1", "o2"), ("o2", "o3"), ("o3", "o1"), ("n0", "n0"), ("n1", "n2"), ("n1", "n2")]
    roots = ["n0", "c1_2", "missing"]
    got = components.reachable(spark.createDataFrame([(r,) for r in roots], "node string"), spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r["node"]: r["depth"] for r in got} == plain_depths(roots, edges) and len(got) == len({r["node"] for r in got})


def test_a_chain_of_ten_thousand_nodes_takes_few_rounds(spark, monkeypatch):
    made = rounds(monkeypatch)
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = components.reachable(spark.createDataFrame([(0,)], "node long"), chain)
    assert found.agg(F.count("*"), F.max("depth")).first()[:] == (10_001, 10_000)
    assert len(made) < 25


def test_nothing_to_reach(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert [r[:] for r in components.reachable(spark.createDataFrame([("a",)], "node string"), none).collect()] == [("a", 0)]
    px = spark.createDataFrame([], "image_id int, x int, y int, r int, g int, b int, a int")
    assert masks.flood(px, spark.createDataFrame([(1, 0, 0)], "image_id int, sx int, sy int")).count() == 0
