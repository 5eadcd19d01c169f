"""Names of merged fields against the plain walk."""

import random

import pytest

from folio.operators import names


def walk(rows):
    out, used = {}, {}
    for out_id, _, node, t in sorted(rows):
        taken, name, k = used.setdefault(out_id, set()), t, 2
        while name in taken:
            name, k = f"{t}_{k}", k + 1
        taken.add(name)
        out[out_id, node] = name
    return out


def found(spark, rows):
    got = names.dedupe_names(spark.createDataFrame(rows, "out_id int, arrival long, node_id long, t string")).collect()
    assert len(got) == len(rows)
    return {(r["out_id"], r["node_id"]): r["name"] for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_names_are_those_of_the_walk(spark, seed):
    rng = random.Random(seed)
    ends = ["", "", "", "_2", "_3", "_4", "_5", "_7", "_2_2", "_2_3", "_3_2", "_2_2_2", "_02", "_1", "_", "__2", "_2_"]
    rows = [(out, a, 10_000 * out + a, rng.choice(["a", "b", "", "x_y"]) + rng.choice(ends)) for out in range(12) for a in range(1, rng.randrange(2, 90))]
    assert found(spark, rows) == walk(rows)


def test_numbers_owned_before_and_after_they_are_wanted(spark):
    for ts in (["n", "n_2", "n", "n"], ["n", "n", "n_2", "n", "n_2"], ["n_3", "n", "n", "n", "n_5", "n", "n"], ["n_2", "n_3", "n", "n", "n_4", "n", "n_2"], ["é_9", "é"] + ["é"] * 12):
        rows = [(1, i, i, t) for i, t in enumerate(ts)]
        assert found(spark, rows) == walk(rows)


def test_many_clashes_of_one_stem_are_spread(spark, monkeypatch):
    monkeypatch.setattr(names, "SPAN", 500)
    rng = random.Random(9)
    rows = [(1, i, i, "n" if rng.random() < 0.7 else f"n_{rng.randrange(2, 6000)}") for i in range(6000)]
    assert found(spark, rows) == walk(rows)


def test_arrivals_follow_documents_and_nodes(spark):
    rows = [(o, d, n) for o in range(3) for d in range(4) for n in range(5)]
    random.Random(1).shuffle(rows)
    got = {(r["out_id"], r["doc_id"], r["node_id"]): r["arrival"] for r in names.arrivals(spark.createDataFrame(rows, "out_id int, doc_id int, node_id int")).collect()}
    assert got == {(o, d, n): d * 5 + n + 1 for o, d, n in rows}
