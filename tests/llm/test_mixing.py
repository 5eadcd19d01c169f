"""Mixing: targets, near takes, repeats, reruns, cases."""

import itertools
from collections import Counter, defaultdict

from folio.llm import mixing
from folio.llm.mixing import WEIGHTS, mix, op5_mixing, schedule, with_slots, with_targets


def resharing(sizes, weights=(5, 2, 1), repeats=3):
    """Shares by weight, again and again, until no source is above its limit."""
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, held = {}, set()
    while True:
        left = sum(sizes.values()) - sum(target[s] for s in held)
        free = [s for s in order if s not in held]
        total = sum(weight[s] for s in free)
        target |= {s: left * weight[s] / total for s in free}
        over = [s for s in free if target[s] > repeats * sizes[s] + 1e-9]
        if not over:
            return target
        for s in over:
            target[s] = repeats * sizes[s]
            held.add(s)


TABLES = ({"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5}, {"a": 0, None: 10}, {"z": 7}, {"a": 2, "b": 3, "c": 900, "d": 10, None: 50}, {"a": 0, "b": 0}, {"a": 10**9, "b": 1, "c": 40, "d": 10**6})


def table(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "source string, source_size long")


def test_targets(spark):
    for sizes in TABLES:
        want, got = resharing(sizes, WEIGHTS), {r["source"]: r["target"] for r in with_targets(table(spark, sizes)).collect()}
        assert all(abs(want[s] - got[s]) <= 1e-9 * (want[s] + 1) for s in sizes)


def test_schedule_is_whole_and_even(spark):
    for sizes in TABLES[:6]:
        sources = with_slots(with_targets(table(spark, sizes)), 16)
        by = {r["source_no"]: r for r in sources.collect()}
        slots = sorted(schedule(sources).collect(), key=lambda r: r["slot"])
        assert [r["slot"] for r in slots] == list(range(sum(r["slots"] for r in by.values())))
        ranks, words = Counter(), defaultdict(int)
        for i, r in enumerate(slots):
            own = by[r["source_no"]]
            assert r["rank"] == ranks[r["source_no"]] and r["block"] == r["rank"] % own["blocks"]
            words[own["source"]] += r["part"] if r["part"] is not None else own["words"] + (r["block"] < own["long"])
            ranks[r["source_no"]] += 1
            for k, o in by.items():  # each source has its part of every stretch from the start
                assert abs(ranks[k] - (i + 1) * o["slots"] / len(slots)) <= 4
        assert all(words[s] == round(t) for s, t in resharing(sizes, WEIGHTS).items())


def test_takes_equal_a_plain_schedule(spark):
    sizes = [("a", [3, 50, 7, 120, 1]), ("b", [1]), ("c", [40, 40, 0, 9]), (None, [17, 300])]
    rows = [(10 * k + i, "w " * n, s) for k, (s, ns) in enumerate(sizes) for i, n in enumerate(ns)]
    rows += [(77, "w w w", "a")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, block=16).collect()
    order = df.selectExpr("doc_id", "source", "size(filter(split(text, ' '), x -> x <> '')) AS size").selectExpr("*", "xxhash64(7, doc_id, cast(size AS bigint)) AS at").collect()
    targets = resharing({s: sum(r["size"] for r in order if r["source"] == s) for s, _ in sizes}, WEIGHTS)
    for s, _ in sizes:
        owners = [r["doc_id"] for r in sorted((r for r in order if r["source"] == s), key=lambda r: r["at"]) for _ in range(r["size"])]
        want = Counter(itertools.islice(itertools.cycle(owners), round(targets[s])))
        mine = Counter()
        for r in got:
            if r["source"] == s:
                mine[r["doc_id"]] += r["taken"]
        assert +mine == want
    assert len(got) == len(rows)
    # the slots in order, each laid over the words of its block
    sources = with_slots(with_targets(table(spark, {s: sum(r["size"] for r in order if r["source"] == s) for s, _ in sizes})), 16)
    by = {r["source_no"]: r for r in sources.collect()}
    first: dict = {}
    for slot in sorted(schedule(sources).collect(), key=lambda r: r["slot"]):
        own = by[slot["source_no"]]
        begin = slot["block"] * own["words"] + min(slot["block"], own["long"])
        many = slot["part"] if slot["part"] is not None else own["words"] + (slot["block"] < own["long"])
        owners = [r["doc_id"] for r in sorted((r for r in order if r["source"] == own["source"]), key=lambda r: r["at"]) for _ in range(r["size"])]
        for doc in owners[begin : begin + many]:
            first.setdefault((own["source"], doc), slot["slot"])
    mine = {}
    for r in got:
        if r["slot"] is not None:
            k = (r["source"], r["doc_id"])
            mine[k] = min(r["slot"], mine.get(k, r["slot"]))
    assert mine == first


def test_another_step_gives_other_places(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 40), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    places = lambda: {r["doc_id"]: (r["taken"], r["slot"]) for r in mix(df, block=16).collect()}
    golden = places()
    monkeypatch.setattr(mixing, "GOLDEN", 0.001)
    other = places()
    assert {k: v[0] for k, v in golden.items()} == {k: v[0] for k, v in other.items()}
    assert sum(golden[k][1] != other[k][1] for k in golden) > 150


def test_query(spark, data):
    first, again = op5_mixing(spark, data).collect(), op5_mixing(spark, data).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    by = {}
    for r in first:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert len(first) == spark.read.parquet(f"{data}/documents.parquet").count()
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(12, 0.02 * rows[0]["target"])


def test_cases(spark):
    schema = "doc_id long, text string, source string, size string"
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "s", "x"), (2, None, "s", "x"), (None, "one two", None, "x"), (3, "", "empty", "x"), (4, "word " * 500, "t", "x")]
    got = mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source"]: r["source_size"] for r in got} == {"s": 6, None: 2, "empty": 0, "t": 500}
    assert [r["target"] for r in got if r["source"] == "empty"] == [0.0]
    assert mix(spark.createDataFrame([], schema)).count() == 0
    assert [r["taken"] for r in mix(spark.createDataFrame([(1, "", "s", "x")], schema)).collect()] == [0]


def test_small_sources_beside_a_huge_one(spark):
    sizes = {f"s{i}": n for i, n in enumerate((1, 7, 50, 500, 3000, 12000, 20000))}
    rows = [(i, "w " * (n // 5 + (k < n % 5)), s) for i, (s, n) in enumerate(sizes.items()) for k in range(5)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, source string")
    huge = spark.range(400, numPartitions=4).selectExpr("id + 100 AS doc_id", "repeat('w ', 2000000) AS text", "'huge' AS source")
    got = mix(rows.union(huge)).groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum"}).collect()
    assert len(got) == 8
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 1 and r["sum(taken)"] <= 3 * r["sum(size)"]
    assert {r["source"]: r["sum(taken)"] for r in got if r["source"] != "huge"} == {s: 3 * n for s, n in sizes.items()}
