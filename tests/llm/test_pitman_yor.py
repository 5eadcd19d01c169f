"""The language model against plain counts, enumerated seatings and a seat-by-seat sampler."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm.pitman_yor import fold, log_stirling, op13_pitman_yor, pack, pieces_of, score, seats, unpack


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b"</s>"]


def plain(rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows for w in [tokens_of(t)]]


def rows_of(df):
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect()]


def agree(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2:4], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-9)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(op13_pitman_yor(spark, data))
    agree(got, plain(rows, held))
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > 0.9 * sum(r[5] for r in out)
    assert all(r[6] < 0 for r in got)


def test_odd_rows_blocks_and_pieces(spark):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [None, "", " \t\x0b", "É ß \x85", "A a", " ".join(words), "x" * 5000, *(" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(150))]
    rows = [(rng.choice([None, *range(40)]), t) for t in texts] + [(4, "A a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS trains", "'a' AS kind").repartition(3)
    want = plain(rows, held)
    whole = rows_of(score(df, fold() == 2))
    agree(whole, want)
    cut = rows_of(score(df, fold() == 2, bucket_bytes=500, block_tokens=100, piece_bytes=64))
    agree(cut, want)
    assert abs(sum(r[6] for r in whole) / sum(r[6] for r in cut) - 1) < 0.02


def test_empty_tables_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score(none, F.lit(False)).count() == 0
    got = rows_of(score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(True)))
    assert {(r[0], r[2], r[3], r[4], r[5], r[6]) for r in got} == {(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)}


def test_packed_arrays_come_back():
    arrays = [np.arange(300), np.array([2**63], np.uint64), np.array([True, False]), np.array([1.5, -2.0]), np.zeros(0, np.int64), np.array([-1, 5])]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, unpack(pack(*arrays))))


def test_pieces_are_cut_between_words():
    text = "Ab é " * 40 + "x" * 100 + " y"
    for most in (1, 5, 50, 10**6):
        assert [w for p in pieces_of(text, most) for w in p] == text.encode().lower().split()


def test_stirling_numbers_add_up():
    for d in (0.1, 0.5, 0.9):
        table = log_stirling(d, 40)
        for n in (1, 2, 7, 40):
            new = np.cumsum(np.log(1.5 + d * np.arange(n)))
            assert math.isclose(np.logaddexp.reduce(table[n, 1 : n + 1] + new), sum(math.log(1.5 + i) for i in range(n)))


def partitions(n):
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for i in range(len(p)):
            yield [*p[:i], p[i] + 1, *p[i + 1 :]]
        yield [*p, 1]


@pytest.mark.parametrize("n, others, share, d", [(2, 0, 0.3, 0.7), (5, 12, 0.05, 0.4), (6, 3, 0.9, 0.8)])
def test_tables_are_drawn_as_often_as_all_seatings_say(n, others, share, d):
    weight: Counter = Counter()
    for p in partitions(n):
        w = math.prod(share * (1.0 + d * (others + j)) for j in range(len(p)))
        weight[len(p)] += w * math.prod(math.prod(i - d for i in range(1, c)) for c in p)
    drawn = Counter(seats(np.random.default_rng(1), np.full(40_000, n), np.full(40_000, float(others)), np.full(40_000, share), d, log_stirling(d)).tolist())
    total = sum(weight.values())
    assert all(abs(drawn[t] / 40_000 - w / total) < 0.012 for t, w in weight.items())


def test_rooms_draw_every_customer_a_table():
    rng = np.random.default_rng(1)
    count = np.array([1, 2, 255, 256, 257, 512, 10**9])
    tables = seats(rng, count, np.full(7, 100.0), np.full(7, 0.01), 0.7, log_stirling(0.7))
    assert (tables >= -(-count // 256)).all() and (tables <= count).all()


def seat_by_seat(train, test, d, root_d, sweeps, rng):
    """A plain sampler that moves one customer at a time, averaged over its last sweeps."""
    known = {w for t in train for w in t}
    rooms: dict = defaultdict(lambda: defaultdict(list))
    customers, tables = Counter(), Counter()

    def share(u, w):
        c, t = sum(rooms[u][w]), len(rooms[u][w])
        parent = 1 / (len(known) + 1) if u is None else share(None, w)
        return (c - (root_d if u is None else d) * t + (1 + (root_d if u is None else d) * tables[u]) * parent) / (1 + customers[u])

    def sit(u, w):
        dd = root_d if u is None else d
        parent = 1 / (len(known) + 1) if u is None else share(None, w)
        weights = [n - dd for n in rooms[u][w]] + [(1 + dd * tables[u]) * parent]
        k = rng.choices(range(len(weights)), weights)[0]
        customers[u] += 1
        if k < len(rooms[u][w]):
            rooms[u][w][k] += 1
        else:
            rooms[u][w].append(1)
            tables[u] += 1
            if u is not None:
                sit(None, w)

    def leave(u, w):
        k = rng.choices(range(len(rooms[u][w])), rooms[u][w])[0]
        rooms[u][w][k] -= 1
        customers[u] -= 1
        if not rooms[u][w][k]:
            del rooms[u][w][k]
            tables[u] -= 1
            if u is not None:
                leave(None, w)

    pairs = [p for t in train for p in zip([b"<s>", *t], t)]
    for p in pairs:
        sit(*p)
    total = [[0.0] * len(t) for t in test]
    for sweep in range(sweeps):
        for p in pairs:
            leave(*p)
            sit(*p)
        if sweep >= sweeps // 2:
            for t, sums in zip(test, total):
                for i, p in enumerate(zip([b"<s>", *t], t)):
                    sums[i] += share(*p) / (sweeps - sweeps // 2)
    return sum(math.log10(x) for sums in total for x in sums)


def test_scores_are_near_those_of_a_sampler_of_single_seats(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    follow = {w: rng.choices(words, k=6) for w in words}

    def text():
        found = [rng.choice(words[:10])]
        while len(found) < 25:
            found.append(rng.choice(follow[found[-1]]) if rng.random() < 0.8 else rng.choice(words))
        return " ".join(found)

    rows = [(i, text() + (f" rare{i}" if i % 5 == 0 else "")) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sum(r[6] for r in rows_of(score(df, F.col("doc_id") >= 50, burn_in=3, samples=5)) if r[1])
    train, test = [tokens_of(t) for _, t in rows[:50]], [tokens_of(t) for _, t in rows[50:]]
    pairs = Counter(p for t in train for p in zip([b"<s>", *t], t))
    uni = Counter(w for t in train for w in t)
    of = lambda c: (n1 := sum(v == 1 for v in c.values())) / (n1 + 2 * sum(v == 2 for v in c.values())) if any(v == 1 for v in c.values()) else 0.5
    want = seat_by_seat(train, test, min(0.95, max(0.05, of(pairs))), min(0.95, max(0.05, of(uni))), 30, rng)
    assert abs(got / want - 1) < 0.02, (got, want)


def test_partitions_are_enumerated_once():
    assert [len(list(partitions(n))) for n in (2, 5, 6)] == [2, 52, 203]
