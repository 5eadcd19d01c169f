"""The filter audit against a plain walk through every order, row by row."""

import itertools
import random
import re
from collections import Counter, defaultdict

from folio.llm.interaction import FILTERS, judged, mask_counts, report

NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """What each step of each order does, by running the filters one after another."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        fails.append((lang or "", i, {f for f, x in zip(FILTERS, own) if x}))
    out, shapley = defaultdict(Counter), Counter()
    for part in {p for p, _, _ in fails}:
        for order in map("".join, itertools.permutations(FILTERS)):
            left = [x for x in fails if x[0] == part]
            gone: list = []
            for step, f in enumerate(order, 1):
                removed, stay = [x for x in left if f in x[2]], [x for x in left if f not in x[2]]
                c = out[part, order, step]
                c.update(kept=len(stay), removed=len(removed), redundant=sum(f in x[2] for x in gone), unique_fails=sum(x[2] == {f} for x in fails if x[0] == part))
                c.update(good_lost=sum(x[1] in good for x in removed), toxic_lost=sum(x[1] in toxic for x in removed))
                shapley[part, f] += len(removed)
                left, gone = stay, gone + removed
    return {k: tuple([*(c[n] for n in NAMES[:-1]), shapley[k[0], k[1][k[2] - 1]]]) for k, c in out.items()}


def found(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_odd_rows(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    texts = [None, "", "a b", "A # b", "SHOUT " * 150, " ".join(f"w{i}" for i in range(150)), " ".join(f"w{i % 50}" for i in range(150)), "\x0b é\x85x " * 60, long]
    rows = [(rng.choice([None, 1, 2, 3, *range(4, 60)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(300)]
    rows += [(7, "same", "de"), (7, "same", "de"), (8, "same", "de"), (None, "same", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(40)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    want = plain(rows, labels)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for bits in (16, 28):
        docs = table(spark, rows).selectExpr("*", "1 AS part", "2 AS mask", "3 AS h", "4 AS n").repartition(5)
        assert found(report(mask_counts(docs, told, most_bits=bits))) == want


def test_a_small_sketch_only_costs_work(spark):
    rng = random.Random(6)
    rows = [(i, f"text {rng.randrange(3000)}", "en") for i in range(4000)]
    texts = Counter(t for _, t, _ in rows)
    for bits in (8, 20):
        kept = Counter(r["text"] for r in judged(table(spark, rows), most_bits=bits).where("text IS NOT NULL").collect())
        assert all(kept[t] == n for t, n in texts.items() if n > 1)
        if bits == 20:
            assert sum(kept[t] for t, n in texts.items() if n == 1) < 40


def test_large_group_of_copies_in_many_partitions(spark):
    rows = [(i, "copy " * 120 if i % 3 else f"own {i}", "en") for i in range(3000)]
    want = plain(rows, [])
    assert found(report(mask_counts(table(spark, rows).repartition(9), table(spark, []).selectExpr("doc_id", "1 AS quality", "1 AS toxic")))) == want


def test_empty_table(spark):
    none = table(spark, [])
    assert report(mask_counts(none, none.selectExpr("doc_id", "1 AS quality", "1 AS toxic"))).count() == 0
