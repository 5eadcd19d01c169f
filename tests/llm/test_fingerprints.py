"""Fingerprints against a plain version, neighbours, merging, cases."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from folio.llm import fingerprints as fp


def hashes(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w, seed=h)
        if h >> 62 == 0:
            out.add(h)
    return out


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    got = {r["doc_id"]: r for r in fp.op9_fingerprints(spark, data).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, following = r["text"], rows[(i + 1) % len(rows)]["text"]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = got[r["doc_id"]]
        assert (own["n_chars"], own["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for column, t in (("fingerprint", text), ("edited_fingerprint", edited)):
            assert own[column] == ",".join(f"{h:016x}" for h in sorted(hashes(t)))
        a, b = hashes(text), hashes(edited)
        c = hashes(following)
        if text != following:
            assert abs(own["near_next"] - (len(a & c) / len(a | c) if a | c else 0)) < 1e-12
        if text != edited:
            assert abs(own["near_edited"] - (len(a & b) / len(a | b) if a | b else 0)) < 1e-12


def test_merging_and_containment(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words[:1500]), " ".join(words[1496:]), " ".join(words), " ".join(words[400:700]))], "a string, b string, c string, d string")
    for c in "abcd":
        df = fp.fingerprint(df, text=c, out=f"s{c}")
    r = df.select((fp.merged(F.col("sa"), F.col("sb")) == F.col("sc")).alias("same"), fp.containment(F.col("sd"), F.col("sc")).alias("inside"), fp.likeness(F.col("sd"), F.col("sc")).alias("like")).first()
    assert r["same"] and r["inside"] == 1.0 and 0.03 < r["like"] < 0.25


def test_neighbours_and_cases(spark):
    rows = [(5, "five"), (5, "five b"), (9, None), (None, "nil"), (-3, ""), (100, "a hundred words")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, next_text string").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["text"]), str(r["next_text"])) for r in fp.with_next(df.drop("next_text"), key="doc_id", columns=["text"]).collect())
    ties = sorted(("five", "five b"), key=lambda t: tie(t))
    order = [(100, "a hundred words"), (9, None), *((5, t) for t in ties), (-3, ""), (None, "nil")]
    assert got == sorted((str(i), str(t), str(order[(k + 1) % 6][1])) for k, (i, t) in enumerate(order))
    one = fp.with_next(df.limit(1).drop("next_text"), key="doc_id", columns=["text"]).collect()
    assert len(one) == 1 and one[0]["next_text"] == one[0]["text"]
    assert fp.with_next(df.limit(0).drop("next_text"), key="doc_id", columns=["text"]).count() == 0


def tie(text):
    return (xxhash.xxh64_intdigest(text.encode(), seed=42) ^ 1 << 63) - (1 << 63)


def test_rows_of_one_id_are_cut_into_ranges(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(60)] + [(i, f"own {i}") for i in (-5, 3, 6, 8, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    number, _ = fp.id_ranges(df.withColumn("h", F.xxhash64("text")), "doc_id", "h")
    assert df.withColumn("h", F.xxhash64("text")).where("doc_id = 7").select(number.alias("r")).distinct().count() > 100
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    want = {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in fp.with_next(df, key="doc_id", columns=["text"]).collect()}
    assert got == want


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(400_000))
    r = fp.fingerprint(spark.createDataFrame([(text,)], "text string")).select(F.size("sketch").alias("n")).first()
    assert abs(r["n"] - 100_000) < 2_000


def test_native(spark, data):
    plan = fp.op9_fingerprints(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
