"""Repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

from folio.llm.substrings import COVER, PERIOD, WINDOW, Hasher, op8_substrings, remove_repeats


def brute(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    times = Counter(tuple(w[i : i + WINDOW]) for w in words for i in range(len(w) - WINDOW + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - WINDOW + 1) if times[tuple(w[i : i + WINDOW])] > 1 for k in range(i, i + WINDOW)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_query_is_exact(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (n, g, hashlib.sha256(k.encode()).hexdigest()) for r, (n, g, k) in zip(rows, brute([r["text"] for r in rows]))}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op8_substrings(spark, data).collect()}
    assert got == want


def test_shared_passages_of_every_length_and_offset(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    texts = []
    for n in (33, 34, 35, 36, 40, 54, 55, 60, 80):
        for _ in range(3):
            a = [f"a{rng.random()}" for _ in range(rng.randint(0, 50))]
            start = rng.randint(0, 80 - n)
            texts.append(" \n".join(a + passage[start : start + n] + [f"b{rng.random()}"]))
    texts += ["x " * 90, None, "", "  \x1c é", " ".join(passage) + " " + " ".join(passage), texts[0], texts[0]]
    rows = [(i // 2, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(df, 8).collect())
    assert got == sorted((i, *b) for (i, _, _), b in zip(rows, brute(texts)))
    assert remove_repeats(df.limit(0), 8).count() == 0


def test_words_that_sums_of_powers_confuse_are_told_apart(spark):
    letters = "a"
    for _ in range(10):  # a word and its complement, alike to any sum of powers modulo 2**64
        letters += letters.translate(str.maketrans("ab", "ba"))
    other = letters.translate(str.maketrans("ab", "ba"))
    assert Hasher().words(letters.encode()) != Hasher().words(other.encode())
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{letters} {rest}"), (2, f"{other} {rest}")], "doc_id long, text string")
    assert [r["n_removed"] for r in remove_repeats(df, 8).collect()] == [0, 0]


def test_very_long_text_beside_short_ones(spark):
    words = " ".join(f"w{i % 90_000}" for i in range(300_000))
    df = spark.createDataFrame([(1, words), (2, "short"), (3, " ".join(f"w{i}" for i in range(100, 140)))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(df).collect()} == {1: 300_000, 2: 0, 3: 40}
