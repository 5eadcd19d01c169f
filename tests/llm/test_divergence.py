"""Kept terms and distances of sources against plain counts."""

import random
import re
from collections import Counter, defaultdict

import pytest

from folio.llm import divergence as module
from folio.llm.divergence import divergence, frequent_terms, term_lists

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, least=30, top=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = {}
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(n):
            of = sum(n[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 5) // of for t in kept}

        q, p = shares(total), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(found[: top if part == "term" else None], 1):
                    out[lang, s, part, rank] = (item, value)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def found(df):
    rows = df.collect()
    out = {(r["lang"], r["source"], r["part"], r["rank"]): (r["item"], r["value"]) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed, n, sources):
    rng = random.Random(seed)
    words = [rng.choice(["a", "Ab", "abcd", "abcde", "éü", "straße", "字字字", "abcdefghijklmnop" * 3, "x" * 200, "😀z"]) + "bcd"[: rng.randrange(4)] * rng.randrange(3) for _ in range(60)]
    rows = []
    for _ in range(n):
        text = rng.choice([" ", "\n", "-1_", "\x7f"]).join(rng.choice(words) for _ in range(rng.randrange(30)))
        rows.append((rng.choice([None, "", text, text, text]), rng.choice([None, "", "en", "en", "de"]), rng.choice(sources)))
    return rows


@pytest.mark.parametrize("least, first", [(30, 4), (2, 1), (9, 3)])
def test_report_is_exact(spark, least, first):
    rows = corpus(1, 300, [None, "", "web", "Web", "books", "é"]) + [("12 34", "xx", "a"), (None, "xx", "b"), ("", "xx", None)]
    df = table(spark, rows).selectExpr("*", "1 AS key", "2 AS docs", "3 AS p").repartition(5)
    assert found(divergence(df, least=least, first=first)) == plain(rows, least)


def test_many_sources_are_compared_by_blocks(spark):
    rows = corpus(2, 200, [f"s{i}" for i in range(23)])
    assert found(divergence(table(spark, rows), least=5, block=4)) == plain(rows, 5)


def test_a_full_table_of_prefixes_loses_nothing(spark):
    rows = [(t or "", lang or "", s or "") for t, lang, s in corpus(3, 300, ["a", "b"])]
    few = {tuple(r) for r in frequent_terms(table(spark, rows), 8, 2, table_bits=10).collect()}
    assert few == {tuple(r) for r in frequent_terms(table(spark, rows), 8, 2).collect()} and few


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    text = "ab Cd" + "é" * 50 + " efg" * 20 + "h" * 300 + " i"
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(module, "SLICE", size)
        assert [w.decode() for part in term_lists(text) for w in part] == terms_of(text)


def test_a_document_counts_once_for_a_prefix(spark):
    rows = [(" ".join(f"prefix{i}" for i in range(40)), "en", "a")] * 29
    assert not [r for r in divergence(table(spark, rows)).collect() if r["part"] == "term"]
    assert frequent_terms(table(spark, rows + rows[:1])).count() == 40 - 40 + len({t for t in terms_of(rows[0][0])})


def test_empty_table(spark):
    assert divergence(table(spark, [])).count() == 0
