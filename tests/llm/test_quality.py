"""Quality rules against a plain version."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm.quality import Judge, Rules, judge, op3_quality


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    hit = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 3)}
    lines, duplicates = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in lines
            lines.append(line)
    n = len(words)
    return sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(hit), n, n < 50 or 100 * len(hit) > 50 * n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cé", "#x", "\n", " ", "\x1c", "\x85", "\t", "中", "a b c ", "a b c\n"]), max_size=60).map("".join))
def test_base_figures(text):
    assert Judge(Rules())(text)[:6] == base(text)


ENDS, CLOSE = ".!?…。！？।॥؟۔։።", "\"'”’»)]}›」』"


def verdict(text):
    """The lines that stay and the verdict, straight from the rules."""
    rows = []
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if words:
            rows.append((line, words, bool(re.search(f"[{re.escape(ENDS)}][{re.escape(CLOSE)}]*[\\x20\\x09-\\x0D]*\\Z", line))))
    kept, n_kept = [], 0
    for i, (line, words, ends) in enumerate(rows):
        n = len(words)
        low = high = i
        is_short = lambda r: len(r[1]) <= 3 and not r[2]
        while low > 0 and is_short(rows[low - 1]):
            low -= 1
        while high + 1 < len(rows) and is_short(rows[high + 1]):
            high += 1
        parts = re.split(r"[\x20\x09-\x0D][|»›>·•][\x20\x09-\x0D]", line)
        bad = (
            line in [r[0] for r in rows[:i]]
            or (is_short(rows[i]) and high - low >= 3)
            or (n >= 10 and not ends)
            or any(x in line.lower() for x in Rules().boilerplate)
            or (len(parts) >= 4 and sum(len(re.findall(r"[^\x20\x09-\x0D]+", p)) for p in parts) <= 3 * len(parts))
            or 2 * sum(any(c in w for c in "#*$%&|<>") for w in words) > n
            or (n >= 4 and 10 * sum(w.isupper() for w in words) > 8 * n)
        )
        if not bad:
            kept.append(line)
            n_kept += n
    n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    return n_kept, "\n".join(kept), not base(text)[5] and 2 * n_kept >= n


PIECES = ["a b c", "\n", "\n", " one two three four five six", " ten. ", "end!”\n", "Home", "\nAbout us", " | ", " > ", "#x ", "NO WAY OUT NOW", "all rights reserved", "\xa0", "\x1c", "\x85", "نص؟", "है।"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_rules_against_a_plain_version(text):
    assert Judge(Rules())(text)[6:] == verdict(text)
    long = text + "\n" + "\n".join(f"Sentence {i} has w{i} x{i} y{i} z{i}." for i in range(8))
    assert Judge(Rules())(long)[6:] == verdict(long)


def test_words_are_the_same_in_lines_and_texts(spark):
    kept = [f"p{i}\xa0q{i}\xa0r{i}." for i in range(10)]
    text = "\n".join([*kept, "w " * 63])
    got = judge(spark.createDataFrame([(text,)], "text string")).first()
    assert (got["n_words"], got["kept_words"], got["kept"]) == (73, 10, False)


def test_menus_of_single_lines_and_long_texts(spark):
    menu = "\n".join(["Home", "About us", "Products", "Contact", "Imprint"] * 12)
    urdu = "\n".join(f"یہ جملہ{i} " + " ".join(f"لفظ{i}x{k}" for k in range(45)) + "۔" for i in range(4))
    long = "\n".join(f"Line {i} tells{i} something{i} new{i}." for i in range(200_000))
    rows = {r["doc_id"]: r["kept"] for r in judge(spark.createDataFrame([(1, menu), (2, urdu), (3, long)], "doc_id long, text string")).collect()}
    assert rows == {1: False, 2: True, 3: True}


def test_query(spark, data):
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    rows = op3_quality(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_words"], r["base_failed"]) == base(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_rules_and_cases(spark):
    prose = " ".join(f"word{i} stands{i} here and{i} tells{i} of thing{i}." for i in range(20))
    nav = "Home | News | Sport | Contact | About us"
    rows = [(1, prose), (2, prose + "\n" + nav), (3, "\n".join([nav.replace("us", str(i)) for i in range(30)])), (4, None), (5, ""), (6, " ".join(f"w{i}###" for i in range(90))), (1, prose)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in judge(df).collect()}
    assert [got[i]["kept"] for i in range(1, 7)] == [True, True, False, False, False, False]
    assert got[2]["cleaned"] == prose and got[4]["base_failed"]
    assert judge(df.limit(0)).count() == 0
