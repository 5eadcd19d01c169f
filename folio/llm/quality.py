"""Line-first quality rules.

Each line of a text is judged first: a line fails if it has no end of a sentence though it is
long enough to be one, is navigation (short parts between separators, or one of a run of short
lines without an end mark), boilerplate (a fixed notice), mostly symbols, shouting (most words in
capitals) or a repeat of an earlier line.  Failing lines are removed and the document is rejected
when the lines that stay hold too small a part of its words.  Document-level base figures
(repetition, length) are computed on the text as it came.

Words are always those of the contract (what spaces and \\x09-\\x0D separate), in lines as in texts.
The limit of the punctuation rule is measured on labelled documents (README): lines of ten words
or more without an end mark are 12 % of those in documents of low quality and 0.04 % in others.

Everything is local to a row: one pass, no shuffle, and every other column passes through.

Cases: a null or empty text has no words and fails the base rules; a very long text is judged
whole; repeated rows get the same verdict each; columns named as the results give way, except
the text; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import SPACES, load, python_rows

# The symbols and limits of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 50, 3, 50


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules; percentages are of a line's or a document's words."""

    #: A line is symbol noise if more than this share of its words hold a symbol.
    symbol_words: int = 50
    #: A line is navigation with this many parts between separators, or more.
    navigation_parts: int = 4
    navigation_part_words: int = 3
    #: A line of this many words or more that does not end in an end mark is unpunctuated.
    unpunctuated_words: int = 10
    end_marks: str = ".!?…。！？।॥؟۔։።"
    #: What may follow an end mark.
    closers: str = "\"'”’»)]}›」』"
    #: So many lines or more in a row, of so few words and without an end mark, are navigation.
    menu_lines: int = 4
    menu_words: int = 3
    boilerplate: tuple[str, ...] = (
        "licensed under the", "all rights reserved", "permission is hereby granted", "copyright (c)", "terms of use",
        "privacy policy", "cookie policy", "without warranties or conditions", "subscribe to our newsletter", "lorem ipsum",
    )
    separators: str = r"[\x20\x09-\x0D][|»›>·•][\x20\x09-\x0D]"
    #: A document is rejected if less than this share of its words stays.
    least_kept: int = 50
    #: Share of words in capitals beyond which a line counts as shouting, if it has four or more.
    shouting_words: int = 80


def columns() -> str:
    return "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_words long, base_failed boolean, kept_words long, cleaned string, kept boolean"


class Judge:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.notice = re.compile("|".join(map(re.escape, rules.boilerplate)), re.I) if rules.boilerplate else None
        self.separator = re.compile(rules.separators)
        self.marks = set(rules.end_marks)
        self.symbol = re.compile(f"[{re.escape(SYMBOLS.decode())}]")
        self.other = bytes(b for b in range(256) if b not in SYMBOLS)
        self.inner = bytes(range(0x80, 0xC0))

    def ends(self, line: str) -> bool:
        """Whether a line ends a sentence."""
        return line.rstrip(SPACES).rstrip(self.rules.closers)[-1:] in self.marks

    def fails(self, line: str, words: list[bytes], ends: bool) -> str:
        """The rule that a line breaks by itself, or an empty string."""
        rules, n = self.rules, len(words)
        if n >= rules.unpunctuated_words and not ends:
            return "punctuation"
        if self.notice and self.notice.search(line):
            return "boilerplate"
        parts = self.separator.split(line)
        if len(parts) >= rules.navigation_parts and sum(len(p.encode("utf-8", "surrogatepass").split()) for p in parts) <= rules.navigation_part_words * len(parts):
            return "navigation"
        if self.symbol.search(line) and 100 * sum(1 for w in words if len(w.translate(None, SYMBOLS)) < len(w)) > rules.symbol_words * n:
            return "symbols"
        if n >= 4 and line != line.lower() and 100 * sum(1 for w in words if w.decode("utf-8", "surrogatepass").isupper()) > rules.shouting_words * n:
            return "shouting"
        return ""

    def menus(self, lines: list[tuple]) -> list[bool]:
        """Which of the lines (words, ends) stand in a run of short lines without an end mark."""
        short = [len(words) <= self.rules.menu_words and not ends for _, words, ends in lines]
        out = []
        for flag, run in itertools.groupby(short):
            n = sum(1 for _ in run)
            out += [flag and n >= self.rules.menu_lines] * n
        return out

    def repeated(self, words: list[bytes]) -> int:
        """Words in windows of three that the text holds twice or more."""
        import numpy as np

        n = len(words)
        if n <= WINDOW:
            return 0
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        m = len(number)
        if m == n:
            return 0
        ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
        pairs = ids[:-1] * m + ids[1:]
        if m >= 1 << 20:  # keeps the window's number within 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        windows = pairs[:-1] * m + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(n - 2, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(WINDOW):
            covered[k : k + n - 2] |= twice
        return int(covered.sum())

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        n = len(words)
        word_chars = len(b"".join(words).translate(None, self.inner))
        n_symbols = len(data.translate(None, self.other))
        lines = [(line, own, self.ends(line)) for line, raw in zip(text.split("\n"), data.split(b"\n")) if (own := raw.split())]
        seen: set[str] = set()
        duplicates = kept_words = 0
        kept_lines = []
        for (line, own, ends), menu in zip(lines, self.menus(lines)):
            if line in seen:
                duplicates += 1
                continue
            seen.add(line)
            if menu or self.fails(line, own, ends):
                continue
            kept_lines.append(line)
            kept_words += len(own)
        repeated = self.repeated(words)
        failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
        kept = not failed and 100 * kept_words >= self.rules.least_kept * n
        return word_chars, n_symbols, duplicates, repeated, n, failed, kept_words, "\n".join(kept_lines), kept


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` with the base figures, ``cleaned`` (the lines that passed) and ``kept``."""
    added = [c.split()[0] for c in columns().split(", ")]
    rest = docs.drop(*(c for c in added if c != text))
    names = rest.columns

    def run(pieces):
        one = Judge(rules)
        types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.string(), pa.bool_()]
        for batch in pieces:
            rows = [one(t) for t in batch.column(names.index(text)).to_pylist()]
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return python_rows(rest, run, f"{fields}, {columns()}", text=text)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    found = judge(load(spark, sf_dir, "documents", "doc_id", "text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("doc_id", *base, "kept_words", F.sha2(F.col("cleaned").cast("binary"), 256).alias("cleaned_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS n FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
c AS (SELECT row, count(DISTINCT k) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY row),
s AS (SELECT row, k, lines[k] AS line FROM (SELECT row, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT row, string_split(text, chr(10)) AS lines FROM d))),
l AS (SELECT row, k, line, row_number() OVER (PARTITION BY row, line ORDER BY k) AS nth, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM s WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
e AS (SELECT *, len(words) AS n, string_split_regex(line, '[\x20\x09-\x0D][|»›>·•][\x20\x09-\x0D]') AS parts,
  regexp_matches(line, '[.!?…。！？।॥؟۔։።]["''”’»)\]}›」』]*[\x20\x09-\x0D]*$') AS ends FROM l),
m AS (SELECT *, n <= 3 AND NOT ends AS short, row_number() OVER (PARTITION BY row ORDER BY k) - row_number() OVER (PARTITION BY row, n <= 3 AND NOT ends ORDER BY k) AS run FROM e),
r AS (SELECT *, short AND count(*) OVER (PARTITION BY row, short, run) >= 4 AS menu FROM m),
f AS (SELECT *, menu OR regexp_matches(line, '(?i)licensed under the|all rights reserved|permission is hereby granted|copyright \(c\)|terms of use|privacy policy|cookie policy|without warranties or conditions|subscribe to our newsletter|lorem ipsum')
    OR (len(parts) >= 4 AND coalesce(list_sum(list_transform(parts, lambda p: len(regexp_extract_all(p, '[^\x20\x09-\x0D]+')))), 0) <= 3 * len(parts))
    OR 100 * len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > 50 * n
    OR (n >= 4 AND 100 * len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) > 80 * n)
    OR (n >= 10 AND NOT ends) AS fails FROM r),
k AS (SELECT row, CAST(sum(nth > 1) AS BIGINT) AS dup, CAST(coalesce(sum(n) FILTER (nth = 1 AND NOT fails), 0) AS BIGINT) AS kept_words, string_agg(line, chr(10) ORDER BY k) FILTER (nth = 1 AND NOT fails) AS cleaned FROM f GROUP BY row),
a AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words, coalesce(cleaned, '') AS cleaned
  FROM w LEFT JOIN c ON w.row = c.row LEFT JOIN k ON w.row = k.row),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * kept_words >= 50 * n_words AS kept, kept_words, sha256(cleaned) AS cleaned_sha256 FROM b
"""
