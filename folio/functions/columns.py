"""Expressions with semantics that differ from Spark's own: rounding, clamping, white space, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of ECMAScript's \s, as a Java character class body.
SPACE = r"\t\n\x0B\f\r    -     　﻿"
# The presets of the search for personal data.
PRESETS = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "phone": rf"\+?\d[\d{SPACE}().-]{{7,}}\d",
    "number": r"\b\d{4,}\b",
}


#: Values that a running sum or maximum takes in one fold; what precedes each such block is added after.
BLOCK = 32


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """The keys of pages and further columns, computed once: Spark copies what a projection computes into
    the filters and projections after it, but not what a generator makes."""
    return df.select("doc_id", "page_no", F.explode(F.array(F.struct(*columns))).alias("__once")).select("doc_id", "page_no", "__once.*")


def running(values: Column, zero: Column, merge) -> Column:
    """For each value what ``merge`` makes of all before it, ``zero`` for the first; ``merge`` is associative."""
    def scan(part: Column) -> Column:
        # an empty list whose values may be null
        start = F.struct(zero.alias("sum"), F.transform(F.slice(part, F.lit(1), F.lit(0)), lambda v: F.when(v.isNull(), merge(zero, v))).alias("before"))
        return F.aggregate(part, start, lambda acc, v: F.struct(merge(acc["sum"], v).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")))

    def dealt(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: scan(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
        joined = lambda parts: F.flatten(F.zip_with(parts, scan(F.transform(parts, lambda p: p["sum"]))["before"], lambda p, first: F.transform(p["before"], lambda v: merge(first, v))))
        return F.when(F.size(values) <= BLOCK, scan(values)["before"]).otherwise(bound(blocks, joined))

    return bound(values, dealt)


def half_up(v: Column) -> Column:
    """floor(v + 0.5), also for negative numbers."""
    return F.floor(v + 0.5)


def clamp8(v: Column) -> Column:
    """Store into a clamped byte: 0..255, halves to even."""
    return F.bround(F.least(F.greatest(v, F.lit(0)), F.lit(255))).cast("int")


def quarter_turns(v: Column) -> Column:
    """A rotation snapped to 0, 90, 180 or 270; null counts as 0."""
    return F.pmod(half_up(F.coalesce(v, F.lit(0)) / 90) * 90, F.lit(360)).cast("int")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def format_bytes(n: Column) -> Column:
    """Bytes as ``B``, ``KB`` or ``MB``; exact halves go to the even digit, as in SQL's ``format``."""
    kb, mb = n / 1024, n / (1024 * 1024)
    even = lambda v, digits, unit: F.format_string(f"%.{digits}f {unit}", F.bround(v, digits))
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024 * 1024, F.when(kb < 10, even(kb, 1, "KB")).otherwise(even(kb, 0, "KB")))
        .otherwise(F.when(mb < 10, even(mb, 2, "MB")).otherwise(even(mb, 1, "MB")))
    )


def lenient(pattern: str) -> str | None:
    """The pattern if it is not empty and valid, else None: searches then find nothing."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern or None
