"""Threshold-scaled fingerprints (a fixed fraction of all shingle hashes), in DataFrame functions.

A fingerprint keeps every hash of five consecutive words that falls below a fixed fraction of
the hash range.  Its size follows the document's, so a short text can be sought in a long one:
the union of two fingerprints is the fingerprint of the two texts' shingles, and intersections
estimate likeness (Jaccard) and containment without the texts.

``op9`` compares each document with an edited text that needs the next document in descending
id order.  The ids are cut into ranges of about equal rows; each range gets, once more, the
first document of the range after it, so one shuffle by range finds every neighbour and no
task holds more than one range.

Cases: a null text counts as empty; a text of fewer than five words is one shingle; equal texts
are fully alike whatever their fingerprints hold; otherwise two empty fingerprints have
likeness 0.  Null ids come last; equal ids stand in the order of a hash of their texts, then of
the texts, and an id that many rows share is cut into ranges by that hash.  Very long texts are
read whole.  Columns named like the working ones (``__`` and ``next_``) give way.  A table of one
row is its own neighbour; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import WORD, load

#: Words of a shingle; the fraction of hashes kept is 1 / 2**FRACTION_BITS.
SHINGLE, FRACTION_BITS = 5, 2
#: Quantiles of the ids (COARSE * COARSE, found in two steps), and ranges in all.
COARSE, MOST_RANGES = 24, 1 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sketch(words: Column, bits: int = FRACTION_BITS) -> Column:
    """Sorted distinct hashes of a column of words that lie in the fraction kept."""
    n = F.size(words)
    shingles = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    hashes = F.when(n >= SHINGLE, shingles).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - bits) == 0)))


def fingerprint(docs: DataFrame, *, text: str = "text", out: str = "sketch", bits: int = FRACTION_BITS) -> DataFrame:
    """``docs`` with the column ``out array<bigint>``."""
    split = docs.withColumn("__words", words(F.coalesce(F.col(text), F.lit(""))))
    return split.withColumn(out, sketch(F.col("__words"), bits)).drop("__words")


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' shingles."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Part of the smaller fingerprint that the larger holds."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def shown(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def id_ranges(docs: DataFrame, key: str, tie: str) -> tuple[Column, DataFrame]:
    """The range of a row, numbered in descending id order, and for each range with rows the id and
    ``tie`` of its first rows and the range before it (before the first: the last).

    Ranges lie between quantiles of the ids, each cut into equal widths as often as the shuffle
    has partitions for; there are ``MOST_RANGES`` at most, whatever the input.  Ids that are several
    quantiles, and rows without an id, are cut by ``tie`` instead."""
    parts = [i / (COARSE * COARSE) for i in range(1, COARSE * COARSE)]
    found = docs.agg(F.percentile_approx(key, parts, 10_000).alias("e"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    edges = sorted({*(found["e"] or [])}, reverse=True)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = min(MOST_RANGES // (COARSE * COARSE + 2), max(1, -(-2 * partitions // (COARSE * COARSE))))
    rows = [edges[i : i + COARSE] for i in range(0, len(edges), COARSE)]

    def longs(values) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    number = F.lit(0)
    if rows:
        row = F.size(F.filter(longs([r[0] for r in rows]), lambda e: e >= F.col(key)))
        number = F.when(row == 0, 0).otherwise((row - 1) * COARSE + F.size(F.filter(F.get(F.array(*map(longs, rows)), row - 1), lambda e: e >= F.col(key))))
    if cuts > 1 and edges:
        high, low = (F.get(longs(x), number).cast("double") for x in ([found["high"], *edges], [*edges, found["low"]]))
        part = F.floor((high - F.col(key).cast("double")) / F.greatest(high - low, F.lit(1.0)) * cuts)
        number = number * cuts + F.least(F.greatest(part, F.lit(0)), F.lit(cuts - 1))
    number = F.when(F.col(key).isNull(), (len(edges) + 1) * cuts).otherwise(number).cast("int")
    hot = [e for e in edges if found["e"].count(e) > 1]
    # of the rows in the range of a hot id, those with greater ids come first and those with smaller ones last
    place = F.size(F.filter(longs(hot), lambda e: e > F.col(key))) * 2 + F.array_contains(longs(hot), F.col(key)).cast("int") if hot else F.lit(0)
    own = F.when(F.col(key).isNull(), 0).otherwise(place)
    pieces = F.when(F.col(key).isNull(), COARSE * COARSE * cuts)
    for e in hot:
        pieces = pieces.when(F.col(key) == F.lit(e), found["e"].count(e) * cuts)
    piece = F.floor((F.col(tie) / 2.0**64 + 0.5) * F.coalesce(pieces, F.lit(0)))
    number = F.struct(number.alias("n"), own.cast("int").alias("own"), piece.cast("int").alias("piece"))
    firsts = docs.select(number.alias("range"), F.struct(F.bitwise_not(F.col(key)).alias("id"), F.col(tie).alias("tie")).alias("at")).groupBy("range").agg(F.min("at").alias("at"))
    every = Window.orderBy("range")
    last = F.max("range").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return number, firsts.select("range", F.bitwise_not("at.id").alias("first"), F.col("at.tie").alias("tie"), F.coalesce(F.lag("range").over(every), last).alias("before"))


def with_next(docs: DataFrame, *, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` from the next row in descending order of ``key``; after
    the last row comes the first."""
    docs = docs.withColumn("__tie", F.xxhash64(columns[0]))
    number, firsts = id_ranges(docs, key, "__tie")
    firsts = firsts.toDF("__range", "__first", "__first_tie", "__before")
    rows = docs.withColumn("__range", number).join(F.broadcast(firsts), "__range")
    # the first of a range stands, as a copy, at the end of the range before it
    own = F.struct(F.col("__range").alias("range"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("__before").alias("range"), F.lit(True).alias("copy"))
    copies = F.when(F.col(key).eqNullSafe(F.col("__first")) & (F.col("__tie") == F.col("__first_tie")), F.array(own, copy)).otherwise(F.array(own))
    order = Window.partitionBy("__range").orderBy("__copy", F.col(key).desc_nulls_last(), "__tie", *columns[:1])
    rows = rows.withColumn("__at", F.explode(copies)).withColumn("__copy", F.col("__at.copy")).withColumn("__range", F.col("__at.range")).drop("__at", "__first", "__first_tie", "__before")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.where(~F.col("__copy")).drop("__copy", "__range", "__tie")


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(fingerprint(docs), key="doc_id", columns=["text", "sketch"])
    half = (F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    rows = fingerprint(rows, text="edited", out="edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("sketch")).alias("fingerprint"),
        shown(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.when(F.col("text") == F.col("edited"), 1.0).otherwise(likeness(F.col("sketch"), F.col("edited_sketch"))).alias("near_edited"),
        F.when(F.col("text") == F.col("next_text"), 1.0).otherwise(likeness(F.col("sketch"), F.col("next_sketch"))).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )
