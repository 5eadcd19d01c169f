"""Filter interaction audit: what each of five filters removes in every order of the five.

A counting Bloom prepass finds the texts that may be repeated: each task counts its texts' hashes in
a sketch of counters that stop at two, the sketches are merged by segment, and a text with a spot
that was counted once is certainly unique.  Only the texts that may be repeated are shuffled, for
the exact least id of each full text.  A digest carries that id back, and only to rows of the
same id, so a text of many copies is never one group of rows.  The flags of the five filters are one
mask; the rows become counts by part, mask and label, and every figure of the report is a sum of them.

The sketch has eight spots or more for each document up to 2^``MOST_BITS`` spots (32 MB as bits).
Beyond some 10^8 documents it clears fewer of them, beyond 10^9 hardly any: then nearly all texts
take the exact way once.  Results never depend on it.

Cases: a null text is an empty one, a null language the part ''; a null id is no smaller id and has
none, and has no labels; rows of equal id and text do not repeat each other; an id with several
labels is good (or toxic) if one of them says so; very long texts are read whole; only the columns
named are read, whatever the others are called; an empty table gives an empty report.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import load, python_rows, written

FILTERS = "ABCDE"
# The limits and symbols of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
CAPITALS, CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Spots of the sketch as a power of two, at most, and of one segment; hashes that a task counts at once.
MOST_BITS, SEGMENT_BITS, HELD = 28, 18, 1 << 20


def mask(data: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = data.split()
    n = len(words)
    points = len(data.translate(None, CONTINUED))
    return (
        (n < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1
        | (100 * (len(data) - len(data.translate(None, CAPITALS))) > MOST_CAPITALS * points) << 2
        | (len(data.translate(None, SYMBOLS)) < len(data)) << 3
    )


def spots(hashes, bits: int):
    """The two spots of each hash."""
    import numpy as np

    h = hashes.view(np.uint64)
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def sketch(hashes: DataFrame, bits: int) -> bytes:
    """The spots counted twice or more, as bits.  ``hashes`` has one column, a hash for each text."""
    import numpy as np

    low = (1 << min(bits, SEGMENT_BITS)) - 1

    def count(batches):
        held, size = [], 0

        def segments():
            first, second = spots(np.concatenate(held), bits)
            spot, times = np.unique(np.concatenate([first, second[second != first]]), return_counts=True)
            segment, start = np.unique(spot >> SEGMENT_BITS, return_index=True)
            cut = [*start.tolist(), len(spot)]
            for s, a, b in zip(segment.tolist(), cut, cut[1:]):
                yield s, (spot[a:b] & low).astype(np.uint32).tobytes(), np.packbits(times[a:b] > 1).tobytes()

        def flushed():
            rows = segments()
            while part := list(itertools.islice(rows, 64)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int32(), pa.binary(), pa.binary()))], ["segment", "spots", "twice"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size > HELD:
                yield from flushed()
                held, size = [], 0
        if size:
            yield from flushed()

    def merge(batches):
        """Adds the sketches of each segment as they stream by."""
        key, times = None, np.zeros(low + 1, np.uint8)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(times > 1).tobytes()], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, at, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != key:
                    if key is not None:
                        yield row()
                    key = segment
                    times[:] = 0
                at = np.frombuffer(at, np.uint32)
                times[at] = np.minimum(2, times[at] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)))
        if key is not None:
            yield row()

    parts = hashes.mapInArrow(count, "segment int, spots binary, twice binary")
    whole = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")
    size = (low + 1) // 8
    table = bytearray(max(1, (1 << bits) // 8))
    for r in whole.toLocalIterator():  # as many rows as the sketch has segments, whatever the input
        table[r["segment"] * size : (r["segment"] + 1) * size] = r["bits"]
    return bytes(table)


def judged(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang", most_bits: int = MOST_BITS) -> DataFrame:
    """(id, part, mask, text) of every document: the mask of A to D, and the text where it may be repeated."""
    import numpy as np

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    bits = min(most_bits, max(16, (8 * docs.count()).bit_length()))
    table = docs.sparkSession.sparkContext.broadcast(sketch(rows.select("h"), bits))

    def run(batches):
        twice = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            masks = [mask(t.encode("utf-8", "surrogatepass")) for t in texts]
            first, second = spots(batch.column(3).to_numpy(zero_copy_only=False), bits)
            may = twice[first >> 3] >> (7 - (first & 7)) & twice[second >> 3] >> (7 - (second & 7)) & 1 > 0
            kept = pa.array([t if m else None for t, m in zip(texts, may.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), kept], ["id", "part", "mask", "text"])

    return python_rows(rows, run, "id long, part string, mask int, text string")


def mask_counts(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang", most_bits: int = MOST_BITS) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail just the filters of each mask."""
    found = written(judged(docs, key=key, text=text, part=part, most_bits=most_bits), "audit-rows")
    repeats = found.where("text IS NOT NULL")
    firsts = repeats.groupBy("text").agg(F.min("id").alias("first")).where("first IS NOT NULL").select(F.col("first"), F.sha2("text", 256).alias("of"))
    rows = found.groupBy("id", "part", "mask", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"))
    known = rows.where("id IS NOT NULL").join(firsts, (F.col("id") == F.col("first")) & (F.col("digest") == F.col("of")), "left")
    known = known.withColumn("mask", F.when(F.col("digest").isNotNull() & F.col("first").isNull(), F.col("mask") + 16).otherwise(F.col("mask")))
    told = labels.where(f"`{key}` IS NOT NULL").groupBy(F.col(key).cast("long").alias("label_id"))
    told = told.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = known.join(told, F.col("id") == F.col("label_id"), "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    without = rows.where("id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return known.unionByName(without).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def report(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the counts by mask."""
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    rows = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = F.expr(f"1 << (instr('{FILTERS}', substr(filter_order, step, 1)) - 1)")
    earlier = sum((F.expr(f"if(instr(filter_order, '{x}') < step, {1 << i}, 0)") for i, x in enumerate(FILTERS)), F.lit(0))
    fails = F.col("mask").bitwiseAND(bit) > 0
    gone = F.col("mask").bitwiseAND(earlier) > 0
    # of the 120 orders, those in which a filter is the first of all that a document fails
    share = F.expr(f"{len(orders)} div greatest(bit_count(mask), 1)")

    def total(condition, n=F.col("n")):
        return F.sum(F.when(condition, n).otherwise(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"),
        total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
        total(fails, F.col("n") * share).alias("shapley"),
    )


def op12_interaction(spark, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents", "doc_id", "text", "lang"), load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return report(mask_counts(docs, labels))


OP12_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), told AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), flags AS (
    SELECT t.doc_id, part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        len(words) < 100 AS a,
        100 * len(list_distinct(words)) < 80 * len(words) AS b,
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e
    FROM texts t LEFT JOIN told l ON t.doc_id = l.doc_id
), masks AS (
    SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n FROM flags GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM letters p, letters q, letters r, letters s, letters t
    WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND (p.bit | q.bit | r.bit | s.bit | t.bit) = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), rows AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & bit = 0 AND mask & earlier = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0 AND good = 1), 0)::BIGINT AS good_lost,
        coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0 AND toxic = 1), 0)::BIGINT AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM rows
"""
