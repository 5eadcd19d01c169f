"""Source divergence audit: how the sources of a language differ in the use of its frequent terms.

The terms in ``LEAST_DOCS`` or more documents of a language are found by iceberg prefix refinement.
The first level counts, for each prefix of ``FIRST`` bytes, the documents that hold a longer term
with it, and counts the complete terms up to that length exactly; a prefix in too few documents is
discarded with all that it begins.  Each further level doubles the length and reads only terms whose
prefix was kept, until no prefix is left.  Kept prefixes reach the tasks as a bit table of bounded
size: a false bit lets a term be counted that is dropped later, a kept term has no prefix discarded.

Tasks count in dictionaries of bounded size before anything is shuffled.  Sources of a language are
compared two by two over its terms in blocks: a task gets some terms and two blocks of sources, and
adds whole matrices of differences.

Cases: null text, language and source are ''; a language without kept terms has pairs of value 0;
a group without terms has none to report and is still compared; documents are rows, whatever
their ids; a very long text is cut at separators, and its terms counted in one document; only
the columns named are read, whatever the others are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import load, python_rows, written

#: Documents of its language that a term needs; bytes of the prefixes of the first level.
LEAST_DOCS, FIRST = 30, 4
# Fixed values of the report.
UNIT, PRIOR, TOP = 1_000_000_000, 5, 50
#: Entries that a task counts at once, bytes of a text that it cuts at once.
HELD, SLICE = 400_000, 8 << 20
#: Spots of the table of kept prefixes as a power of two, at most, and of one segment.
TABLE_BITS, SEGMENT_BITS = 27, 16
#: Sources of a block, terms of a matrix, cells of a task.
BLOCK, ROWS, CELLS = 256, 2048, 400_000

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_lists(text: str):
    """The terms of a text in lists of bounded size."""
    data = text.encode("utf-8", "surrogatepass")
    start = 0
    while start < len(data):
        end = min(start + SLICE, len(data))
        part = data[start:end].translate(LETTERS)
        while end < len(data) and b" " not in part:
            end = min(end + SLICE, len(data))
            part = data[start:end].translate(LETTERS)
        if end < len(data):
            end = start + part.rindex(b" ") + 1
            part = part[: end - start]
        yield part.split()
        start = end


def spots(lang: str, prefix: bytes, bits: int) -> tuple[int, int]:
    digest = hashlib.blake2b(lang.encode("utf-8", "surrogatepass") + b"\0" + prefix, digest_size=8).digest()
    h = int.from_bytes(digest, "little")
    return h >> 64 - bits, h & (1 << bits) - 1


class Alive(dict):
    """Whether a prefix of a language was kept, as far as the table tells."""

    def __init__(self, lang: str, table: bytes, bits: int):
        super().__init__()
        self.lang, self.table, self.bits = lang, table, bits

    def __missing__(self, prefix: bytes) -> bool:
        if len(self) > HELD:
            self.clear()
        self[prefix] = found = all(self.table[s >> 3] >> (s & 7) & 1 for s in spots(self.lang, prefix, self.bits))
        return found


def level(docs: DataFrame, low: int, high: int, table: bytes | None, bits: int) -> DataFrame:
    """(lang, source, key, complete, docs, n) of the terms longer than ``low`` bytes with a kept prefix
    of ``low`` bytes: complete ones of ``high`` bytes at most, else (source null) their prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(pieces):
        docs_of: dict[tuple, Counter] = {}
        times: dict[tuple, Counter] = {}
        heads: dict[str, Counter] = {}
        alive: dict[str, Alive] = {}
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("key", pa.binary()), ("complete", pa.bool_()), ("docs", pa.int64()), ("n", pa.int64())])

        def flushed():
            for (lang, source), held in docs_of.items():
                keys, many, n = list(held), len(held), times[lang, source]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * many, pa.string()), pa.array([source] * many, pa.string()), pa.array(keys, pa.binary()), pa.array([True] * many), pa.array(held.values(), pa.int64()), pa.array([n[k] for k in keys], pa.int64())], schema=schema)
            for lang, held in heads.items():
                many = len(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * many, pa.string()), pa.nulls(many, pa.string()), pa.array(list(held), pa.binary()), pa.array([False] * many), pa.array(held.values(), pa.int64()), pa.nulls(many, pa.int64())], schema=schema)
            for held in (docs_of, times, heads, alive):
                held.clear()

        for batch in pieces:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                whole: set = set()
                begun: set = set()
                if low and lang not in alive:
                    alive[lang] = Alive(lang, shared.value, bits)
                kept = alive.get(lang)
                many = times.setdefault((lang, source), Counter())
                for words in term_lists(text):
                    own = set(words)
                    if low:
                        begun.update([w[:high] for w in own if len(w) > high and kept[w[:low]]])
                        words = [w for w in words if low < len(w) <= high and kept[w[:low]]]
                        own = set(words)
                    else:
                        begun.update([w[:high] for w in own if len(w) > high])
                        words = [w for w in words if len(w) <= high]
                        own = set(words)
                    many.update(words)
                    whole |= own
                docs_of.setdefault((lang, source), Counter()).update(whole)
                heads.setdefault(lang, Counter()).update(begun)
            if sum(map(len, docs_of.values())) + sum(map(len, heads.values())) + len(alive) > HELD:
                yield from flushed()
        yield from flushed()

    found = python_rows(docs, run, "lang string, source string, key binary, complete boolean, docs long, n long")
    return found.groupBy("lang", "source", "key", "complete").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def bit_table(kept: DataFrame, bits: int) -> bytes:
    """The spots of the prefixes ``kept`` (lang, key)."""
    import numpy as np

    low = (1 << min(bits, SEGMENT_BITS)) - 1

    def collect(batches):
        for batch in batches:
            every = np.array([s for lang, key in zip(*(c.to_pylist() for c in batch.columns)) for s in spots(lang, key, bits)], np.int64)
            every = np.unique(every)
            segment, start = np.unique(every >> SEGMENT_BITS, return_index=True)
            parts = [(x & low).astype(np.uint32).tobytes() for x in np.split(every, start[1:])] if len(every) else []
            yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(parts, pa.binary())], ["segment", "spots"])

    def merge(batches):
        key, held = None, np.zeros(low + 1, bool)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, at in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != key:
                    if key is not None:
                        yield row()
                    key = segment
                    held[:] = False
                held[np.frombuffer(at, np.uint32)] = True
        if key is not None:
            yield row()

    whole = kept.select("lang", "key").mapInArrow(collect, "segment int, spots binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")
    size = (low + 1) // 8
    table = bytearray((1 << bits) // 8)
    for r in whole.toLocalIterator():  # as many rows as the table has segments, whatever the input
        table[r["segment"] * size : (r["segment"] + 1) * size] = r["bits"]
    return bytes(table)


def frequent_terms(docs: DataFrame, least: int = LEAST_DOCS, first: int = FIRST, table_bits: int = TABLE_BITS) -> DataFrame:
    """(lang, source, key, n, total) of the terms in ``least`` documents of their language or more:
    occurrences in the group and in the language.  ``docs`` has lang, source and text, none null."""
    low, high, table, bits, levels = 0, first, None, 0, []
    while True:
        found = written(level(docs, low, high, table, bits), "terms")
        levels.append(found.where("complete").select("lang", "source", "key", "docs", "n"))
        kept = found.where(f"NOT complete AND docs >= {least}")
        many = kept.count()
        if not many:
            break
        bits = min(table_bits, max(10, (16 * many).bit_length()))
        table, low, high = bit_table(kept, bits), high, 2 * high
    terms = levels[0]
    for more in levels[1:]:
        terms = terms.unionByName(more)
    whole = terms.groupBy("lang", "key").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(f"docs >= {least}")
    return terms.drop("docs").join(whole.drop("docs"), ["lang", "key"])


def share(count, of):
    """1 + floor(UNIT * (count + PRIOR) / of) in exact numbers."""
    return F.expr(f"1 + (cast({UNIT} as decimal(38, 0)) * cast({count} + {PRIOR} as decimal(20, 0))) div cast({of} as decimal(20, 0))")


def divergence(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP, first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """The report: every other source of each group's language by distance, and its ``top`` terms."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    terms = written(frequent_terms(rows, least, first), "kept-terms")
    groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("x")).drop("x")
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    langs = terms.groupBy("lang", "key").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    stats = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "v", "lang_n"])
    stats = stats.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    stats = stats.withColumn("group_of", F.expr(f"group_n + {PRIOR} * v")).withColumn("lang_of", F.expr(f"lang_n + {PRIOR} * v"))
    stats = written(stats.withColumn("zero", F.when(F.col("v") > 0, share("0", "group_of")).otherwise(0)), "groups")
    cells = terms.join(stats, ["lang", "source"]).select("lang", "source", "no", "key", share("n", "group_of").alias("p"), share("total", "lang_of").alias("q"))
    cells = written(cells, "shares")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = cells.where("p > q").select("lang", "source", F.col("key").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    near = distances(cells, stats, block).withColumn("rank", F.row_number().over(by_value))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return near.withColumn("part", F.lit("pair")).select(*columns).unionByName(found.withColumn("part", F.lit("term")).select(*columns))


def distances(cells: DataFrame, stats: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language the sum of differences of all terms."""
    import numpy as np

    buckets = max(1, -(-cells.count() // CELLS))
    blocks = stats.groupBy("lang").agg((F.floor(F.max("no") / block) + 1).cast("int").alias("blocks"))

    def spread(df: DataFrame) -> DataFrame:
        """Each row once for every block of sources that its own is compared with."""
        own = F.floor(F.col("no") / block).cast("int")
        df = df.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("own", own)
        return df.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).select("lang", "a", "b", "bucket", "no", "key", "p")

    terms = cells.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).select("lang", "no", "key", "p", "bucket")
    zeros = stats.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).select("lang", "no", F.lit(None).cast("binary").alias("key"), F.col("zero").alias("p"), "bucket")

    def add(table: pa.Table) -> pa.Table:
        a, b, lang = table["a"][0].as_py(), table["b"][0].as_py(), table["lang"][0].as_py()
        no, p = table["no"].to_numpy(), table["p"].to_numpy()
        base = table["key"].is_null().to_numpy(zero_copy_only=False)
        order = np.argsort(no[base])
        sources, zero = no[base][order], p[base][order]
        codes = table.filter(pa.array(~base))["key"].combine_chunks().dictionary_encode()
        term, at, value = codes.indices.to_numpy(), np.searchsorted(sources, no[~base]), p[~base]
        order = np.argsort(term, kind="stable")
        term, at, value = term[order], at[order], value[order]
        many, left, right = len(codes.dictionary), np.flatnonzero(sources // block == a), np.flatnonzero(sources // block == b)
        total = np.zeros((len(left), len(right)), np.int64)
        for start in range(0, many, ROWS):
            cut = slice(*np.searchsorted(term, [start, start + ROWS]))
            held = np.tile(zero, (min(ROWS, many - start), 1))
            held[term[cut] - start, at[cut]] = value[cut]
            for i, x in enumerate(left):
                total[i] += np.abs(held[:, right] - held[:, x : x + 1]).sum(0)
        x, y = np.meshgrid(sources[left], sources[right], indexing="ij")
        once = x < y
        n = int(once.sum())
        return pa.table({"lang": pa.array([lang] * n, pa.string()), "x": pa.array(x[once], pa.int32()), "y": pa.array(y[once], pa.int32()), "value": pa.array(total[once], pa.int64()), "seen": pa.array([many] * n, pa.int64())})

    sums = spread(terms).unionByName(spread(zeros)).groupBy("lang", "a", "b", "bucket").applyInArrow(add, "lang string, x int, y int, value long, seen long")
    sums = sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    names = stats.select("lang", "no", "source", "zero", "v")
    first = names.select("lang", F.col("no").alias("x"), F.col("source").alias("x_source"), F.col("zero").alias("x_zero"))
    second = names.select("lang", F.col("no").alias("y"), F.col("source").alias("y_source"), F.col("zero").alias("y_zero"), "v")
    full = sums.join(first, ["lang", "x"]).join(second, ["lang", "y"])
    full = full.withColumn("value", F.expr("value + (v - seen) * abs(x_zero - y_zero)"))
    ways = F.explode(F.array(F.struct(F.col("x_source").alias("source"), F.col("y_source").alias("item")), F.struct(F.col("y_source").alias("source"), F.col("x_source").alias("item"))))
    return full.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents", "text", "lang", "source"))


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), uses AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS nd FROM uses GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS total FROM counts GROUP BY ALL HAVING sum(nd) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), sums AS (
    SELECT *, sum(n) OVER (PARTITION BY lang, source) AS group_n, count(*) OVER (PARTITION BY lang, source) AS v,
        sum(total) OVER (PARTITION BY lang, source) AS lang_n
    FROM grid
), shares AS (
    SELECT lang, source, term, n,
        (1 + (1000000000::HUGEINT * (n + 5)) // (group_n + 5 * v))::BIGINT AS p,
        (1 + (1000000000::HUGEINT * (total + 5)) // (lang_n + 5 * v))::BIGINT AS q
    FROM sums
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
    (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM every QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""
