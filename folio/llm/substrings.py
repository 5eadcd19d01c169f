"""Removal of repeated passages, found through difference-cover anchors.

A window is ``WINDOW`` consecutive words of one text; a word is removed if a window over it has
a word sequence that starts anywhere else too.  Two equal windows may begin at any two
positions, yet a difference cover of the residues modulo ``PERIOD`` holds, for any pair of
positions, an offset below the period that puts both on a cover residue.  So it is enough to
hash the shorter anchor of ``WINDOW - PERIOD + 1`` words at cover positions, five in 21: equal
windows share one equal anchor at least.

1. Anchors of every text are counted by hash; the hashes met twice go into a bit table of fixed
   size, cut by hash bucket, of which every executor gets a copy.
2. Texts are read again.  An anchor whose bit is set extends to the windows of words around it;
   each is told by the BLAKE2b digest (96 bits) of its words joined by single spaces, which is
   counted over the corpus.  Texts without such windows are done at once.  False bits, and
   anchors that collide, only cost work: the digests of the words decide.
3. The windows met twice come back to their texts as bit strings, and covered words go.

Digests travel in sorted blobs by (batch of texts, bucket), each distinct one of a batch once
with a mark for repeats in the batch, so copies and common passages, however many, add at most
one entry for each batch and no bucket turns hot.  Buckets and partitions follow the bytes of
the texts, so a task's share stays the same at any size.

Cases: a null text has no words; texts shorter than a window lose nothing; texts of any length
are read whole; repeated rows and exact copies of a window's length lose every covered word,
the first copy too; equal ids are separate rows; other columns are left out, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import load, partitions_for, python_rows, text_bytes, written

WINDOW, PERIOD = 35, 21
#: A difference cover of the residues modulo 21 (every difference occurs).
COVER = (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
#: Bits of the table of repeated anchors (16 MB, whatever the input), set four for each hash;
#: it is put together from segments of 2**SEGMENT_BITS.
TABLE_BITS, SEGMENT_BITS = 27, 19
#: Bytes of text in a batch whose windows travel together.
BATCH_BYTES = 12 << 20
#: Bytes of text for each bucket of digests: two bytes of digests travel for one of text at most.
BUCKET_BYTES = 12 << 20


class Hasher:
    """64-bit hashes of words, and of runs of them from sums of powers of odd numbers."""

    def __init__(self):
        import numpy as np

        random = np.random.Generator(np.random.PCG64(20))
        self.letters = random.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bases = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers: dict[int, tuple] = {}

    def power(self, which: int, n: int):
        """Powers 0 .. n-1 of a base and of its inverse."""
        import numpy as np

        have = self.powers.get(which)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            base, inverse = self.bases[which], np.uint64(pow(int(self.bases[which]), -1, 1 << 64))
            up = np.full(size, base, np.uint64)
            down = np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            have = self.powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return have

    @staticmethod
    def mix(h):
        import numpy as np

        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))

    def runs(self, values, starts, ends, which: int):
        """Hash of values[start:end] for each pair."""
        import numpy as np

        up, down = self.power(which, len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return self.mix((sums[ends] - sums[starts]) * down[starts])

    def spelt(self, raw, starts, ends):
        """Hashes of runs of bytes that don't overlap: sums of a random number for each letter and place."""
        import numpy as np

        sizes = ends - starts
        cut = np.concatenate([[0], np.cumsum(sizes)])
        within = np.arange(cut[-1]) - np.repeat(cut[:-1], sizes)
        letters = self.letters[raw[within + np.repeat(starts, sizes)]]
        sums = np.zeros(cut[-1] + 1, np.uint64)
        np.cumsum(self.mix(letters + within.astype(np.uint64) * self.bases[0]), out=sums[1:])
        return self.mix(sums[cut[1:]] - sums[cut[:-1]])

    def words(self, data: bytes):
        """Hashes of the words of a text."""
        import numpy as np

        raw = np.frombuffer(data, np.uint8)
        there = np.concatenate([[False], ~self.space[raw], [False]])
        edge = np.flatnonzero(there[1:] != there[:-1])
        return self.spelt(raw, edge[::2], edge[1::2])

    def anchors(self, words):
        """Positions and hashes of the anchors of a text."""
        import numpy as np

        n = len(words) - ANCHOR + 1
        if len(words) < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = (np.arange(0, n + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
        at = at[at < n]
        return at, self.runs(words, at, at + ANCHOR, 1)


def windows(data: bytes, starts):
    """The digest of the words of the window at each start, in parts of 64 and 32 bits."""
    import numpy as np

    words = data.split()
    joined = b" ".join(words)
    begin = np.cumsum([0, *[len(w) + 1 for w in words]])
    digest = hashlib.blake2b
    cut = zip(begin[starts].tolist(), (begin[starts + WINDOW] - 1).tolist())
    made = np.frombuffer(b"".join([digest(joined[a:b], digest_size=12).digest() for a, b in cut]), np.dtype([("low", "<u8"), ("high", "<u4")]))
    return made["low"], made["high"]


def spots(hashes) -> list:
    """The four bits of each hash in the table."""
    import numpy as np

    top, middle, mask = np.uint64(64 - TABLE_BITS), np.uint64(64 - 2 * TABLE_BITS), np.uint64((1 << TABLE_BITS) - 1)
    other = Hasher.mix(hashes)
    return [(x >> by & mask).astype(np.uint32) for x in (hashes, other) for by in (top, middle)]


def candidates(words, hasher: Hasher, table):
    """Starts of the windows that hold an anchor whose bits are all set."""
    import numpy as np

    at, hashes = hasher.anchors(words)
    if not len(at):
        return at
    every = np.ones(len(at), bool)
    for spot in spots(hashes):
        every &= table[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 > 0
    hit = at[every]
    if not len(hit):
        return hit
    n = len(words) - WINDOW + 1
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.clip(hit - (PERIOD - 1), 0, n), 1)
    np.add.at(edge, np.clip(hit + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def in_buckets(low, n_buckets: int):
    """The bucket of each hash, in hash order."""
    import numpy as np

    return ((low >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)


def repeated_anchors(docs: DataFrame, n_buckets: int, n_partitions: int) -> bytes:
    """The bit table of anchor hashes that occur twice or more."""
    import numpy as np

    def collect(pieces):
        hasher = Hasher()
        held, size = [], 0

        def blobs():
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(in_buckets(hashes, n_buckets), np.arange(n_buckets + 1))
            rows = [(b, hashes[x:y].tobytes(), np.packbits(times[x:y] > 1).tobytes()) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            for i in range(0, len(rows), 64):
                part = list(zip(*rows[i : i + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())], ["bucket", "hashes", "twice"])

        for batch in pieces:
            for text in batch.column(0).to_pylist():
                if text:
                    held.append(hasher.anchors(hasher.words(text.encode("utf-8", "surrogatepass")))[1])
                    size += len(held[-1])
            if size > 1_000_000:
                yield from blobs()
                held, size = [], 0
        if size:
            yield from blobs()

    def decide(group):
        import pandas as pd

        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in group["hashes"]])
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(x) // 8) for x, t in zip(group["hashes"], group["twice"])])
        order = np.argsort(hashes, kind="stable")
        hashes, twice = hashes[order], twice[order] > 0
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        bits = np.unique(np.concatenate(spots(np.unique(hashes[same | twice]))))
        segment, first = np.unique(bits >> SEGMENT_BITS, return_index=True)
        return pd.DataFrame({"segment": segment.astype(np.int32), "bits": [x.tobytes() for x in np.split(bits, first[1:])] if len(bits) else []})

    def fill(group):
        import pandas as pd

        segment = np.zeros(1 << (SEGMENT_BITS - 3), np.uint8)
        for x in group["bits"]:
            bits = np.frombuffer(x, np.uint32) & ((1 << SEGMENT_BITS) - 1)
            np.bitwise_or.at(segment, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "bits": [segment.tobytes()]})

    found = python_rows(docs.select("text"), collect, "bucket int, hashes binary, twice binary").repartition(n_partitions, "bucket").groupBy("bucket").applyInPandas(decide, "segment int, bits binary")
    # as many rows as the table has segments, whatever the input
    table = bytearray(1 << (TABLE_BITS - 3))
    size = 1 << (SEGMENT_BITS - 3)
    for row in found.groupBy("segment").applyInPandas(fill, "segment int, bits binary").toLocalIterator():
        table[row["segment"] * size : (row["segment"] + 1) * size] = row["bits"]
    return bytes(table)


def read_texts(docs: DataFrame, table: bytes, n_buckets: int) -> DataFrame:
    """Texts without candidate windows as finished rows; the others as they are, and the hashes
    of their candidate windows by (batch, bucket)."""
    import numpy as np

    bits = docs.sparkSession.sparkContext.broadcast(table)
    schema = "kind string, batch string, nth int, doc_id long, text string, n_words long, bucket int, low binary, high binary, twice binary"
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in schema.split(", ")]

    def rows(made):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made), types)], names)

    def run(pieces):
        hasher, held, size, name, nth = Hasher(), [], 0, uuid.uuid4().hex, 0
        bitmap = np.frombuffer(bits.value, np.uint8)

        def blobs():
            low, high = (np.concatenate(x) for x in zip(*held))
            for b, keys, more, times, _ in grouped(low, high, n_buckets):
                yield ("keys", name, None, None, None, None, b, keys.tobytes(), more.tobytes(), np.packbits(times > 1).tobytes())

        for batch in pieces:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                words = hasher.words(data)
                starts = candidates(words, hasher, bitmap)
                if not len(starts):
                    out.append(("done", None, None, doc_id, text, len(words), None, None, None, None))
                    continue
                held.append(windows(data, starts))
                size += len(text)
                out.append(("text", name, nth, doc_id, text, len(words), None, None, None, None))
                nth += 1
            if out:
                yield rows(out)
            if size > BATCH_BYTES:
                made = list(blobs())
                for i in range(0, len(made), 64):
                    yield rows(made[i : i + 64])
                held, size, name, nth = [], 0, uuid.uuid4().hex, 0
        if held:
            made = list(blobs())
            for i in range(0, len(made), 64):
                yield rows(made[i : i + 64])

    return python_rows(docs.select("doc_id", "text"), run, schema)


def grouped(low, high, n_buckets: int):
    """Distinct hashes in order, cut by bucket: (bucket, low, high, times, place of each hash)."""
    import numpy as np

    order = np.lexsort((high, low))
    a, b = low[order], high[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(a)))
    keys, more = a[first], b[first]
    cut = np.searchsorted(in_buckets(keys, n_buckets), np.arange(n_buckets + 1))
    place = np.empty(len(low), np.int64)
    place[order] = np.cumsum(new) - 1
    for bucket, (x, y) in enumerate(zip(cut, cut[1:])):
        if y > x:
            yield bucket, keys[x:y], more[x:y], times[x:y], (place, x, y)


def repeats(keys: DataFrame, n_partitions: int) -> DataFrame:
    """(batch, bucket, repeated): for each hash of a blob, in its order, whether it occurs again."""

    def decide(group):
        import numpy as np
        import pandas as pd

        sizes = [len(x) // 8 for x in group["low"]]
        low = np.concatenate([np.frombuffer(x, np.uint64) for x in group["low"]])
        high = np.concatenate([np.frombuffer(x, np.uint32) for x in group["high"]])
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(group["twice"], sizes)]) > 0
        order = np.lexsort((high, low))
        same = (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cut = np.cumsum([0, *sizes])
        return pd.DataFrame({"batch": group["batch"], "bucket": group["bucket"], "repeated": [np.packbits(twice[a:b]).tobytes() for a, b in zip(cut, cut[1:])]})

    return keys.repartition(n_partitions, "bucket").groupBy("bucket").applyInPandas(decide, "batch string, bucket int, repeated binary")


def covered(words, starts, again):
    """Which words the repeated windows cover."""
    import numpy as np

    edge = np.zeros(len(words) + 1, np.int32)
    hit = starts[again]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words of repeated windows."""
    import numpy as np

    spark = docs.sparkSession
    n_bytes = text_bytes(docs)
    n_partitions = partitions_for(spark, 2 * n_bytes)
    n_buckets = n_buckets or max(2 * n_partitions, n_bytes // BUCKET_BYTES)
    table = repeated_anchors(docs, n_buckets, n_partitions)
    read = written(read_texts(docs, table, n_buckets), "passages")
    replies = repeats(read.where("kind = 'keys'").select("batch", "bucket", "low", "high", "twice"), n_partitions)
    texts = read.where("kind = 'text'").select("batch", "nth", "doc_id", "text", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("repeated"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("nth", "int"), ("doc_id", "long"), ("text", "string"))]
    bits = spark.sparkContext.broadcast(table)

    def apply(group: pa.Table) -> pa.Table:
        hasher, bitmap = Hasher(), np.frombuffer(bits.value, np.uint8)
        rows = group.to_pylist()
        own = sorted((r for r in rows if r["bucket"] is None), key=lambda r: r["nth"])
        found = {r["bucket"]: r["repeated"] for r in rows if r["bucket"] is not None}
        data = [r["text"].encode("utf-8", "surrogatepass") for r in own]
        words = [hasher.words(d) for d in data]
        starts = [candidates(w, hasher, bitmap) for w in words]
        hashes = [windows(d, s) for d, s in zip(data, starts)]
        flags, place = [], None
        for bucket, keys, _, _, (place, _, _) in grouped(np.concatenate([h[0] for h in hashes]), np.concatenate([h[1] for h in hashes]), n_buckets):
            flags.append(np.unpackbits(np.frombuffer(found[bucket], np.uint8), count=len(keys)))
        again = np.concatenate(flags)[place] > 0
        cut = np.cumsum([0, *map(len, starts)])
        gone = [covered(w, s, again[a:b]) for w, s, a, b in zip(words, starts, cut, cut[1:])]
        kept = [b" ".join([x for x, g in zip(d.split(), out.tolist()) if not g]).decode("utf-8", "surrogatepass") for d, out in zip(data, gone)]
        made = [pa.array([r["doc_id"] for r in own], pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(kept, pa.string())]
        return pa.Table.from_arrays(made, ["doc_id", "n_words", "n_removed", "kept"])

    changed = texts.unionByName(replies.select("batch", "bucket", "repeated", *nothing)).repartition(n_partitions, "batch").groupBy("batch").applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")
    plain = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    done = read.where("kind = 'done'").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), plain.alias("kept"))
    return done.unionByName(changed)


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(load(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i+34], ' ')) AS h FROM p),
r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM h WHERE h IN (FROM r)),
g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
    list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
