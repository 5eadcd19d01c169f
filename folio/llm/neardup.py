"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words, each labelled with the number of its occurrence.
For each of ``BANDS`` random orders the ``TOGETHER`` smallest k-mers are taken and put back in
text order; their hash is the band's key.  Keys agree if the texts share those k-mers in the
same order, which follows edit similarity, not only set overlap.  Each key's texts are compared
with two pivots of that key, its least and its greatest text, never pair by pair.  Bands are
taken in rounds: after the first, a text is compared only with pivots of other classes than its
own, so a large group of near copies costs a few comparisons a text.  A further round takes as
pivot the text of each key that meets most others in all its keys, which is the base of a group
whose copies are alike to it only.  Keys that still hold several classes are then searched
whole, so in the end two texts that share a key are in one class if they are alike: in a small
key every pair of texts of different classes is tried (``searched``); texts of larger keys are
joined on their rarest pairs of words (``rarely_shared``), one of which any two texts alike must
share, so a passage that many texts hold pairs none of them.  Few runs of five words of a short text outlive
its edits, so texts of up to ``SHORT`` words are joined that way whether they share a key or not.  A pair counts if the banded
alignment of all words costs at most a fifth of the longer text's words (similarity 0.8).
Classes are the connected components of the pairs that count.

The number of bands follows from the similarity: words of which a fifth is replaced at random
leave shingles of five a likeness of about 0.2, both least k-mers of a band are shared with
about its square, and one of 64 bands agrees with 0.92.

Exact copies are one text, with a number of its own, from the start, so how many they are costs
nothing later.  Keys, pairs and labels are numbers, joined by shuffles that adaptive execution
can split; texts move only to the alignment, and only those that share a key.

Cases: a null text counts as empty; texts without words form the class of their exact copies
only; texts of fewer than five words have one k-mer; ties between hashes go by position;
repeated rows are copies; texts of any length are aligned whole, in a band that widens until it
holds the distance; columns named as those of the working tables don't clash, since only id and
text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import discard, load, partitions_for, python_rows, release, text_bytes, written
from folio.llm.substrings import Hasher

SHINGLE, TOGETHER, BANDS, SIMILARITY_PERCENT = 5, 2, 64, 80
#: Bands of each round: the first few join most copies, the others ask only across classes.
ROUNDS = ((0, 3), (3, BANDS))
#: Texts, and bytes of them, up to which a key is searched pair by pair.
SMALL_TEXTS, SMALL_BYTES = 64, 8 << 20
#: Texts up to which a pair of words counts as rare; beyond, single words decide.
RARE = 64
#: Words up to which texts are paired by exact join: longer ones leave runs of five words enough to agree.
SHORT = 40
#: Tokens that a pair must share to be aligned, among the rarest of both, if it has so many in common at all.
SHARED = 8
#: Tokens of a text that travel with each of its rows, to pair two texts once: of those that other classes hold too.
HEAD = 256
#: Spots of the table that tells what tokens cost (16 MB, whatever the input), and where the
#: bits of a token's two spots begin.
TABLE_BITS, SPOTS, SEGMENT_BITS = 24, (0, 30), 16
#: Counters of a text's words, whose differences are a lower bound of the edits.
COUNTERS = 256
#: k-mers drawn at once, over all bands; diagonals of the first alignment.
DRAWN_AT_ONCE, FIRST_BAND = 1 << 18, 64


class OrderMinHash:
    def __init__(self):
        import numpy as np

        self.hasher = Hasher()
        self.seeds = np.random.Generator(np.random.PCG64(10)).integers(1, 1 << 63, size=BANDS, dtype=np.uint64)

    def labelled(self, grams):
        """Each k-mer with the number of its occurrence, in text order."""
        import numpy as np

        order = np.argsort(grams, kind="stable")
        run = np.ones(len(grams), bool)
        run[1:] = grams[order][1:] != grams[order][:-1]
        first = np.flatnonzero(run)
        if len(first) == len(grams):
            return grams
        nth = np.empty(len(grams), np.uint64)
        nth[order] = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
        return grams + nth * np.uint64(0x9E3779B97F4A7C15)

    def runs(self, text: str | None, size: int):
        """The number of words of a text, and its runs of ``size`` words (or of all, if fewer)."""
        import numpy as np

        words = self.hasher.words((text or "").encode("utf-8", "surrogatepass"))
        at = np.arange(max(len(words) - size + 1, min(len(words), 1)))
        return len(words), self.labelled(self.hasher.runs(words, at, np.minimum(at + size, len(words)), 1))

    def least(self, labelled, seeds):
        """For each seed the places of the ``TOGETHER`` least k-mers, in text order."""
        import numpy as np

        drawn = labelled ^ seeds[:, None]
        shifted = drawn >> np.uint64(31)
        for by, factor in ((27, 0x7FB5D329728EA185), (0, 0x81DADEF4BC2DD44D)):
            drawn ^= shifted
            drawn *= np.uint64(factor)
            if by:
                np.right_shift(drawn, np.uint64(by), out=shifted)
        places = []
        for _ in range(min(TOGETHER, len(labelled))):
            places.append(drawn.argmin(1))
            drawn[np.arange(len(seeds)), places[-1]] = np.iinfo(np.uint64).max
        return np.sort(np.stack(places), axis=0)

    def keys(self, data: bytes):
        """One key for each band, and the number of words."""
        import numpy as np

        words = self.hasher.words(data)
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64), 0
        k = min(SHINGLE, n)
        at = np.arange(n - k + 1)
        grams = self.hasher.runs(words, at, at + k, 1)
        labelled = self.labelled(grams)
        step = max(1, DRAWN_AT_ONCE // len(grams))
        chosen = np.concatenate([self.least(labelled, self.seeds[i : i + step]) for i in range(0, BANDS, step)], axis=1)
        keys = self.seeds.copy()
        for places in chosen:
            keys = self.hasher.mix((keys ^ grams[places]) * np.uint64(0xC2B2AE3D27D4EB4F))
        return keys, n


def distance(a: list, b: list, most: int) -> int:
    """Edit distance of two lists in a band of ``most`` diagonals to each side, or more than
    ``most`` if they are further apart.  A column of the band is one integer of 2 * most + 1 bits."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return n + m
    most = min(most, max(n, m))
    found: dict = {}
    for i, x in enumerate(a):
        found[x] = found.get(x, 0) | 1 << i
    width = 2 * most + 1
    full = (1 << width) - 1
    up, down = full & ~((1 << most) - 1), 0
    at, bottom = min(most, n), 1 << width - 1
    for j, x in enumerate(b, 1):
        match = found.get(x, 0)
        shift = j - most - 1
        match = (match >> shift if shift >= 0 else match << -shift) & full
        diagonal = ((match & up) + up ^ up | match | down) & full
        right, left = (down | full & ~(diagonal | up)), diagonal & up
        if j + most <= n:
            at += not diagonal & bottom
        else:
            bit = n - j + most
            if bit >= 0:
                at += (right >> bit & 1) - (left >> bit & 1)
        diagonal >>= 1
        up, down = (left | full & ~(diagonal | right)), diagonal & right
    return at


def alike(a: str, b: str) -> bool:
    return close(a.encode("utf-8", "surrogatepass").split(), b.encode("utf-8", "surrogatepass").split())


def close(x: list, y: list) -> bool:
    longer = max(len(x), len(y))
    most = longer * (100 - SIMILARITY_PERCENT) // 100
    if abs(len(x) - len(y)) > most:
        return False
    # words of one that the other lacks cost an edit each
    left: dict = {}
    for w in x:
        left[w] = left.get(w, 0) + 1
    common = 0
    for w in y:
        if left.get(w, 0):
            left[w] -= 1
            common += 1
    if longer - common > most:
        return False
    band = FIRST_BAND
    while band < most:  # a band that holds the distance is enough, and costs less
        if distance(x, y, band) <= band:
            return True
        band *= 4
    return distance(x, y, most) <= most


def digest(text: str) -> Column:
    """What tells a text: half of its SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 16)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, digest, n, keys): the digest of each text, its number of words and its band keys."""

    def run(pieces):
        import numpy as np

        made = OrderMinHash()
        for batch in pieces:
            found = [made.keys((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            keys = [k.view(np.int64) for k, _ in found]
            cut = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(cut, pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for _, n in found], pa.int64()), lists], ["doc_id", "digest", "n", "keys"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(text).alias("text"))
    return python_rows(rows, run, "doc_id long, digest binary, n long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts that the alignment accepts."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(pieces):
        for batch in pieces:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            ok = [alike(s, t) for s, t in zip(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, o in zip(c, ok) if o], pa.int64()) for c in (a, b)], ["a", "b"])

    return python_rows(both.select("a", "b", "text_a", "text_b"), run, "a long, b long", text=("text_a", "text_b"))


def tried(key: int, nodes: list, labels: list, texts: list, own: list) -> list:
    """The pairs that link the texts of one small key; a pair is tried only while its classes are apart, and at the
    least key that both texts have in ``own``."""
    import numpy as np

    known, words = {}, []
    for t in texts:
        words.append([known.setdefault(w, len(known)) for w in t.encode("utf-8", "surrogatepass").split()])
    n = np.array([len(w) for w in words])
    counts = np.array([np.bincount(np.array(w, np.int64) % COUNTERS, minlength=COUNTERS) for w in words], np.int32)
    roots = np.unique(np.array(labels, np.int64), return_inverse=True)[1]
    keys, found = [set(k) for k in own], []
    for i in range(len(nodes)):
        others = np.arange(i + 1, len(nodes))
        others = others[roots[others] != roots[i]]
        longer = np.maximum(n[others], n[i])
        most = longer * (100 - SIMILARITY_PERCENT) // 100
        apart = np.abs(counts[others] - counts[i]).sum(1)
        for j in others[(np.abs(n[others] - n[i]) <= most) & (2 * longer - n[others] - n[i] + apart <= 2 * most)].tolist():
            if roots[i] != roots[j] and min(keys[i] & keys[j]) == key and close(words[i], words[j]):
                found.append((nodes[i], nodes[j]))
                roots[roots == roots[j]] = roots[i]
    return found


def with_texts(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``rest`` (key, node, label) with what ``texts`` has of each node, which is joined once
    with all its keys (``BANDS`` at most)."""
    own = rest.groupBy("node", "label").agg(F.collect_list("key").alias("own"))
    return own.join(texts, "node").withColumn("key", F.explode("own"))


def searched(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link classes within the small keys of ``rest`` (key, node, label)."""
    rows = with_texts(rest, texts).repartition("key").sortWithinPartitions("key")

    def run(pieces):
        at, held = None, []

        def done():
            found = tried(at, *(list(c) for c in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in pieces:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    if len(held) > 1:
                        yield done()
                    at, held = key, []
                held.append(row)
        if len(held) > 1:
            yield done()

    return python_rows(rows.select("key", "node", "label", F.coalesce("text", F.lit("")).alias("text"), "own"), run, "a long, b long")


def levels(texts: DataFrame, size: int) -> bytes:
    """A table of fixed size: how much work the runs of ``size`` words of texts (node, label, text) make
    that fall on each of its spots, 0 for none.  A run's work is its texts times those outside of its main
    class, in quarters of a power of two; it falls on two spots, and a spot holds the most of its runs.
    Runs that a text holds again are told apart.  Tasks count runs by class before they send
    them, as arrays for buckets of runs, and buckets send the spots they fill."""
    import numpy as np

    spark = texts.sparkSession
    n_buckets = partitions_for(spark, 4 * text_bytes(texts), 32 << 20)

    def counted(token, label, n):
        """Each (token, label) once, in order, with its texts."""
        order = np.lexsort((label, token))
        token, label, n = token[order], label[order], n[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (label[1:] != label[:-1])
        start = np.flatnonzero(first)
        return token[start], label[start], np.add.reduceat(n, start) if len(start) else n

    def collect(pieces):
        made, held, size_held = OrderMinHash(), [], 0

        def blobs():
            token, label, n = counted(*(np.concatenate(c) for c in zip(*held)))
            bucket = ((token >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
            rows = [(b, token[x:y].tobytes(), label[x:y].tobytes(), n[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "tokens", "labels", "n"])

        for batch in pieces:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = made.runs(text, size)[1]
                held.append((runs, np.full(len(runs), label, np.int64), np.ones(len(runs), np.int64)))
                size_held += len(runs)
            if size_held > 1 << 20:
                yield from blobs()
                held, size_held = [], 0
        if size_held:
            yield from blobs()

    def decide(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
        token, _, n = counted(read("tokens", np.uint64), read("labels", np.int64), read("n", np.int64))
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        texts_of, main = np.add.reduceat(n, start), np.maximum.reduceat(n, start)
        met = texts_of > main
        token, texts_of, main = token[start][met], texts_of[met], main[met]
        level = np.minimum(255, np.ceil(4 * np.log2(texts_of.astype(float) * (texts_of - main)))).astype(np.uint8)
        spot = np.concatenate([(token >> np.uint64(64 - TABLE_BITS - shift)) & np.uint64((1 << TABLE_BITS) - 1) for shift in SPOTS]).astype(np.int64)
        level = np.tile(level, len(SPOTS))
        order = np.lexsort((level, spot))
        spot, level = spot[order], level[order]
        last = np.flatnonzero(np.concatenate([spot[1:] != spot[:-1], [True]])) if len(spot) else spot
        spot, level = spot[last], level[last]
        segment, first = np.unique(spot >> SEGMENT_BITS, return_index=True)
        part = lambda a: [x.tobytes() for x in np.split(a, first[1:])] if len(a) else []
        return pa.table({"segment": pa.array(segment, pa.int32()), "spots": pa.array(part((spot & ((1 << SEGMENT_BITS) - 1)).astype(np.uint32)), pa.binary()), "levels": pa.array(part(level), pa.binary())})

    def fill(table: pa.Table) -> pa.Table:
        made = np.zeros(1 << SEGMENT_BITS, np.uint8)
        for spot, level in zip(table["spots"].to_pylist(), table["levels"].to_pylist()):
            spot = np.frombuffer(spot, np.uint32)
            made[spot] = np.maximum(made[spot], np.frombuffer(level, np.uint8))
        return pa.table({"segment": table["segment"].slice(0, 1), "levels": pa.array([zlib.compress(made.tobytes(), 1)], pa.binary())})

    sent = python_rows(texts.select("label", "text"), collect, "bucket int, tokens binary, labels binary, n binary")
    spots = sent.groupBy("bucket").applyInArrow(decide, "segment int, spots binary, levels binary")
    table = bytearray(1 << TABLE_BITS)
    # a row for each segment at most, whatever the input, in one job
    for r in spots.groupBy("segment").applyInArrow(fill, "segment int, levels binary").collect():
        table[r["segment"] << SEGMENT_BITS : (r["segment"] + 1) << SEGMENT_BITS] = zlib.decompress(r["levels"])
    release(spark)
    return bytes(table)


def prefixes(texts: DataFrame, size: int, name: str = "prefixes") -> DataFrame:
    """(node, label, n, n_tokens, tokens): for each text (node, label, text) the tokens that
    may pair it with a text of another class, and their number.

    Texts of n words or more that are alike have all but ``size`` * n / 5 runs of ``size`` words
    in common, so in any one order of all tokens they share ``SHARED`` of the first
    ``size`` * n / 5 + ``SHARED`` of each.  The order is by the work that ``levels`` tells of a
    token, then by its hash; what one class alone holds comes first and pairs nothing.  Runs that
    fall on the same spots only come later in the order, alike in all texts.  They are written, so the
    table of ``levels`` leaves the driver and the executors at once."""
    shared = texts.sparkSession.sparkContext.broadcast(levels(texts, size))

    def run(pieces):
        import numpy as np

        made, table = OrderMinHash(), np.frombuffer(shared.value, np.uint8)
        mask = np.uint64((1 << TABLE_BITS) - 1)
        for batch in pieces:
            out = []
            for node, label, t in zip(*(c.to_pylist() for c in batch.columns)):
                n, runs = made.runs(t, size)
                level = np.minimum(*[table[(runs >> np.uint64(64 - TABLE_BITS - shift)) & mask] for shift in SPOTS])
                met = level > 0
                most = n * size * (100 - SIMILARITY_PERCENT) // 100 + SHARED - np.count_nonzero(~met)
                runs, level = runs[met], level[met]
                first = runs[np.lexsort((runs, level))[: max(most, 0)]].view(np.int64)
                if len(first):
                    out.append((node, label, n, len(first), first))
            if out:
                columns = [pa.array(c, pa.list_(pa.int64()) if i == 4 else pa.int64()) for i, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "label", "n", "n_tokens", "tokens"])

    made = written(python_rows(texts.select("node", "label", "text"), run, "node long, label long, n long, n_tokens long, tokens array<long>"), name)
    shared.destroy()
    return made


def dealt(n_buckets: int, by, *columns):
    """Arrays of numbers as rows (bucket, c0, c1, ...): the bucket of ``by``, and what falls in it of each array."""
    import numpy as np

    spread = by.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    bucket = (spread * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    filled, first = np.unique(bucket[order], return_index=True)
    parts = [[x.tobytes() for x in np.split(c[order], first[1:])] if len(filled) else [] for c in (by, *columns)]
    for i in range(0, len(filled), 64):
        yield pa.RecordBatch.from_arrays([pa.array(filled[i : i + 64]), *(pa.array(x[i : i + 64], pa.binary()) for x in parts)], ["bucket", *(f"c{k}" for k in range(len(parts)))])


def gathered(table: pa.Table) -> list:
    """The arrays of ``dealt`` that fell in one bucket."""
    import numpy as np

    return [np.concatenate([np.frombuffer(x, np.int64) for x in table[name].to_pylist()]) for name in table.column_names[1:]]


def shared_tokens(firsts: DataFrame) -> DataFrame:
    """(node, found array<struct<token, main, held>>): the first tokens of a text that several classes hold,
    with the class most of their texts are of and the number of texts.  Tokens travel in arrays: to
    buckets of tokens, which tell them, and from there to buckets of nodes."""
    import numpy as np

    n_tokens = firsts.agg(F.sum("n_tokens")).first()[0] or 0
    n_buckets = partitions_for(firsts.sparkSession, 4 * 8 * n_tokens)

    def send(batches):
        held, n_held = [], 0
        for batch in batches:
            node, label, tokens = batch.columns
            each = tokens.value_lengths().to_numpy()
            held.append((tokens.flatten().to_numpy(), np.repeat(node.to_numpy(), each), np.repeat(label.to_numpy(), each)))
            n_held += len(held[-1][0])
            if n_held > 1 << 20:
                yield from dealt(n_buckets, *map(np.concatenate, zip(*held)))
                held, n_held = [], 0
        if n_held:
            yield from dealt(n_buckets, *map(np.concatenate, zip(*held)))

    def tell(table: pa.Table) -> pa.Table:
        token, node, label = gathered(table.select(["bucket", "c0", "c1", "c2"]))
        order = np.lexsort((label, token))
        token, node, label = token[order], node[order], label[order]
        new = np.concatenate([[True], token[1:] != token[:-1]])
        own = np.flatnonzero(new | np.concatenate([[True], label[1:] != label[:-1]]))  # a token's texts of one class
        n_own = np.diff(np.append(own, len(token)))
        nth = np.cumsum(new) - 1
        largest = np.lexsort((n_own, nth[own]))
        last = np.append(np.flatnonzero(np.diff(nth[own])), len(own) - 1)  # of each token's, the largest comes last
        main, held = label[own[largest[last]]], np.bincount(nth)
        met = np.bincount(nth[own])[nth] > 1
        rows = list(dealt(n_buckets, node[met], token[met], main[nth][met], held[nth][met]))
        return pa.Table.from_batches(rows, pa.schema([("bucket", pa.int32()), *((f"c{k}", pa.binary()) for k in range(4))]))

    def gather(table: pa.Table) -> pa.Table:
        node, token, main, held = gathered(table.select(["bucket", "c0", "c1", "c2", "c3"]))
        order = np.lexsort((token, node))
        node = node[order]
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        found = pa.StructArray.from_arrays([pa.array(c[order]) for c in (token, main, held)], ["token", "main", "held"])
        return pa.table({"node": node[first], "found": pa.ListArray.from_arrays(pa.array(np.append(first, len(node)), pa.int32()), found)})

    sent = firsts.select("node", "label", "tokens").mapInArrow(send, "bucket int, c0 binary, c1 binary, c2 binary")
    told = sent.groupBy("bucket").applyInArrow(tell, "bucket int, c0 binary, c1 binary, c2 binary, c3 binary")
    return told.groupBy("bucket").applyInArrow(gather, "node long, found array<struct<token:long,main:long,held:long>>")


def holding(firsts: DataFrame, met: DataFrame) -> DataFrame:
    """The rows (node, label, n, n_tokens, head, token, main) of the tokens that ``met`` has of each text, which is
    joined once, with their number and the least ``HEAD`` of them."""
    own = met.where(F.size("found") > 0).join(firsts.select("node", "label", "n"), "node")
    head = F.slice("found.token", 1, HEAD).alias("head")  # in order
    rows = own.select("node", "label", "n", F.size("found").cast("long").alias("n_tokens"), head, F.explode("found").alias("t"))
    return rows.select("node", "label", "n", "n_tokens", "head", "t.token", "t.main")


def paired(rows: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of texts of different classes and of fitting lengths that share enough
    tokens.  Texts of a token's main class meet only those of other classes, and a pair is made at
    the least token of both heads, or at tokens outside of them."""

    def side(name: str, kept: DataFrame) -> DataFrame:
        columns = ("label", "n", "n_tokens", "head")
        return kept.select("token", F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns], *(["main"] if name == "b" else []))

    both = F.array_intersect("head_a", "head_b")
    longer = F.greatest("n_a", "n_b")
    common = longer - (size - 1) - size * F.floor(longer * (100 - SIMILARITY_PERCENT) / 100)
    asked = F.least(F.lit(SHARED), F.greatest(common, F.lit(1)))
    in_heads = F.array_contains("head_a", F.col("token")) & F.array_contains("head_b", F.col("token"))
    told = (F.greatest("n_tokens_a", "n_tokens_b") > HEAD) | (F.size(both) >= asked)
    once = F.when(in_heads, told & (F.get(both, F.lit(0)) == F.col("token"))).otherwise(True)
    fits = longer * SIMILARITY_PERCENT <= F.least("n_a", "n_b") * 100
    other = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("main")) | (F.col("a") < F.col("b")))
    met = side("a", rows.where("label <> main")).join(side("b", rows), "token").where(F.when(other & fits, once).otherwise(False))
    shared = F.when(in_heads, F.size(both)).otherwise(1).alias("shared")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), asked.alias("asked"), shared)
    return met.groupBy("a", "b", "asked").agg(F.sum("shared").alias("shared")).where("shared >= asked").select("a", "b")


def rarely_shared(texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link the texts (node, label, text), every pair alike among them.

    They share a rare pair of words; where it is a pair that many texts hold, as of texts that
    are a common passage for the most part, they share a rare word of those texts."""
    firsts = prefixes(texts, 2, "first-pairs")
    met = written(shared_tokens(firsts), "met-pairs")
    # texts alike share rare pairs enough, or one that is not rare: both are common then
    rows = written(holding(firsts, met.withColumn("found", F.filter("found", lambda t: t["held"] <= RARE))), "rare-pairs")
    common = met.where(F.exists("found", lambda t: t["held"] > RARE)).select("node")
    common = written(texts.join(common, "node", "left_semi"), "common-texts")
    discard(firsts, met)
    words = prefixes(common, 1, "first-words")
    rare = written(holding(words, shared_tokens(words)), "rare-words")
    found = written(paired(rows, 2).union(paired(rare, 1)).distinct(), "pairs")
    discard(rows, common, words, rare)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node with the least node of its connected component."""
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        least = heard.union(labels.select("node", "label", F.col("label").alias("was"))).groupBy("node").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = least.join(far, "label").select("node", F.least("label", "far").alias("label"), "was")
        new = written(new, "labels")
        same = new.where("label <> was").isEmpty()
        discard(labels)
        labels = new.select("node", "label")
        if same:
            discard(both)
            release(labels.sparkSession)
            return labels


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, class_id, class_digest, class_size, n_links): each row with the digest of
    its text, the least id of its class (and that row's digest), the rows of the class, and the
    other texts that the alignment accepted as links of this row's text.  The links found are
    enough to hold each class together; pairs inside a class are not all aligned."""
    sketched = written(sketches(docs, key, text), "sketches")
    # numbers are given once, in the order of the digests: whatever the partitions, the same texts are least
    numbered = sketched.groupBy("digest").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).repartitionByRange("digest").sortWithinPartitions("digest")
    numbered = written(numbered.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = numbered.select("node", F.posexplode("keys").alias("band", "key"))
    ends = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = written(members.join(written(ends, "pivots"), "key"), "members")
    # under five words an edit is more than a fifth
    short = numbered.where(F.col("n").between(5, SHORT)).select("node")
    nodes = numbered.join(members.select("node").union(short).distinct(), "node", "left_semi").select("digest", "node")
    texts = docs.select(digest(text).alias("digest"), F.col(text).alias("text")).join(nodes, "digest")
    texts = written(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")

    edges = labels = None
    for low, high in ROUNDS:
        rows = members.where(F.col("band").between(low, high - 1))
        if labels is not None:
            rows = apart(rows, labels)
        pairs = rows.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        if labels is not None:
            own = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b")]
            pairs = pairs.join(own[0], "a", "left").join(own[1], "b", "left")
            pairs = pairs.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
        found = written(verified(pairs, texts), "accepted")
        edges = found if edges is None else edges.union(found)
        labels = components(edges)

    labelled = texts.join(short, "node", "left_semi").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "text")
    labelled = written(labelled, "short-texts")
    if not labelled.isEmpty():
        found = written(verified(rarely_shared(labelled), texts), "accepted")
        if not found.isEmpty():
            edges = edges.union(found)
            labels = components(edges)
    rest = mixed(members, labels)
    if not rest.isEmpty():  # the text of each key that meets most others
        meets = rest.join(rest.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("met", F.sum("n").over(Window.partitionBy("node")))  # a text has BANDS keys at most
        hubs = meets.groupBy("key").agg(F.max(F.struct("met", "node", "label")).alias("hub"))
        pairs = rest.join(hubs, "key").where("label <> hub.label").select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        edges = edges.union(written(verified(pairs, texts), "accepted"))
        labels = components(edges)
        rest = mixed(rest, labels)
    if not rest.isEmpty():
        sized = with_texts(rest, texts.select("node", F.octet_length("text").cast("long").alias("bytes")))
        large = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where((F.col("n") > SMALL_TEXTS) | (F.col("bytes") > SMALL_BYTES))
        large = written(large.select("key"), "large-keys")
        members = rest.join(large, "key", "left_semi").select("node", "label").distinct()
        pairs = rarely_shared(written(members.join(texts, "node"), "large-texts"))
        edges = edges.union(written(searched(rest.join(large, "key", "left_anti"), texts), "accepted")).union(written(verified(pairs, texts), "accepted"))
        labels = components(edges)
    links = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = numbered.select("digest", "node").join(labels, "node", "left").join(links, "node", "left")
    known = known.select("digest", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    told = written(sketched.select("doc_id", "digest").join(known, "digest"), "told")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("head")
    heads = written(told.groupBy("label").agg(first, F.count("*").alias("class_size")), "classes")
    return told.join(heads, "label").select("doc_id", "digest", F.col("head.doc_id").alias("class_id"), F.col("head.digest").alias("class_digest"), "class_size", "n_links")


def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label): the members of the keys that hold several classes."""
    rows = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    return written(rows.join(several, "key").select("key", "node", "label"), "mixed")


def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members whose class is neither of their key's pivots' classes."""
    own, low, high = (labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("node", "low", "high"))
    rows = members.join(own, "node", "left").join(low, "low", "left").join(high, "high", "left")
    mine, first, last = (F.coalesce(f"{c}_label", c) for c in ("node", "low", "high"))
    return rows.where((mine != first) | (mine != last)).select(
        "key", "node", "low", "high"
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class: the least id, and one of repeated rows."""
    found = classes(docs, key=key, text=text)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest")))
    no_id = F.lit(-(1 << 63))
    kept = kept.select(F.col("digest").alias("kept_digest"), F.coalesce("doc_id", no_id).alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), digest(text).alias("kept_digest"), F.coalesce(F.col(key).cast("long"), no_id).alias("kept_id"))
    one = Window.partitionBy("kept_digest", "kept_id").orderBy("kept_digest")
    return rows.join(kept, ["kept_digest", "kept_id"]).withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(load(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "class_size", "n_links")
