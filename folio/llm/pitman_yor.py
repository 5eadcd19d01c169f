"""A hierarchical Pitman-Yor language model of word pairs, sampled and applied by Spark.

Every word that goes before another has a restaurant of the words after it; all of them share one
parent, the restaurant of single words, whose own parent is even over the known words and one more
for all unknown ones.  A token is a customer of its dish in its context's restaurant, every table
there sends one customer to the parent.  Gibbs sweeps draw the number of tables of a dish given all
other seats, by its exact conditional (generalised Stirling numbers): contexts given the parent,
then the parent given the tables of the contexts.  Discounts come from the counts of counts.
After ``BURN_IN`` sweeps, the predictive probabilities of ``SAMPLES`` sweeps are averaged.

A dish's customers sit in rooms of at most ``ROOM`` and no table spans two rooms, so the draw for a
dish costs as much at any count (full rooms are drawn together).  A draw uses the tables of its
context and the parent as the sweep before left them, so all dishes are drawn at once.

How it runs: texts are read once into blocks of word numbers.  Everything sent is an array for a
block, a bucket of contexts or a bucket of words, so tasks work on arrays and rows are few.
Buckets follow the bytes.  A context with more than a bucket's share of tokens is spread over all
buckets by the next word, and only its number of tables is summed up.  Words are counted by 64 bits
of BLAKE2b, pairs by 48 of them for each word.  Scores have a resolution of 2^-20 a token; base scores are whole doubles.

Cases: a null text is an empty one: its end is still a token; a null id is in no fold and trains;
equal ids and repeated rows are scored (and learned) one by one; a very long text is cut into pieces
of bounded size between words; unknown words have one probability, together that of their class;
without training texts every score is 0; only the columns named are read, whatever the others
are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import discard, load, python_rows, release, text_bytes, written

#: Sweeps dropped and sweeps averaged, strength of every restaurant, customers of a room.
BURN_IN, SAMPLES, STRENGTH, ROOM = 2, 3, 1.0, 256
#: Tokens of a block, bytes of a piece of a text, bytes of text for a bucket, cells of a table at once.
BLOCK_TOKENS, PIECE, BUCKET_BYTES, CELLS = 1 << 20, 4 << 20, 24 << 20, 1 << 20
#: No word holds a space: these two stand for the start and the end of a text.
START, END = b" <", b" >"
#: Resolution of the scores sent back.
SCALE = 1 << 20
ROW = "kind string, to long, frm long, x long, y long, data binary"


def pack(*arrays) -> bytes:
    """Arrays of numbers, small: least width, byte planes, compressed."""
    import numpy as np
    import zstandard

    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and a.size and a.min() >= 0:
            a = a.astype(np.min_scalar_type(a.max()))
        parts.append((a.dtype.str, a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts))


def unpack(data: bytes) -> list:
    import numpy as np
    import zstandard

    parts = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return [np.frombuffer(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind) for kind, planes in parts]


def steps(hashes):
    """Sorted hashes as differences, which take fewer bytes."""
    import numpy as np

    return np.diff(hashes, prepend=np.zeros(1, np.uint64))


def summed(differences):
    import numpy as np

    return np.cumsum(differences.astype(np.uint64), dtype=np.uint64)


def told(words) -> list:
    import numpy as np

    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(w, digest_size=8).digest() for w in words]), np.uint64)


def short(hashes):
    """The first 48 bits of hashes, by which pairs tell words; the counts of words use all 64."""
    import numpy as np

    return hashes >> np.uint64(16)


def bucket_of(hashes, n_buckets: int):
    """The bucket of each hash of 48 bits, in hash order."""
    import numpy as np

    return ((hashes >> np.uint64(24)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)


def batch(rows) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "to", "frm", "x", "y", "data"])


def exchange(rows: DataFrame, work) -> DataFrame:
    """``work(to, kinds)`` for all rows of each address: ``kinds`` has (frm, x, y, data) by kind, in order of frm."""

    def run(table: pa.Table) -> pa.Table:
        kinds: dict = {}
        for kind, frm, x, y, data in sorted(zip(*(table[c].to_pylist() for c in ("kind", "frm", "x", "y", "data"))), key=lambda r: r[:2]):
            kinds.setdefault(kind, []).append((frm, x, y, data))
        return pa.Table.from_batches([batch(list(work(table["to"][0].as_py(), kinds)))])

    return rows.groupBy("to").applyInArrow(run, ROW)


class Numbers(dict):
    """Numbers of words, given as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pieces_of(text: str, most: int = PIECE):
    """A text's words in lists of bounded size, lower case where ASCII."""
    data = text.encode("utf-8", "surrogatepass").lower()
    start = 0
    while len(data) - start > most:
        end = start + most
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end].split()
        start = end
    yield data[start:].split()


class Block:
    """Tokens of some texts: words sorted by hash, pairs sorted by bucket, context and word."""

    def __init__(self, words, tokens, before, sizes):
        self.words, self.tokens, self.before, self.sizes = words, tokens, before, sizes

    def contexts(self):
        """The number of the word before each token."""
        import numpy as np

        found = np.empty(len(self.tokens), np.int64)
        found[1:] = self.tokens[:-1]
        found[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])] = self.before
        return found

    def pairs(self, n_buckets: int, hot):
        """(context, word, bucket) of each pair, and the pair of each token."""
        import numpy as np

        codes, pair = np.unique(self.contexts() << 32 | self.tokens.astype(np.int64), return_inverse=True)
        context, word = codes >> 32, codes & 0xFFFFFFFF
        keys = short(self.words)
        route = keys[context]
        spread = np.isin(keys, hot)[context]
        route[spread] = short((route[spread] ^ keys[word[spread]]) * np.uint64(0x9E3779B97F4A7C15))
        bucket = bucket_of(route, n_buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return context[order], word[order], bucket[order], rank[pair]


def read_blocks(docs: DataFrame, n_buckets: int, block_tokens: int = BLOCK_TOKENS, piece_bytes: int = PIECE) -> DataFrame:
    """``docs`` (id, trains, text) as blocks: kind doc for each block, kind word for each of its word buckets."""
    import numpy as np

    def run(batches):
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        made = rid = first
        numbers, tokens, before, sizes, meta = Numbers(), [], [], [], []

        def fresh():
            numbers.clear()
            numbers[START], numbers[END] = 0, 1
            for held in (tokens, before, sizes, meta):
                held.clear()

        def flushed():
            words = told(numbers)
            order = np.argsort(words)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words, every = words[order], rank[np.concatenate(tokens)]
            trains = np.array([m[2] for m in meta])
            count = np.bincount(every[np.repeat(trains, sizes)], minlength=len(words))
            starts = np.array([m[3] for m in meta])
            count[rank[0]] += int((trains & starts).sum())
            ids = np.array([m[1] or 0 for m in meta], np.int64)
            data = pack(steps(words), every, rank[np.array(before)], np.array(sizes), np.array([m[0] - first for m in meta]), ids.view(np.uint64), np.array([m[1] is not None for m in meta]), trains)
            yield "doc", made, first, int(count.sum()), None, data
            cut = np.searchsorted(bucket_of(short(words), n_buckets), np.arange(n_buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[b], cut[b + 1])
                yield "word", b, made, None, None, pack(steps(words[part]), count[part])

        def batches_of(rows):
            held, size = [], 0
            for r in rows:
                held.append(r)
                size += len(r[5])
                if size > 4 << 20 or len(held) >= 4096:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

        fresh()
        size = 0
        for piece in batches:
            for key, trains, text in zip(*(c.to_pylist() for c in piece.columns)):
                last, at_start = START, True
                lists = pieces_of(text, piece_bytes)
                words = next(lists)
                while words is not None:
                    more = next(lists, None)
                    if more is None:
                        words.append(END)
                    if words:
                        before.append(numbers[last])
                        tokens.append(np.array(list(map(numbers.__getitem__, words)), np.int64))
                        sizes.append(len(words))
                        meta.append((rid, key, trains, at_start))
                        size += len(words)
                        last, at_start = words[-1], False
                        if size >= block_tokens:
                            yield from batches_of(flushed())
                            fresh()
                            made, size = made + 1, 0
                    words = more
                rid += 1
        if size:
            yield from batches_of(flushed())

    return python_rows(docs, run, ROW)


def block_of(data: bytes):
    """A block, and its texts: number in the task, id, whether there is an id, whether it trains."""
    words, tokens, before, sizes, rid, ids, there, trains = unpack(data)
    import numpy as np

    return Block(summed(words), tokens, before.astype(np.int64), sizes.astype(np.int64)), rid.astype(np.int64), ids.astype(np.uint64).view(np.int64), there, trains


def requests(blocks: DataFrame, n_buckets: int, hot) -> DataFrame:
    """The pairs of each block for each bucket of contexts, with how often they train."""
    import numpy as np

    def run(batches):
        for piece in batches:
            for to, data in zip(piece.column(1).to_pylist(), piece.column(5).to_pylist()):
                block, _, _, _, trains = block_of(data)
                context, word, bucket, pair = block.pairs(n_buckets, hot)
                keys = short(block.words)
                count = np.bincount(pair[np.repeat(trains, block.sizes)], minlength=len(context))
                cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
                rows, size = [], 0
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    part = slice(cut[b], cut[b + 1])
                    c, runs = np.unique(context[part], return_counts=True)
                    w, place = np.unique(word[part], return_inverse=True)
                    rows.append(("pair", b, to, None, None, pack(steps(keys[c]), runs, steps(keys[w]), place, count[part])))
                    size += len(rows[-1][5])
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return blocks.where("kind = 'doc'").mapInArrow(run, ROW)


class Bucket:
    """All pairs asked of a bucket: contexts and words in hash order, each pair's count, and which pair every message's are."""

    def __init__(self, messages: list, hot, hot_counts):
        import numpy as np

        parts = [unpack(m[3]) for m in messages]
        heads, words = [summed(p[0]) for p in parts], [summed(p[2]) for p in parts]
        self.contexts, self.words = np.unique(np.concatenate(heads)), np.unique(np.concatenate(words))
        codes = [np.repeat(np.searchsorted(self.contexts, h), p[1].astype(np.int64)) << 32 | np.searchsorted(self.words, w)[p[3].astype(np.int64)] for h, w, p in zip(heads, words, parts)]
        self.ends = np.cumsum([0, *map(len, codes)])
        pairs, self.asked = np.unique(np.concatenate(codes), return_inverse=True)
        self.count = np.bincount(self.asked, weights=np.concatenate([p[4] for p in parts]).astype(np.float64)).astype(np.int64)
        self.context, self.word = pairs >> 32, pairs & 0xFFFFFFFF
        self.many = self.count > 1
        self.customers = np.bincount(self.context, weights=self.count, minlength=len(self.contexts)).astype(np.int64)
        # contexts that other buckets hold as well: where they are here and in the list
        self.here = np.flatnonzero(np.isin(self.contexts, hot))
        self.there = np.searchsorted(hot, self.contexts[self.here])
        self.customers[self.here] = hot_counts[self.there]


def log_stirling(discount: float, room: int = ROOM):
    """Logarithms of the generalised Stirling numbers: weights of n customers at t tables."""
    import numpy as np

    table = np.full((room + 1, room + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(1, room + 1)
    for n in range(room):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(n - discount * t > 0, np.log(np.maximum(n - discount * t, 1e-300)), -np.inf) + table[n, 1:]
        table[n + 1, 1:] = np.logaddexp(table[n, :-1], stay)
    return table


def seats(rng, count, others, share, discount: float, stirling, strength: float = STRENGTH):
    """Draws the tables of dishes of ``count`` customers each, where the restaurant has ``others``
    tables besides and the parent gives the dish the probability ``share``."""
    import numpy as np

    room = len(stirling) - 1
    found = np.zeros(len(count), np.int64)
    log_share = np.log(share)

    def weights(n, rows):
        tables = np.arange(n)
        log = stirling[n, 1 : n + 1] + np.cumsum(np.log(strength + discount * (others[rows, None] + tables)) + log_share[rows, None], axis=1)
        log -= log.max(1, keepdims=True)
        return np.exp(log, out=log)

    def slices(rows, n):
        each = max(1, CELLS // n)
        return (rows[i : i + each] for i in range(0, len(rows), each))

    rest = count % room
    order = np.argsort(rest, kind="stable")
    sizes, start = np.unique(rest[order], return_index=True)
    for n, same in zip(sizes.tolist(), np.split(order, start[1:])):
        if n == 1:
            found[same] += 1
        for rows in slices(same, n) if n > 1 else ():
            sums = np.cumsum(weights(n, rows), axis=1)
            found[rows] += 1 + (sums < rng.random((len(rows), 1)) * sums[:, -1:]).sum(1).clip(max=n - 1)
    for rows in slices(np.flatnonzero(count >= room), room):
        w = weights(room, rows)
        found[rows] += (rng.multinomial(count[rows] // room, w / w.sum(1, keepdims=True)) * np.arange(1, room + 1)).sum(1)
    return found


def discount_of(ones: int, twos: int) -> float:
    """From the numbers of things seen once and twice."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def split_to(kind: str, words, n_buckets: int, frm: int, arrays):
    """Rows that carry the part of ``arrays`` for each word bucket."""
    import numpy as np

    cut = np.searchsorted(bucket_of(words, n_buckets), np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        part = slice(cut[b], cut[b + 1])
        yield kind, b, frm, None, None, pack(*(f(a[part]) for f, a in arrays))


def same(x):
    return x


def score(docs: DataFrame, held_out, *, key: str = "doc_id", text: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH, bucket_bytes: int = BUCKET_BYTES, block_tokens: int = BLOCK_TOKENS, piece_bytes: int = PIECE, seed: int = 5) -> DataFrame:
    """One row for each document: its key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add one) and ``score``, the model's log10 probability of the text."""
    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), (~F.coalesce(held_out, F.lit(False))).alias("trains"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_buckets = max(1, -(-text_bytes(rows) // bucket_bytes))
    blocks = written(read_blocks(rows, n_buckets, block_tokens, piece_bytes), "lm-blocks")
    every = blocks.where("kind = 'doc'").agg(F.sum("x")).first()[0] or 0
    start = told([START])[0]

    def count_words(to, kinds):
        parts = [unpack(m[3]) for m in kinds["word"]]
        hashes = [summed(p[0]) for p in parts]
        words = np.unique(np.concatenate(hashes))
        places = [np.searchsorted(words, h) for h in hashes]
        total = np.bincount(np.concatenate(places), weights=np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)
        for m, place in zip(kinds["word"], places):
            yield "count", m[0], to, None, None, pack(np.where(words == start, 0, total)[place])
        for w in np.flatnonzero(total * n_buckets > every).tolist():
            yield "hot", int(words[w : w + 1].view(np.int64)[0]), to, int(total[w]), None, None
        own = total[words != start]
        yield "sum", to, to, int(own.sum()), int((own > 0).sum()), None
        yield "low", to, to, int((own == 1).sum()), int((own == 2).sum()), None

    def sums(df, kind):
        found = df.where(F.col("kind") == kind).agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
        return int(found[0]), int(found[1])

    counts = written(exchange(blocks.where("kind = 'word'"), count_words), "lm-counts")
    train_tokens, known = sums(counts, "sum")
    root_discount = discount_of(*sums(counts, "low"))
    # at most one context for each bucket and the text starts: each has more than a bucket's share
    found = sorted((np.array([r["to"]], np.int64).view(np.uint64)[0], r["x"]) for r in counts.where("kind = 'hot'").select("to", "x").collect())
    hot, hot_counts = short(np.array([f[0] for f in found], np.uint64)), np.array([f[1] for f in found], np.int64)
    asked = requests(blocks, n_buckets, hot)

    def tables_of_hot(to, bucket_here, bucket_there, tables):
        for i, at in zip(bucket_here.tolist(), bucket_there.tolist()):
            yield "hot", at, to, int(tables[i]), None, None

    def open_restaurants(to, kinds):
        b = Bucket(kinds["pair"], hot, hot_counts)
        one, many = b.count == 1, b.many
        one_by_context, one_by_word = np.bincount(b.context[one], minlength=len(b.contexts)), np.bincount(b.word[one], minlength=len(b.words))
        context, word = b.context[many], b.word[many]
        yield "state", to, to, None, None, pack(one_by_context, one_by_word, context, word, b.count[many], b.here, b.there)
        tables = one_by_context + np.bincount(context, minlength=len(b.contexts))
        yield "seats", to, to, None, None, pack(np.ones(len(word), np.int64), tables)
        yield from tables_of_hot(to, b.here, b.there, tables)
        yield from split_to("words", b.words, n_buckets, to, [(steps, b.words)])
        yield from split_to("customers", b.words, n_buckets, to, [(same, one_by_word + np.bincount(word, minlength=len(b.words)))])
        yield "low", to, to, int(one.sum()), int((b.count == 2).sum()), None

    opened = written(exchange(asked, open_restaurants), "lm-open")
    release(spark)
    discount = discount_of(*sums(opened, "low"))
    stirling, root_stirling = log_stirling(discount), log_stirling(root_discount)

    def of_hot(df):
        tables = np.zeros(len(hot), np.int64)
        for r in df.where("kind = 'hot'").groupBy("to").agg(F.sum("x").alias("x")).collect():
            tables[r["to"]] = r["x"]
        return tables

    def shares(replies, root):
        """The parent's probabilities of a bucket's words."""
        kept = np.concatenate([unpack(m[3])[0] for m in replies]).astype(np.float64)
        return (kept + (strength + root_discount * root["tables"]) / (known + 1)) / (strength + root["customers"])

    current, root, taken, states = opened, {"tables": known}, [], []
    hot_tables = of_hot(opened)
    for sweep in range(burn_in + samples):

        def seat_words(to, kinds, root_tables=root["tables"], sweep=sweep):
            hashes = [summed(unpack(m[3])[0]) for m in kinds["words"]]
            words = np.unique(np.concatenate(hashes))
            places = [np.searchsorted(words, h) for h in hashes]
            customers = np.bincount(np.concatenate(places), weights=np.concatenate([unpack(m[3])[0] for m in kinds["customers"]]).astype(np.float64)).astype(np.int64)
            rng = np.random.default_rng([seed, 0, sweep, to])
            own = np.minimum(customers, 1)
            tables = seats(rng, customers, np.maximum(root_tables - own, 0).astype(np.float64), np.full(len(words), 1 / (known + 1)), root_discount, root_stirling, strength)
            for m, place in zip(kinds["words"], places):
                yield "reply", m[0], to, len(place), None, pack((customers - root_discount * tables)[place].astype(np.float32))
            yield "sum", to, to, int(customers.sum()), int(tables.sum()), None

        parent = written(exchange(opened.where("kind = 'words'").unionByName(current.where("kind = 'customers'")), seat_words), "lm-parent")
        customers, tables = sums(parent, "sum")
        root = {"customers": customers, "tables": tables}

        def seat_pairs(to, kinds, root=root, hot_tables=hot_tables, sweep=sweep):
            one_by_context, one_by_word, context, word, count, here, there = unpack(kinds["state"][0][3])
            old, tables = unpack(kinds["seats"][0][3])
            context, word, here, there = (x.astype(np.int64) for x in (context, word, here, there))
            tables = tables.astype(np.int64)
            tables_all = tables.copy()
            tables_all[here] = hot_tables[there]
            rng = np.random.default_rng([seed, 1, sweep, to])
            drawn = seats(rng, count.astype(np.int64), np.maximum(tables_all[context] - old, 0).astype(np.float64), shares(kinds["reply"], root)[word], discount, stirling, strength)
            tables = one_by_context + np.bincount(context, weights=drawn, minlength=len(tables)).astype(np.int64)
            yield "seats", to, to, None, None, pack(drawn, tables)
            yield from tables_of_hot(to, here, there, tables)
            customers = one_by_word + np.bincount(word, weights=drawn, minlength=len(one_by_word)).astype(np.int64)
            start = 0
            for m in kinds["reply"]:  # the same parts as came from each word bucket
                end = start + m[1]
                yield "customers", m[0], to, None, None, pack(customers[start:end])
                start = end

        replies, earlier = parent.where("kind = 'reply'"), current
        current = written(exchange(opened.where("kind = 'state'").unionByName(current.where("kind = 'seats'")).unionByName(replies), seat_pairs), "lm-seats")
        hot_tables = of_hot(current)
        release(spark)
        if opened is not earlier and sweep <= burn_in:
            discard(earlier)
        if sweep < burn_in:
            discard(parent)
        else:
            taken.append((replies, current.where("kind = 'seats'")))
            states.append((root, hot_tables))

    def predict(to, kinds):
        b = Bucket(kinds["pair"], hot, hot_counts)
        mean = np.zeros(len(b.count))
        for s, (root, hot_tables) in enumerate(states):
            drawn, tables = (x.astype(np.int64) for x in unpack(kinds[f"seats{s}"][0][3]))
            tables[b.here] = hot_tables[b.there]
            own = np.minimum(b.count, 1)
            own[b.many] = drawn
            new = (strength + discount * tables[b.context]) * shares(kinds[f"reply{s}"], root)[b.word]
            mean += (b.count - discount * own + new) / (strength + b.customers[b.context])
        value = np.minimum(np.rint(-np.log10(mean / len(states)) * SCALE), 2**32 - 1).clip(min=0).astype(np.uint32)
        for m, a, z in zip(kinds["pair"], b.ends, b.ends[1:]):
            yield "value", m[0], to, None, None, pack(value[b.asked[a:z]])

    for s, (replies, seated) in enumerate(taken):
        asked = asked.unionByName(replies.withColumn("kind", F.lit(f"reply{s}"))).unionByName(seated.withColumn("kind", F.lit(f"seats{s}")))
    values = written(exchange(asked, predict), "lm-values")
    discard(opened, *(table for pair in taken for table in pair))
    release(spark)
    of = math.log10(train_tokens + known + 1)

    def add(table: pa.Table) -> pa.Table:
        kinds: dict = {}
        for kind, frm, data in sorted(zip(*(table[c].to_pylist() for c in ("kind", "frm", "data"))), key=lambda r: r[:2]):
            kinds.setdefault(kind, []).append((frm, data))
        first, data = kinds["doc"][0]
        block, rid, ids, there, trains = block_of(data)
        pair = block.pairs(n_buckets, hot)[3]
        value = np.concatenate([unpack(d)[0] for _, d in kinds["value"]]).astype(np.float64)
        count = np.concatenate([unpack(d)[0] for _, d in kinds["count"]]).astype(np.float64)[block.tokens]
        at = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])
        known_tokens = np.add.reduceat((count > 0).astype(np.int64), at)
        base = np.add.reduceat(np.log10(count + 1) - of, at)
        total = -np.add.reduceat(value[pair], at) / SCALE
        made = [pa.array(rid + first, pa.int64()), pa.array(ids, pa.int64(), mask=~there.astype(bool)), pa.array(~trains.astype(bool)), pa.array(block.sizes, pa.int64()), pa.array(known_tokens), pa.array(base), pa.array(total)]
        return pa.table(made, ["rid", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    last = blocks.where("kind = 'doc'").unionByName(counts.where("kind = 'count'")).unionByName(values)
    found = last.groupBy("to").applyInArrow(add, "rid long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    found = found.groupBy("rid", "id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return found.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def fold(key: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 7; fold 2 is held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 7


def op13_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents", "doc_id", "text"), fold() == 2)
