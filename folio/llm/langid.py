"""Language identification: script ranges, scores of words, Viterbi over the words.

The script of a word (from ranges of code points) narrows its candidate languages to those
that were seen in that script.  Each candidate scores the word by its character n-grams, and
a Viterbi pass over the words with a penalty for each switch labels spans of one language, so
a text of several languages comes back as several spans.  The prediction is the language of
most letters.

A model is fitted on labelled rows: about ``SAMPLE_DOCS`` different texts of each language, whole.
A hash of language and text draws them, so the same rows give the same model in any order and
any partitions, and copies of a text count once.  All languages are learned.  Counts of n-grams
are added in two steps, so no task adds more than ``PARTS`` of them at once.  The model's table has 2**25
numbers at most: beyond 256 languages its n-grams share more buckets.  Prediction is local to a
row, reads only its text, and never shuffles.

Cases: a null text, or one without letters, is ``und`` with score 0; so is every text if no
row was labelled.  Ties between languages go to the first in code-point order.  Very long
texts are labelled whole.  Repeated rows get the same answer each; an empty table gives an
empty table; other columns pass through, and those with the names of the results give way.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import load, python_rows

#: Different texts (about) that the model is fitted on, of each language.
SAMPLE_DOCS = 1500
#: Hashed n-grams that the model tells apart, and the lengths of n-grams.
BUCKET_BITS = 17
ORDERS = (2, 3, 4)
#: Cost of a switch between two words, in the unit of the word scores (nats).
SWITCH = 14.0
#: Least part of a language's letters that makes a script one of its own.
SCRIPT_SHARE = 0.01
#: Numbers in a model's table at most.
MOST_NUMBERS = 1 << 25
#: Languages whose shares are broadcast (4 MB); the shares of more are joined by a shuffle.
BROADCAST_LANGUAGES = 1 << 16
#: Parts that the counts of a language are added in first.
PARTS = 32
UNKNOWN = "und"
#: Positions that are scored at once.
STEP = 1 << 15

# First code point of runs of scripts; 0 stands for every other script.
SCRIPT_STARTS = (
    (0x0000, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6),
    (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0), (0x0B80, 11), (0x0C00, 12), (0x0C80, 13),
    (0x0D00, 14), (0x0D80, 0), (0x0E00, 15), (0x0E80, 0), (0x10A0, 16), (0x1100, 17), (0x1200, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 18), (0x3100, 0), (0x3400, 19), (0xA000, 0), (0xAC00, 17), (0xD800, 0), (0xF900, 19), (0xFB00, 0),
    (0x20000, 19), (0x30000, 0),
)
N_SCRIPTS = 20


@dataclass
class Model:
    languages: list[str]
    #: (2**bits, languages) float32: how much an n-gram speaks for each language.
    table: object
    #: (scripts, languages) bool
    scripts: object
    bits: int = BUCKET_BITS


def tables():
    """Lower case of every letter (0: no letter), and the script of every code point."""
    import numpy as np

    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    script = np.zeros(0x110000, dtype=np.uint8)
    for (start, kind), (end, _) in zip(SCRIPT_STARTS, [*SCRIPT_STARTS[1:], (0x110000, 0)]):
        script[start:end] = kind
    return lower, script


class Reader:
    """Turns texts into letters, words and hashed n-grams, many texts at a time."""

    def __init__(self, lower, script, bits: int = BUCKET_BITS):
        self.lower, self.script, self.bits = lower, script, bits

    def letters(self, texts: list[str]):
        """Lower-cased letters of the joined texts (0 between words), and the texts' offsets."""
        import numpy as np

        raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        return self.lower[raw], raw, np.concatenate([[0], ends])

    @staticmethod
    def words(codes):
        import numpy as np

        there = np.concatenate([[False], codes != 0, [False]])
        edge = np.flatnonzero(there[1:] != there[:-1])
        return edge[::2], edge[1::2]

    def grams(self, codes):
        """For slices of the letters: where they begin, and for each order the bucket of the
        n-gram that ends at each position and whether it lies in one word with its edges."""
        import numpy as np

        longest = max(ORDERS)
        padded = np.concatenate([np.zeros(longest - 1, np.uint32), codes, np.zeros(1, np.uint32)])
        n = len(codes) + 1
        shift = np.uint32(32 - self.bits)
        for start in range(0, n, STEP):
            size = min(STEP, n - start)
            at = [padded[start + longest - 1 - k : start + longest - 1 - k + size] for k in range(longest)]
            out = []
            for order in ORDERS:
                h = np.full(size, order, dtype=np.uint32)
                for k in range(order - 1, -1, -1):
                    h = (h ^ at[k]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                inner = np.ones(size, bool) if order > 2 else (at[0] != 0) | (at[1] != 0)
                for k in range(1, order - 1):
                    inner &= at[k] != 0
                out.append(((h * np.uint32(0x85EBCA6B)) >> shift, inner))
            yield start, size, out


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Model:
    """A model of the languages in ``labelled``; rows without a text or a language are passed over."""
    import numpy as np

    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    drawn_by = F.xxhash64("lang", "text")
    counts = rows.select("lang", drawn_by.alias("by")).distinct().groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    bits = min(BUCKET_BITS, max(1, MOST_NUMBERS // len(counts)).bit_length() - 1)
    size = 1 << bits
    shares = spark.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in counts], "lang string, share double")
    shares = F.broadcast(shares) if len(counts) <= BROADCAST_LANGUAGES else shares
    place = F.shiftrightunsigned(drawn_by, 11) / F.lit(float(1 << 53))
    drawn = rows.join(shares, "lang").where(place < F.col("share")).select("text", "lang").distinct()
    shared = spark.sparkContext.broadcast(tables())

    def count(pieces):
        reader = Reader(*shared.value, bits)
        for batch in pieces:
            by: dict[str, list[str]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                codes, raw, _ = reader.letters(texts)
                total = held.setdefault(name, np.zeros(size + N_SCRIPTS, np.int64))
                for _, _, grams in reader.grams(codes):
                    for bucket, inner in grams:
                        total[:size] += np.bincount(bucket[inner], minlength=size)
                total[size:] += np.bincount(reader.script[raw[codes != 0]], minlength=N_SCRIPTS)
            if len(held) * size > MOST_NUMBERS // 8:
                yield sums(held)
        if held:
            yield sums(held)

    held: dict = {}

    def sums(held):
        part = [uuid.uuid4().int % PARTS for _ in held]
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(part, pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["lang", "part", "counts"])
        held.clear()
        return made

    def add(batches):
        """Adds the counts of each key as they stream by."""
        key, total = None, None
        for batch in batches:
            for name, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, part) != key:
                    if key:
                        yield row(key, total)
                    key, total = (name, part), np.zeros(size + N_SCRIPTS, np.int64)
                total += np.frombuffer(data, np.int64)
        if key:
            yield row(key, total)

    def row(key, total):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lang", "part", "counts"])

    schema = "lang string, part int, counts binary"
    parts = python_rows(drawn.select("text", "lang"), count, schema)
    parts = parts.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(add, schema)
    whole = parts.withColumn("part", F.lit(0)).repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(add, schema)
    languages, seen, scripts = [], [], []
    for r in whole.orderBy("lang").toLocalIterator():
        found = np.frombuffer(bytes(r["counts"]), np.int64)
        languages.append(r["lang"])
        logs = found[:size] + 0.5
        seen.append(np.log(logs / logs.sum()).astype(np.float32))
        scripts.append(found[size:] >= SCRIPT_SHARE * max(int(found[size:].sum()), 1))
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    table = np.stack(seen, axis=1)
    seen.clear()
    table -= table.mean(1, keepdims=True)
    table /= len(ORDERS)
    return Model(languages, table, np.stack(scripts, axis=1), bits)


def best_path(scores, penalty: float) -> list[int]:
    """The label of each word that maximises the sum of scores less ``penalty`` for each switch."""
    rows = scores.tolist()
    value, back = rows[0], []
    for row in rows[1:]:
        top = max(value)
        at, floor = value.index(top), top - penalty
        back.append([k if v >= floor else at for k, v in enumerate(value)])
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row)]
    label = value.index(max(value))
    path = [label]
    for step in reversed(back):
        label = step[label]
        path.append(label)
    return path[::-1]


class Labeller:
    def __init__(self, model: Model, lower, script, penalty: float):
        self.model, self.penalty = model, penalty
        self.reader = Reader(lower, script, model.bits)
        self.narrow = not model.scripts.all()

    def word_scores(self, codes, raw, starts):
        import numpy as np

        k = len(self.model.languages)
        scores = np.zeros((len(starts), k), np.float32)
        for start, size, grams in self.reader.grams(codes):
            total = np.zeros((size, k), np.float32)
            for bucket, inner in grams:
                got = self.model.table[bucket]
                got[~inner] = 0
                total += got
            low, high = np.searchsorted(starts, [start, start + size])
            own = starts[low:high] - start
            first = own[0] if len(own) else size
            if low and first:  # a word that began in the slice before
                scores[low - 1] += total[:first].sum(0)
            if len(own):
                scores[low:high] += np.add.reduceat(total, own, axis=0)
        if self.narrow and len(starts):
            may = self.model.scripts[self.reader.script[raw[starts]]]
            known = may.any(1, keepdims=True)
            scores = np.where(may, scores, np.where(known, np.float32(-1e4), np.float32(0)))
            scores[~known[:, 0]] = 0
        return scores

    def label(self, scores):
        """Labels of one text's words, or one label for all of them."""
        import numpy as np

        one = int(scores.sum(0, dtype=np.float64).argmax())
        if scores.shape[1] > 1:
            gain = (np.delete(scores, one, axis=1).max(1) - scores[:, one]).astype(np.float64)
            sums = np.concatenate([[0.0], np.cumsum(gain)])
            # no run of words gains more elsewhere than one switch costs: the constant path is best
            if (sums[1:] - np.minimum.accumulate(sums[:-1])).max() > self.penalty:
                return np.array(best_path(scores, self.penalty))
        return one

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list]]:
        import numpy as np

        names = self.model.languages
        codes, raw, offsets = self.reader.letters([t or "" for t in texts])
        starts, ends = self.reader.words(codes)
        if not names or not len(starts):
            return [(UNKNOWN, 0.0, []) for _ in texts]
        scores = self.word_scores(codes, raw, starts)
        cuts = np.searchsorted(starts, offsets)
        out = []
        for i in range(len(texts)):
            a, b = cuts[i], cuts[i + 1]
            if a == b:
                out.append((UNKNOWN, 0.0, []))
                continue
            labels = self.label(scores[a:b])
            begin, end = starts[a:b] - offsets[i], ends[a:b] - offsets[i]
            if isinstance(labels, int):
                best, share, own = labels, 1.0, scores[a:b]
                spans = [{"start": int(begin[0]), "end": int(end[-1]), "lang": names[best]}]
            else:
                weight = np.bincount(labels, weights=end - begin, minlength=len(names))
                best = int(weight.argmax())
                share, own = float(weight[best] / weight.sum()), scores[a:b][labels == best]
                cut = np.flatnonzero(np.diff(labels)) + 1
                spans = [{"start": int(begin[x]), "end": int(end[y - 1]), "lang": names[labels[x]]} for x, y in zip([0, *cut], [*cut, b - a])]
            total = own.sum(0, dtype=np.float64)
            sure = 1.0 / float(np.exp(np.clip(total - total[best], -700, 50)).sum())
            out.append((names[best], share * min(1.0, sure), spans))
        return out


def identify(docs: DataFrame, model: Model, *, text: str = "text", penalty: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``spans`` of one language each."""
    rest = docs.drop("lang_pred", "score", "spans")
    names = rest.columns
    shared = docs.sparkSession.sparkContext.broadcast((model, *tables()))

    def run(pieces):
        labeller = Labeller(*shared.value, penalty)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in pieces:
            texts = batch.column(names.index(text)).to_pylist()
            found = labeller(texts) if texts else []
            made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "lang_pred", "score", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return python_rows(rest, run, f"{fields}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>", text=text)


def fold(key: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(fold() != 0))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"), "spans")
