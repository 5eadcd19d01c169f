"""Personal data: fixed patterns, and terms that disclose what the patterns protect.

E-mail addresses, IP addresses, card and phone numbers are found by pattern; each distinct value
is a protected entity.  Corpus counts then tell how much a term reveals an entity.  Of the n(t)
texts that hold a term, n(t, e) hold the entity too, the term outside of any span; who reads the
term still lacks -log2 p(e | t) bits to know the entity.  p(e | t) is the lower end of Wilson's
interval for n(t, e) of n(t) (one-sided, 95 %), so no term is told by one or two texts: three are needed if
all hold the entity, more if some do not.  A term discloses the entity if at most ``GENERALISE``
bits are left and it gained ``GAIN`` bits or more over -log2 p(e); that alone follows the number
of texts, so an entity of a few texts has the same terms in a table of any size.  Such terms become spans
too: where at most ``REMOVE`` bits are left they are cut out, otherwise a placeholder stands for them.
Equal texts are one text in all counts, since a copy tells nothing new; every copy is marked.

One pass writes the entities and distinct terms of each text that holds an entity.  Entities
of the same texts are counted as one.  A pair is counted only if its term is rare enough to
reach ``GENERALISE``, which leaves out no term that would.  A second pass writes the places
of those terms by text; joined with the disclosing terms they give the terms of each text, which a
last join brings back to the texts: as many passes whatever the number of terms, and none is collected.

Cases: a null text counts as empty and has no spans; spans are in code points and may overlap;
texts of any length are scanned whole, in the time of a sort of their terms; ties between spans
go by start, then kind; repeated rows count as documents each; columns named as the results give
way, all others pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import load, python_rows, written
from folio.llm.substrings import Hasher

#: Bits left of an entity, at most, for a term to be generalised and to be removed; bits gained at least.
GENERALISE, REMOVE, GAIN = 1.0, 0.5, 3.0
#: Quantile of the lower bound of p(e | t): one-sided, 95 %.
QUANTILE = 1.645
#: Texts that a pair needs at least: fewer leave more than ``GENERALISE`` bits even if all hold the entity.
LEAST = math.ceil(QUANTILE**2 / (2.0**GENERALISE - 1))
#: Letters of a term at least.
TERM_LETTERS = 3
#: Bits of the table that tells which terms to count (2 MB, whatever the input); terms that fall on
#: a bit of another are counted for nothing.
TABLE_BITS = 24
KINDS = ("email", "ip", "card", "phone", "term")

# The patterns of the base kinds.  Anchored and guarded forms of the same patterns
# avoid trying again inside a run that has failed already.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_FROM_START = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL.pattern)
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")
NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in order; kinds by their place in ``KINDS``."""
    spans = []
    if "@" in text:
        at = 0
        while m := EMAIL.match(text, at) or EMAIL_FROM_START.search(text, at):
            spans.append((m.start(), 0, m.end()))
            at = m.end()
    digits = text.encode("utf-8", "surrogatepass").translate(None, NOT_DIGITS)
    if len(digits) >= 4 and "." in text:
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    if len(digits) >= 12:
        for m in CARD.finditer(text):
            number = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(number) <= 19 and luhn(number):
                spans.append((m.start(), 2, m.end()))
    if len(digits) >= 9 and "+" in text:
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(spans)


def entity(text: str, kind: int, start: int, end: int) -> bytes:
    value = text[start:end]
    return f"{KINDS[kind]}:{value.lower() if kind == 0 else ''.join(DIGITS.findall(value)) if kind > 1 else value}".encode()


class Terms:
    """The terms of a text: runs of letters and digits in lower case, by hash."""

    def __init__(self):
        self.hasher = Hasher()
        self.fold = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

    def __call__(self, text: str):
        """Byte positions and hashes of the terms, and the bytes."""
        import numpy as np

        low = text.lower()
        if len(low) != len(text):
            low = "".join([c.lower() if len(c.lower()) == 1 else c for c in text])
        raw = np.frombuffer(low.encode("utf-8", "surrogatepass").translate(self.fold), np.uint8)
        there = np.concatenate([[False], raw != 32, [False]])
        edge = np.flatnonzero(there[1:] != there[:-1])
        starts, ends = edge[::2], edge[1::2]
        return raw, starts, ends, self.hasher.spelt(raw, starts, ends)

    @staticmethod
    def characters(raw):
        """The code point that each byte position stands in."""
        import numpy as np

        return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def inside(a, b, spans):
    """Which stretches a..b overlap a base span: two searches for each kind, whose spans are apart
    and in order, whatever the number of spans."""
    import numpy as np

    found = np.zeros(len(a), bool)
    for kind in range(len(KINDS) - 1):
        own = [(x[0], x[2]) for x in spans if x[1] == kind]
        if own:
            begin, end = np.array(own).T
            found |= np.searchsorted(begin, b) > np.searchsorted(end, a, side="right")
    return found


def outside(raw, starts, ends, spans):
    """Which terms stand in no span."""
    import numpy as np

    at = Terms.characters(raw)
    a, b = at[starts], at[ends]
    return np.flatnonzero(~inside(a, b, spans) & (b - a >= TERM_LETTERS))


def signed(h) -> int:
    return int(h.astype("int64"))


def left(n_both: F.Column, n_term: F.Column) -> F.Column:
    """Bits that a term leaves of an entity: -log2 of the lower bound of p(e | t)."""
    square = QUANTILE**2
    spread = QUANTILE * F.sqrt(n_both * (n_term - n_both) / n_term + square / 4)
    return -F.log2((n_both + square / 2 - spread) / (n_term + square))


def identity(text: str) -> list[F.Column]:
    """What tells a text from others: two hashes of 64 bits."""
    return [F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b")]


def lists(rows, *names: str) -> pa.RecordBatch:
    """(a, b, lists of hashes)"""
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * len(names)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", *names])


def bit_table(terms: DataFrame) -> bytes:
    """A bit for the first ``TABLE_BITS`` bits of each term; as many rows as the table has words, at most."""
    import numpy as np

    spot = terms.selectExpr(f"shiftrightunsigned(term, {64 - TABLE_BITS}) AS spot")
    filled = spot.selectExpr("shiftright(spot, 6) AS word", "shiftleft(1L, cast(spot & 63 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    return table.tobytes()


def disclosing(docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b, terms array<struct<term, cut>>): for each text, by ``identity``, the terms in it that disclose an entity."""
    import numpy as np

    texts = docs.select(F.col(text).alias("text"), *identity(text)).where(F.col("text").isNotNull())
    total = texts.select("a", "b").distinct().count()

    def holders(pieces):
        terms = Terms()
        for batch in pieces:
            rows = []
            for t, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if spans := base_spans(t):
                    raw, starts, ends, hashes = terms(t)
                    who = {signed(terms.hasher.words(entity(t, kind, s, e).replace(b" ", b""))[0]) for s, kind, e in spans}
                    rows.append((a, b, list(who), np.unique(hashes[outside(raw, starts, ends, spans)]).view(np.int64).tolist()))
            if rows:
                yield lists(rows, "entities", "terms")

    held = python_rows(texts, holders, "a long, b long, entities array<long>, terms array<long>")
    held = written(held.dropDuplicates(["a", "b"]), "holders")
    who = held.select("a", "b", F.explode("entities").alias("entity"))
    # entities of the same texts are one; one that is no rarer than GAIN asks has no terms
    sets = who.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    sets = sets.where((F.col("n_entity") >= LEAST) & (F.col("n_entity") * 2**GAIN <= total))
    groups = written(who.join(sets, "entity").select("a", "b", "x", "y", "n_entity").distinct(), "entities")
    # texts that a term may have, at most, to reach GENERALISE
    limit = F.col("n_entity") * 2**GENERALISE
    most = groups.agg(F.max(limit)).first()[0] or 0.0
    what = held.select("a", "b", F.explode("terms").alias("term"))
    rare = what.groupBy("term").agg(F.count("*").alias("n_held")).where(F.col("n_held").between(LEAST, most))
    pairs = what.join(rare, "term").join(groups, ["a", "b"]).where(F.col("n_held") <= limit)
    pairs = pairs.groupBy("x", "y", "n_entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= LEAST)
    pairs = written(pairs, "pairs")
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(pairs))

    def places(pieces):
        terms, bitmap = Terms(), np.frombuffer(bits.value, np.uint8)
        if not bitmap.any():
            return
        for batch in pieces:
            rows = []
            for t, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = terms(t)[3]
                at = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.uint32)
                hit = hashes[bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
                if len(hit):
                    rows.append((a, b, np.unique(hit).view(np.int64).tolist()))
            if rows:
                yield lists(rows, "terms")

    placed = python_rows(texts, places, "a long, b long, terms array<long>").dropDuplicates(["a", "b"])
    placed = written(placed.select("a", "b", F.explode("terms").alias("term")), "places")
    seen = placed.groupBy("term").agg(F.count("*").alias("n_term"))
    told = pairs.join(seen, "term").withColumn("left", left(F.col("n_both"), F.col("n_term")))
    gained = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity")) - F.col("left")
    told = told.where((F.col("left") <= GENERALISE) & (gained >= GAIN)).groupBy("term").agg((F.min("left") <= REMOVE).alias("cut"))
    # no longer than the text's own terms
    return written(placed.join(told, "term").groupBy("a", "b").agg(F.collect_list(F.struct("term", "cut")).alias("terms")), "disclosed")


def rewrite(text: str, spans: list[tuple[int, int, int]], cut: set[int]) -> str:
    """The text with base spans replaced by their kind, terms by a placeholder or nothing."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out.append(text[at:s])
            out.append("" if s in cut else f"[{KINDS[kind].upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sanitised`` and ``pii array<struct<kind, start, end, cut>>`` in text order."""
    import numpy as np

    docs = docs.drop("sanitised", "pii")
    names = docs.columns
    # a written table: Spark broadcasts it below its own size limit, and joins by text beyond
    rows = docs.select(F.struct("*").alias("row"), *identity(text)).join(disclosing(docs, text), ["a", "b"], "left")
    rows = rows.select("row.*", F.col("terms").alias("pii"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cut", pa.bool_())]))

    def run(pieces):
        read = Terms()
        for batch in pieces:
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            every, clean = [], []
            for t, told in zip(texts, batch.column(len(names)).to_pylist()):
                spans = [(s, k, e, False) for s, k, e in base_spans(t)]
                if told:
                    cut = {x["term"]: x["cut"] for x in told}
                    raw, starts, ends, hashes = read(t)
                    hit = np.flatnonzero(np.isin(hashes.view(np.int64), np.array(list(cut), np.int64)))
                    at = Terms.characters(raw)
                    a, b = at[starts[hit]], at[ends[hit]]
                    free = ~inside(a, b, spans)
                    spans += [(s, 4, e, cut[h]) for s, e, h in zip(a[free].tolist(), b[free].tolist(), hashes[hit][free].view(np.int64).tolist())]
                spans.sort()
                every.append([{"kind": KINDS[k], "start": s, "end": e, "cut": c} for s, k, e, c in spans])
                clean.append(rewrite(t, [x[:3] for x in spans], {s for s, k, _, c in spans if c and k == 4}))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(clean, pa.string()), pa.array(every, kind)], [*names, "sanitised", "pii"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    fields += ["sanitised string", "pii array<struct<kind:string,start:int,end:int,cut:boolean>>"]
    return python_rows(rows, run, ", ".join(fields), text=text)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(load(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"] != "term")

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts[:4], F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("pii")).alias("spans"), counts[4])
