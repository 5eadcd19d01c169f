"""Text measures and layout."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.columns import bound

# Advances of the standard faces from their public metrics, in thousandths of the size:
# space to tilde in code order, then what is not a letter with a mark.
SANS = (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 "
    "1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 "
    "333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
)
SANS_MORE = {"€": 556, "‚": 222, "„": 333, "…": 1000, "‰": 1000, "Œ": 1000, "‘": 222, "’": 222, "“": 333, "”": 333, "•": 350, "–": 556, "—": 1000, "™": 1000, "œ": 944, "¡": 333, "§": 556, "©": 737, "«": 556, "®": 737, "°": 400, "·": 278, "»": 556, "¿": 611, "Æ": 1000, "Ø": 778, "ß": 611, "æ": 889, "ø": 611}
SERIF = (
    "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 "
    "921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 "
    "333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
)
SERIF_MORE = {"€": 500, "‚": 333, "„": 444, "…": 1000, "‰": 1000, "Œ": 889, "‘": 333, "’": 333, "“": 444, "”": 444, "•": 350, "–": 500, "—": 1000, "™": 980, "œ": 722, "¡": 333, "§": 500, "©": 760, "«": 500, "®": 760, "°": 400, "·": 250, "»": 500, "¿": 444, "Æ": 889, "Ø": 722, "ß": 500, "æ": 667, "ø": 500}
#: Advance of every character of the fixed-pitch face.
FIXED_ADVANCE = 600
FACES = {"sans": (SANS, SANS_MORE, 556), "serif": (SERIF, SERIF_MORE, 500)}


def advances(face: str) -> dict[str, int]:
    """The advance of every character of the Windows single-byte set in a face (sans, serif, fixed): a
    letter with a mark is as wide as without, what has no width of its own as a figure."""
    codes = [c for c in range(32, 256) if c != 127]
    known = [bytes([c]).decode("cp1252", "ignore") for c in codes]
    if face == "fixed":
        return {c: FIXED_ADVANCE for c in known if c}
    plain, more, other = FACES[face]
    base = dict(zip(map(chr, range(32, 127)), map(int, plain.split()))) | more | {"ı": 278}
    letter = lambda c: unicodedata.normalize("NFD", c)[0]
    of = lambda c: base.get(c) or (278 if letter(c) == "i" else base.get(letter(c), other))
    return {c: of(c) for c in known if c}


def widths(spark, advance=lambda ch: FIXED_ADVANCE) -> DataFrame:
    """(ch, advance) of the single-byte characters, each with its own ``advance(ch)``."""
    return spark.createDataFrame([(c, int(advance(c))) for c in advances("fixed")], "ch string, advance int")


def face_widths(spark, face: str) -> DataFrame:
    return widths(spark, advances(face).__getitem__)


def text_width(df: DataFrame, table: DataFrame, size: float, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Width of each text: the advances of its characters, that of ``?`` for those the face lacks and
    none for control characters.  The table has a row for each character of a face, 256 at most,
    so it is broadcast."""
    counted = df.select(key, F.explode(F.split(text, "")).alias("ch")).groupBy(key, "ch").agg(F.count("*").alias("n"))
    known = counted.join(F.broadcast(table), "ch", "left")
    question = table.where("ch = '?'").select(F.col("advance").alias("other"))
    wide = known.join(F.broadcast(question), F.col("advance").isNull() & (F.ascii("ch") >= 32), "left")
    return wide.groupBy(key).agg((F.sum(F.col("n") * F.coalesce("advance", "other", F.lit(0))) / 1000 * size).alias("width"))


def encodable(text: Column) -> Column:
    """Whether the Windows single-byte set has every character."""
    return text.rlike(r"^[\x09\x0A\x0D\x20-\x7E\xA0-\xFF€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]*$")


def wrap(text: Column, columns: int) -> Column:
    """Greedy wrapping of each paragraph at a width in characters; separators stay, ends are trimmed."""

    def paragraph(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

        def step(acc: Column, token: Column) -> Column:
            over = (F.length(F.rtrim(F.concat(acc["line"], token))) > columns) & (F.trim(acc["line"]) != "")
            return F.struct(F.when(over, F.array_append(acc["done"], F.rtrim(acc["line"]))).otherwise(acc["done"]).alias("done"), F.when(over, F.ltrim(token)).otherwise(F.concat(acc["line"], token)).alias("line"))

        return F.aggregate(F.regexp_extract_all(p, F.lit(r"\s+|\S+"), F.lit(0)), start, step, lambda a: F.array_append(a["done"], F.rtrim(a["line"])))

    return F.flatten(F.transform(F.split(text, "\n"), paragraph))


def wrap_measured(text: Column, width: float, size: float, advance: dict[str, int]) -> Column:
    """Greedy wrapping of each paragraph at a width in points, by the advances of a face.  Tokens are
    measured once; the fold carries the width of the line so far, with and without what ends it."""
    other = advance["?"]
    # by code point: a map would be searched from its start for every character
    codes = [advance.get(chr(c), 0 if c < 32 else other) for c in range(max(map(ord, advance)) + 1)]
    table = F.split(F.lit(" ".join(map(str, codes))), " ").cast("array<int>")

    def measured(token: Column) -> Column:
        wide = lambda total, c: total + F.coalesce(F.get(table, F.ascii(c)), F.lit(other))
        return F.struct(token.alias("s"), F.aggregate(F.split(token, ""), F.lit(0), wide).alias("w"), token.rlike(r"^\s").alias("blank"))

    def paragraph(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"), F.lit(0).alias("full"), F.lit(0).alias("inked"))

        def step(acc: Column, t: Column) -> Column:
            full = acc["full"] + t["w"]
            inked = F.when(t["blank"], acc["inked"]).otherwise(full)
            over = (acc["line"] != "") & (inked * size / 1000 > width)
            # one choice of two structs, so that it is made once
            fresh = F.when(t["blank"], 0).otherwise(t["w"])
            cut = F.struct(F.array_append(acc["done"], F.rtrim(acc["line"])).alias("done"), F.when(t["blank"], "").otherwise(t["s"]).alias("line"), fresh.alias("full"), fresh.alias("inked"))
            return F.when(over, cut).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["line"], t["s"]).alias("line"), full.alias("full"), inked.alias("inked")))

        tokens = F.transform(F.regexp_extract_all(p, F.lit(r"\s+|\S+"), F.lit(0)), measured)
        return F.aggregate(tokens, start, step, lambda a: F.array_append(a["done"], a["line"]))

    return F.flatten(F.transform(F.split(text, "\n"), paragraph))


def align_lines(lines: DataFrame, how: str) -> DataFrame:
    """``ax``: where each line of a box begins."""
    box = F.max("width").over(Window.partitionBy("doc_id", "page_no"))
    free = box - F.col("width")
    return lines.withColumn("ax", {"left": F.lit(0.0), "center": free / 2, "right": free * 1.0}[how])


def align_pages(pages: DataFrame, how: str) -> DataFrame:
    """``align_lines`` of pages (doc_id, page_no, lines) whose lines (with ``width``) stand in one row."""
    free = lambda lines: bound(F.array_max(F.transform(lines, lambda one: one["width"])), lambda box: F.transform(lines, lambda one: F.struct(one.alias("line"), {"left": F.lit(0.0), "center": (box - one["width"]) / 2, "right": (box - one["width"]) * 1.0}[how].alias("ax"))))
    return pages.select("doc_id", "page_no", F.explode(bound(F.col("lines"), free)).alias("l")).select("doc_id", "page_no", "l.line.*", "l.ax")
