"""Metadata and privacy, protection and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subtypes that are content, and keys that tell who wrote a note.
KEPT_SUBTYPES = ("Link", "Widget")
PERSONAL_KEYS = ("T", "Contents", "RC", "M", "CreationDate", "NM")
LABELS = {"title": "Title", "author": "Author", "lang": "Language", "charset": "Encoding", "url": "Address", "xmp": "XMP data", "id": "Document ID"}


def read_meta(docs: DataFrame) -> DataFrame:
    """Pairs that are not empty, with the two flags of the document."""
    kept = F.map_filter("info", lambda k, v: v.isNotNull() & (v != ""))
    return docs.select("doc_id", "xmp", "has_id", F.explode(kept).alias("key", "value"))


def set_meta(docs: DataFrame, changes: DataFrame, stamp: str) -> DataFrame:
    """Pairs added or replaced; an empty value deletes; XMP goes; the given date is stamped."""
    both = docs.join(changes, "doc_id", "left")
    new = F.coalesce("changes", F.create_map().cast("map<string,string>"))
    zipped = F.map_zip_with("info", new, lambda k, old, v: F.when(v.isNotNull(), v).otherwise(old))
    done = F.map_concat(F.map_filter(zipped, lambda k, v: v.isNotNull() & (v != "") & (k != "ModDate")), F.create_map(F.lit("ModDate"), F.lit(stamp)))
    return both.select("doc_id", done.alias("info"), F.lit(False).alias("xmp"), "has_id")


def scrub(docs: DataFrame) -> DataFrame:
    """No info, no XMP, no id."""
    return docs.select("doc_id", F.create_map().cast("map<string,string>").alias("info"), F.lit(False).alias("xmp"), F.lit(False).alias("has_id"))


def scrub_annots(annots: DataFrame, remove_comments: bool = True) -> DataFrame:
    """Links and widgets stay, others only if comments are kept; personal keys go, but those that
    name a widget's field stay."""
    rows = annots.where(F.col("subtype").isin(*KEPT_SUBTYPES)) if remove_comments else annots
    widget = F.col("subtype") == "Widget"
    kept = F.map_filter("attrs", lambda k, v: ~(k.isin(*PERSONAL_KEYS) & ~(widget & k.isin("T", "RC"))) & (k != "Popup"))
    return rows.withColumn("attrs", kept)


def comment_count(annots: DataFrame) -> DataFrame:
    return annots.groupBy("doc_id").agg(F.count_if(~F.col("subtype").isin(*KEPT_SUBTYPES)).alias("comments"))


def leak_report(docs: DataFrame) -> DataFrame:
    """What a document gives away, by label: its pairs and its flags."""
    pairs = read_meta(docs).select("doc_id", "key", "value")
    flags = docs.where("xmp").select("doc_id", F.lit("xmp").alias("key"), F.lit("yes").alias("value")).unionByName(docs.where("has_id").select("doc_id", F.lit("id").alias("key"), F.lit("yes").alias("value")))
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return pairs.unionByName(flags).select("doc_id", F.coalesce(F.element_at(labels, F.col("key")), F.col("key")).alias("label"), "value")


def parse_doc_date(text: Column) -> Column:
    """Timestamp of ``D:YYYYMMDDHHmmSS``; missing and zero parts take their least value, parts out of
    range roll over into the next larger one, years below 100 are of the 20th century; null for other texts."""
    pattern = r"D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"

    def part(i: int, least: int) -> Column:
        n = F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int")
        return F.when(F.coalesce(n, F.lit(0)) == 0, least).otherwise(n)

    year = F.when(part(1, 0) < 100, part(1, 0) + 1900).otherwise(part(1, 0))
    first = F.try_make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    rest = F.make_interval(months=part(2, 1) - 1, days=part(3, 1) - 1, hours=part(4, 0), mins=part(5, 0), secs=part(6, 0))
    return F.when(text.rlike(pattern), first + rest)


def protect(df: DataFrame, password: str, *, text: str = "text", salt: str = "doc_id") -> DataFrame:
    """``cipher`` and the digest that tells a right key: AES-GCM under a key for each row."""
    key = F.unhex(F.sha2(F.concat(F.col(salt).cast("string"), F.lit(password)), 256))
    return df.withColumn("cipher", F.aes_encrypt(F.col(text).cast("binary"), key, F.lit("GCM")))


def unlock(df: DataFrame, password: str, *, salt: str = "doc_id") -> DataFrame:
    """``plain``; a wrong password is an error of that row (``ok`` false), not of the job."""
    key = F.unhex(F.sha2(F.concat(F.col(salt).cast("string"), F.lit(password)), 256))
    plain = F.try_aes_decrypt(F.col("cipher"), key, F.lit("GCM")).cast("string")
    return df.withColumn("plain", plain).withColumn("ok", F.col("plain").isNotNull())


def digests(df: DataFrame, text: str = "text") -> DataFrame:
    data = F.col(text).cast("binary")
    return df.withColumns({"md5": F.md5(data), "sha256": F.sha2(data, 256), "sha384": F.sha2(data, 384), "sha512": F.sha2(data, 512), "crc32": F.crc32(data)})


# Permission bits, over the reserved bits 0xfffff0c0.
PERMISSIONS = {"print": 1 << 2, "modify": 1 << 3, "copy": 1 << 4, "annotate": 1 << 5, "fill": 1 << 8, "accessibility": 1 << 9, "assemble": 1 << 10}
RESERVED, PRINT_HIGH = -3904, 1 << 11


def perm_bits(flags: dict[str, Column]) -> Column:
    """Signed mask of a permission set; what is not given is allowed; fine print needs print."""
    def on(name: str) -> Column:
        return F.coalesce(flags[name], F.lit(True)) if name in flags else F.lit(True)

    mask = F.lit(RESERVED)
    for name, bit in PERMISSIONS.items():
        mask = mask.bitwiseOR(F.when(on(name), bit).otherwise(0))
    return mask.bitwiseOR(F.when(on("print") & on("printHigh"), PRINT_HIGH).otherwise(0))


def password_score(text: Column) -> Column:
    """0 to 4: length from 8, from 12, both cases, a digit with a symbol; under 6 characters 0."""
    def point(c: Column) -> Column:
        return F.when(c, 1).otherwise(0)

    n = F.length(text)
    total = point(n >= 8) + point(n >= 12) + point(text.rlike("[a-z]") & text.rlike("[A-Z]")) + point(text.rlike("[0-9]") & text.rlike("[^A-Za-z0-9]"))
    return F.when(n < 6, 0).otherwise(total)
