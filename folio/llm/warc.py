"""WARC archives with a two-level capture index.

Records are written by the tasks that hold the pages, each as a gzip member of its own, into
archive files of bounded size in the shared folder; a file's place in the manifest appears only
when the file is whole, so a task that is run again leaves at most an unused file.  Equal
payloads of ``LEAST_REVISIT`` bytes or more are stored once: the capture with the least page id
is the response, the others are revisits that refer to it.  Finding them moves digests and
ids, and pages once by digest, in a join whose hot digests adaptive execution can split.

The index has two levels.  Captures are sorted by reversed-host URL key in ranges; each range
becomes a shard file of compressed blocks of ``BLOCK`` lines with a sparse directory of the
blocks' first keys.  A search goes to its shard by the shards' first keys (at most
``MOST_SHARDS``), binary-searches the directory, reads one block by its byte range, searches
in the block, and at last reads just the record's bytes from its archive.

Cases: a null payload is empty; a null URL has the key ``-``; null page ids count as larger
than all others; repeated rows of the page id that comes first are all responses; a very long
payload is one record, held whole by the task that writes or reads it; header values are
percent-encoded where they hold control characters; other columns are left out, whatever their
names; an empty table gives an empty table.  The table has no times of capture, so all records
bear one date and captures of one URL are told apart by page id.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import load, new_path, partitions_for, python_rows, written

LEAST_REVISIT, BLOCK, MOST_SHARDS = 100, 1000, 10_000
FILE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\[\]]*|\[[^\]]*\])(?::([0-9]*))?([^#]*)", re.S)


def filesystem(path: str):
    """The store of a path and the path in it; on every executor, through the shared folder's scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def url_key(url: str | None) -> str:
    """Reversed host, then port and path: ``com,example,www)/a?b``."""
    if not url:
        return "-"
    m = URL.match(url)
    if not m or not m[1]:
        return url.lower()
    host = ",".join(reversed(m[1].lower().split(".")))
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return f"{host}{port}){m[3] or '/'}"


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def shown(value) -> str:
    return quote(str(value), safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%"))


def record_id(page_id, digest: str) -> str:
    """The same for the same page and payload, so a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, first, first_url, is_revisit: bool, date: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {shown(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(first, digest)}", f"WARC-Refers-To-Date: {date}", f"Refers-To-Page-ID: {first}"]
        if first_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {shown(first_url)}")
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers, and of a response its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *([0-9]+)", http)[1])
    whole = fields["warc-type"] == "response"
    if whole and len(payload) != size:
        raise ValueError("a record is cut short")
    return {"fields": fields, "payload": payload if whole else None, "size": size}


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, *, page: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Writes a record for each page; the manifest (key, page_id, file, offset, length) of all."""
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    rows = rows.select("*", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    twice = (
        rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    rows = rows.join(written(twice, "payloads"), "digest", "left").drop("bytes")
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(pieces):
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        out, made, name, at = None, [], "", 0

        def closed():
            out.close()
            columns = list(zip(*made))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"])

        for batch in pieces:
            for r in batch.to_pylist():
                if out is None:
                    name, at = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(filesystem(name)[1], compression=None)
                data = gzipped(record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["digest"], r["first"], r["first_url"], r["revisit"], date))
                out.write(data)
                made.append((capture_key(r["url"], r["page_id"]), r["page_id"], name, at, len(data)))
                at += len(data)
                if at >= FILE_BYTES:
                    yield closed()
                    out, made = None, []
        if out is not None:
            yield closed()

    return written(python_rows(rows, run, "key string, page_id long, file string, offset long, length long", text="html"), "manifest")


def build_index(manifest: DataFrame, folder: str, shards: int | None = None) -> DataFrame:
    """Shard files of sorted, compressed blocks; (first, shard, directory offset and length) of each."""
    n = min(MOST_SHARDS, shards or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = manifest.select("key", "file", "offset", "length").repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches):
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name, at, lines, directory, out, first = f"{folder}/index-{uuid.uuid4().hex}.cdx", 0, [], [], None, None

        def block():
            nonlocal at, lines
            data = zlib.compress(json.dumps(lines, separators=(",", ":")).encode())
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            at += len(data)
            lines = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, first = store.open_output_stream(filesystem(name)[1], compression=None), row[0]
                lines.append(row)
                if len(lines) >= BLOCK:
                    block()
        if out is not None:
            if lines:
                block()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())], ["first", "shard", "offset", "length"])

    return written(ordered.mapInArrow(run, "first string, shard string, offset long, length long"), "shards")


def search(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, file, offset, length) of the captures whose key is in ``keys`` (one column, ``key``)."""
    shards = sorted((r["first"], r["shard"], r["offset"], r["length"]) for r in index.limit(MOST_SHARDS).collect())
    shared = keys.sparkSession.sparkContext.broadcast(shards)

    def assign(batches):
        firsts = [s[0] for s in shared.value]
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            # a key may go on over several shards: from the last that begins before it
            spread = [(k, s) for k in wanted if firsts for s in range(max(0, bisect.bisect_left(firsts, k) - 1), max(1, bisect.bisect_right(firsts, k)))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in spread], pa.string()), pa.array([s for _, s in spread], pa.int32())], ["key", "shard"])

    def find(batches):
        number, blocks, firsts, file, held = None, [], [], None, (None, [])
        for batch in batches:
            found = []
            for key, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != number:
                    _, path, at, size = shared.value[shard]
                    store, inner = filesystem(path)
                    if file:
                        file.close()
                    file = store.open_input_file(inner)
                    blocks = json.loads(zlib.decompress(file.read_at(size, at)))
                    firsts, number, held = [b[0] for b in blocks], shard, (None, [])
                i = max(0, bisect.bisect_left(firsts, key) - 1)
                while i < len(blocks) and (firsts[i] <= key):
                    if held[0] != i:
                        held = i, json.loads(zlib.decompress(file.read_at(blocks[i][2], blocks[i][1])))
                    lines = held[1]
                    j = bisect.bisect_left(lines, [key])
                    while j < len(lines) and lines[j][0] == key:
                        found.append(lines[j])
                        j += 1
                    i += 1
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])

    placed = keys.select("key").distinct().mapInArrow(assign, "key string, shard int")
    return placed.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "key").mapInArrow(find, "key string, file string, offset long, length long")


def read_records(places: DataFrame) -> DataFrame:
    """The records at (file, offset, length), each read by its byte range; digests of what was read."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"

    def run(batches):
        name, file = None, None
        for batch in batches:
            out = []
            for path, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    store, inner = filesystem(path)
                    if file:
                        file.close()
                    name, file = path, store.open_input_file(inner)
                got = parse(zlib.decompress(file.read_at(size, at), 31))
                f, payload = got["fields"], got["payload"]
                digest = f["warc-payload-digest"].removeprefix("sha256:")
                if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"a payload in {path} at {at} does not have its digest")
                number = {k: int(f[k]) if f.get(k, "None") != "None" else None for k in ("page-id", "refers-to-page-id")}
                url = unquote(f["warc-target-uri"]) if "warc-target-uri" in f else None
                out.append((number["page-id"], url, f["warc-type"], got["size"], digest, number["refers-to-page-id"], payload.decode("utf-8", "surrogatepass") if payload is not None else None))
                if len(out) >= 200:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in schema.split(", ")])

    # small rows stand for large reads: a fixed number of partitions, each of a range of files and offsets
    places = written(places.select("file", "offset", "length"), "places")
    n = partitions_for(places.sparkSession, places.agg(F.sum("length")).first()[0] or 0, FILE_BYTES)
    return places.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = new_path(spark, "archives")
    manifest = write_archives(pages, folder)
    index = build_index(manifest, folder)
    found = read_records(search(index, manifest.select("key")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
