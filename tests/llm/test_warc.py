"""WARC: written and read back, searched through both levels of the index, cases."""

import hashlib

from pyspark.sql import functions as F

from folio.llm import warc
from folio.llm.common import new_path


def stored(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    folder = new_path(spark, "test-archives")
    manifest = warc.write_archives(pages.repartition(3), folder)
    return pages, manifest, folder


def test_every_page_comes_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    big = "<p>é😀</p>" * 30
    rows = [(i, f"http://www.h{i % 4}.example.com:{80 + i % 2}/p{i}?q=%41 x\r\ny#f", f"{big}{i % 5}", "k") for i in range(40)]
    rows += [(100, None, None, "k"), (101, "odd url", "short", "k"), (102, "http://[::1]/x", "short", "k"), (None, "http://a.b/", big + "0", "k"), (3, "http://again/", big + "3", "k"), (3, "http://again/", big + "3", "k")]
    pages, manifest, folder = stored(spark, rows)
    index = warc.build_index(manifest, folder, 4)
    got = warc.read_records(warc.search(index, manifest.select("key"))).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(i, first.get(data, i))
    want = []
    for i, url, html, _ in rows:
        data = (html or "").encode()
        lead = first.get(data, i)
        want.append((i, url and url.split("#")[0] and url, len(data), hashlib.sha256(data).hexdigest(), "response" if lead == i else "revisit", None if lead == i else lead))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=key) == sorted(want, key=key)


def test_search_finds_only_what_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 2)
    _, manifest, folder = stored(spark, [(i, f"http://x.example/{i:03d}", "body", "k") for i in range(25)])
    index = warc.build_index(manifest, folder, 3)
    wanted = [warc.capture_key(f"http://x.example/{i:03d}", i) for i in (0, 7, 24)] + ["absent", "", "zzz"]
    found = warc.search(index, spark.createDataFrame([(k,) for k in wanted], "key string"))
    assert sorted(r["page_id"] for r in warc.read_records(found).collect()) == [0, 7, 24]


def test_revisits_name_their_response():
    digest = hashlib.sha256(b"x").hexdigest()
    first = warc.parse(warc.record(3, "http://a/", b"x", digest, 3, "http://a/", False, warc.DATE))["fields"]
    again = warc.parse(warc.record(9, "http://b/", b"x", digest, 3, "http://a/", True, warc.DATE))["fields"]
    assert again["warc-refers-to"] == first["warc-record-id"] != again["warc-record-id"]
    assert again["warc-refers-to-target-uri"] == first["warc-target-uri"] and again["warc-refers-to-date"] == first["warc-date"]


def test_a_very_long_payload(spark):
    pages, manifest, folder = stored(spark, [(1, "http://x/", "y" * 20_000_000, "k"), (2, "http://x/2", "short", "k")])
    got = {r["page_id"]: r["payload_bytes"] for r in warc.read_records(manifest).collect()}
    assert got == {1: 20_000_000, 2: 5}


def test_keys():
    assert warc.url_key("HTTP://Www.Example.COM/a/B?c") == "com,example,www)/a/B?c"
    assert warc.url_key("https://a.b:8443") == "b,a:8443)/" and warc.url_key(None) == "-"


def test_empty_table(spark):
    _, manifest, folder = stored(spark, [])
    index = warc.build_index(manifest, folder, 2)
    assert warc.read_records(warc.search(index, manifest.select(F.col("key")))).count() == 0
