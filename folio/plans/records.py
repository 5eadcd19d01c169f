"""Queries of outlines, forms, metadata and protection."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import forms, graph, meta, names, outline
from folio.plans.registry import query

LINKED_SQL = "SELECT node_id, parent_id, title, lag(node_id) OVER (PARTITION BY parent_id ORDER BY ord, node_id) AS prev FROM fx_outline"


@query("outline_read", """
WITH RECURSIVE o AS (SELECT node_id, parent_id, title, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY ord, node_id) - 1 AS INT) AS ord FROM fx_outline),
w AS (SELECT node_id, title, 0 AS depth, CAST(ord AS STRING) AS path FROM o WHERE parent_id IS NULL UNION ALL SELECT o.node_id, o.title, depth + 1, path || '.' || o.ord FROM o JOIN w ON o.parent_id = w.node_id)
SELECT node_id, title, CAST(depth AS INT) AS depth, path FROM w""", "fx_outline")  # fmt: skip
def outline_read(t):
    return outline.read_outline(t.sql(LINKED_SQL)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


NAMED_SQL = "SELECT node_id, title AS name FROM fx_outline"
OLDER_SQL = "SELECT title AS name, CAST(node_id % 50 AS INT) AS page_no FROM fx_outline WHERE node_id % 3 = 0"
NEWER_SQL = "SELECT title AS name, CAST(node_id % 70 + 100 AS INT) AS page_no FROM fx_outline WHERE node_id % 2 = 0"


@query("outline_named_dest", f"SELECT node_id, o.name, coalesce(a.page_no, b.page_no) AS target_page FROM ({NAMED_SQL}) o LEFT JOIN ({OLDER_SQL}) a ON o.name = a.name LEFT JOIN ({NEWER_SQL}) b ON o.name = b.name", "fx_outline")
def outline_named_dest(t):
    return outline.resolve_dest(t.sql(NAMED_SQL), t.sql(OLDER_SQL), t.sql(NEWER_SQL))


TARGET_SQL = "SELECT node_id, parent_id, CASE WHEN node_id >= 3 THEN node_id END AS target FROM fx_outline"
PAGE_MAP_SQL = "SELECT node_id AS page, CAST(node_id + 5000 AS BIGINT) AS new_page FROM fx_outline WHERE node_id % 4 <> 1 AND node_id >= 3"


@query("outline_remap", f"""
WITH RECURSIVE m AS (SELECT node_id, parent_id, target, new_page FROM ({TARGET_SQL}) t LEFT JOIN ({PAGE_MAP_SQL}) p ON t.target = p.page),
u AS (SELECT node_id, parent_id AS ancestor, 1 AS distance FROM m WHERE parent_id IS NOT NULL UNION ALL SELECT u.node_id, m.parent_id, distance + 1 FROM u JOIN m ON u.ancestor = m.node_id WHERE m.parent_id IS NOT NULL),
k AS (SELECT node_id FROM m WHERE new_page IS NOT NULL UNION SELECT m.node_id FROM m WHERE target IS NULL AND node_id IN (SELECT ancestor FROM u JOIN m ON u.node_id = m.node_id WHERE new_page IS NOT NULL))
SELECT m.node_id, (SELECT min_by(ancestor, distance) FROM u WHERE u.node_id = m.node_id AND ancestor IN (FROM k)) AS new_parent, new_page FROM m WHERE m.node_id IN (FROM k)""", "fx_outline")  # fmt: skip
def outline_remap(t):
    return outline.remap_outline(t.sql(TARGET_SQL), t.sql(PAGE_MAP_SQL))


DOC_OUTLINE_SQL = "SELECT CASE WHEN node_id < 100 THEN node_id ELSE node_id % 5 END AS doc_id, node_id, CASE WHEN node_id >= 1000 THEN parent_id END AS parent_id, title FROM fx_outline WHERE node_id >= 100"
INPUTS_SQL = "SELECT CAST(node_id AS BIGINT) AS doc_id, title, CAST(node_id * 10 + 1 AS INT) AS first_seq FROM fx_outline WHERE node_id < 100"


@query("outline_merge", f"SELECT doc_id, CAST(-1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, title, first_seq AS target FROM ({INPUTS_SQL}) UNION ALL SELECT doc_id, node_id, coalesce(parent_id, -1), title, NULL FROM ({DOC_OUTLINE_SQL})", "fx_outline")
def outline_merge(t):
    return outline.merge_outlines(t.sql(DOC_OUTLINE_SQL), t.sql(INPUTS_SQL))


OPEN_SQL = "SELECT node_id, parent_id, ord, node_id % 3 <> 1 AS is_open FROM fx_outline"


@query("outline_links", f"""
WITH RECURSIVE o AS ({OPEN_SQL}),
u AS (SELECT node_id, parent_id AS ancestor FROM o WHERE parent_id IS NOT NULL UNION ALL SELECT u.node_id, o.parent_id FROM u JOIN o ON u.ancestor = o.node_id WHERE o.parent_id IS NOT NULL AND o.is_open),
l AS (SELECT node_id, is_open, lag(node_id) OVER w AS prev, lead(node_id) OVER w AS next FROM o WINDOW w AS (PARTITION BY parent_id ORDER BY ord, node_id))
SELECT l.node_id, prev, next, (SELECT min_by(c.node_id, c.ord) FROM o c WHERE c.parent_id = l.node_id) AS first, (SELECT max_by(c.node_id, c.ord) FROM o c WHERE c.parent_id = l.node_id) AS last,
 CASE WHEN is_open THEN 1 ELSE -1 END * (SELECT count(*) FROM u WHERE ancestor = l.node_id) AS count FROM l""", "fx_outline")  # fmt: skip
def outline_links(t):
    return outline.link_outline(t.sql(OPEN_SQL))


FIELDS_SQL = "SELECT c.doc_id, c.node_id, concat(p.t, '.', c.t) AS name, coalesce(c.ft, p.ft) AS ft, coalesce(c.ff, p.ff) AS ff, c.v, c.max_len FROM fx_fields c JOIN fx_fields p ON c.parent_id = p.node_id"
TYPED_SQL = f"""SELECT *, CASE ft WHEN 'Tx' THEN 'text' WHEN 'Ch' THEN CASE WHEN coalesce(ff, 0) & 131072 <> 0 THEN 'combo' ELSE 'list' END WHEN 'Sig' THEN 'signature'
 WHEN 'Btn' THEN CASE WHEN coalesce(ff, 0) & 65536 <> 0 THEN 'button' WHEN coalesce(ff, 0) & 32768 <> 0 THEN 'radio' ELSE 'checkbox' END END AS type, coalesce(ff, 0) & 1 <> 0 AS read_only, coalesce(ff, 0) & 2 <> 0 AS required, coalesce(ff, 0) & 4096 <> 0 AS multiline, coalesce(ff, 0) & 8192 <> 0 AS password FROM ({FIELDS_SQL})"""


def typed(t):
    return forms.field_type(forms.read_fields(t.fx_fields))


@query("form_fields", FIELDS_SQL, "fx_fields")
def form_fields(t):
    return forms.read_fields(t.fx_fields)


@query("form_type", f"SELECT node_id, type, read_only, required, multiline, password FROM ({TYPED_SQL})", "fx_fields")
def form_type(t):
    return typed(t).select("node_id", "type", "read_only", "required", "multiline", "password")


PLACED_SQL = "SELECT node_id, doc_id, x0, y0, x1, y1, hidden, coalesce(listed_page, own_page) AS page_no FROM fx_widgets WHERE coalesce(listed_page, own_page) IS NOT NULL"


@query("form_widget_page", f"SELECT node_id, page_no FROM ({PLACED_SQL})", "fx_widgets")
def form_widget_page(t):
    return forms.place_widgets(t.fx_widgets).select("node_id", "page_no")


@query("form_rect", f"SELECT node_id, page_no, least(x0, x1) AS dx, 792 - greatest(y0, y1) AS dy, abs(x1 - x0) AS dw, abs(y1 - y0) AS dh FROM ({PLACED_SQL})", "fx_widgets")
def form_rect(t):
    return forms.widget_rects(forms.place_widgets(t.fx_widgets))


VALUES_SQL = "SELECT doc_id, name, max(CASE WHEN node_id % 2 = 0 THEN 'Yes' ELSE concat('value of ', name) END) AS value FROM fields WHERE node_id % 3 <> 0 GROUP BY doc_id, name"


@query("form_fill", f"""
WITH f AS ({TYPED_SQL}), g AS ({VALUES_SQL.replace('FROM fields', 'FROM f')})
SELECT node_id, f.name, CASE WHEN value IS NOT NULL AND NOT read_only THEN CASE WHEN type IN ('text', 'combo', 'list') THEN CASE WHEN max_len > 0 THEN substr(value, 1, max_len) ELSE value END
 WHEN type = 'checkbox' THEN CASE WHEN value IN ('true', 'on', 'Yes') THEN 'Yes' ELSE 'Off' END WHEN type = 'radio' THEN value ELSE v END ELSE v END AS v FROM f LEFT JOIN g ON f.doc_id = g.doc_id AND f.name = g.name""", "fx_fields")  # fmt: skip
def form_fill(t):
    fields = typed(t)
    return forms.fill(fields, t.spark.sql(VALUES_SQL.replace("FROM fields", "FROM {fields}"), fields=fields)).select("node_id", "name", "v")


@query("form_display", f"SELECT node_id, CASE WHEN type IN ('combo', 'list') THEN CASE WHEN node_id % 2 = 0 THEN concat('label ', node_id) ELSE v END WHEN password THEN repeat('•', length(v)) ELSE v END AS shown FROM ({TYPED_SQL})", "fx_fields")
def form_display(t):
    value = F.when(F.col("node_id") % 2 == 0, F.col("v")).otherwise(F.lit("another"))
    options = F.array(F.struct(F.lit("none").alias("value"), F.lit("None").alias("label")), F.struct(value.alias("value"), F.concat(F.lit("label "), F.col("node_id").cast("string")).alias("label")))
    return forms.display_value(typed(t).withColumn("options", options)).select("node_id", "shown")


@query("form_flatten", f"""
SELECT 'run' AS what, w.doc_id, page_no, x0 AS x, y0 AS y, v AS str FROM ({PLACED_SQL}) w JOIN ({FIELDS_SQL}) f ON w.node_id = f.node_id WHERE NOT hidden AND v <> ''
UNION ALL SELECT 'run', doc_id, page_no, x, y, str FROM fx_runs
UNION ALL SELECT 'annot', doc_id, CAST(node_id % 4 AS INT), 0, 0, t FROM fx_fields WHERE node_id NOT IN (SELECT node_id FROM ({PLACED_SQL}))""", "fx_widgets", "fx_runs")  # fmt: skip
def form_flatten(t):
    annots = t.fx_fields.select("node_id", "doc_id", (F.col("node_id") % 4).cast("int").alias("page_no"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("t").alias("str"))
    runs, left = forms.flatten(forms.read_fields(t.fx_fields), forms.place_widgets(t.fx_widgets), t.fx_runs, annots)
    return runs.select(F.lit("run").alias("what"), "*").unionByName(left.select(F.lit("annot").alias("what"), "doc_id", "page_no", "x", "y", "str"))


#: Top fields by outputs that follow the table; stems, some with a number that others will want.
NAMES_SQL = """SELECT CAST(floor(o_custkey / 20) AS BIGINT) AS out_id, o_custkey AS doc_id, o_orderkey AS node_id,
  concat('field', CAST(o_orderkey % 3 AS STRING), CASE o_orderkey % 7 WHEN 1 THEN concat('_', CAST(2 + o_orderkey % 5 AS STRING)) WHEN 3 THEN concat('_2_', CAST(2 + o_orderkey % 2 AS STRING)) WHEN 5 THEN '_02' ELSE '' END) AS t FROM orders"""


@query("form_merge_names", f"""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY out_id ORDER BY doc_id, node_id) AS arrival FROM ({NAMES_SQL.replace('STRING', 'VARCHAR')})),
w AS (SELECT out_id, arrival, node_id, t AS name, [t] AS used FROM a WHERE arrival = 1
 UNION ALL SELECT out_id, arrival, node_id, name, list_append(used, name) FROM (
  SELECT a.out_id, a.arrival, a.node_id, w.used, CASE WHEN list_contains(w.used, a.t) THEN concat(a.t, '_', list_min(list_filter(range(2, len(w.used) + 3), lambda k: NOT list_contains(w.used, concat(a.t, '_', k))))) ELSE a.t END AS name
  FROM w JOIN a ON a.out_id = w.out_id AND a.arrival = w.arrival + 1))
SELECT out_id, node_id, name FROM w""")  # fmt: skip
def form_merge_names(t):
    return names.dedupe_names(names.arrivals(t.sql(NAMES_SQL)))


@query("form_on_page", f"SELECT node_id, name FROM ({FIELDS_SQL}) WHERE node_id IN (SELECT node_id FROM ({PLACED_SQL}) WHERE page_no IN (1, 3))", "fx_widgets")
def form_on_page(t):
    widgets = forms.place_widgets(t.fx_widgets)
    pages = widgets.select("doc_id", "page_no").distinct().where("page_no IN (1, 3)")
    return forms.keep_included(forms.read_fields(t.fx_fields), widgets, pages).select("node_id", "name")


def documents(t):
    info = F.create_map(*[x for k in ("title", "lang", "charset", "url") for x in (F.lit(k), F.col(k))])
    return t.fx_meta.select("doc_id", info.alias("info"), "xmp", "has_id")


PAIRS_SQL = " UNION ALL ".join(f"SELECT doc_id, xmp, has_id, '{k}' AS key, {k} AS value FROM fx_meta WHERE {k} <> ''" for k in ("title", "lang", "charset", "url"))


@query("meta_read", PAIRS_SQL, "fx_meta")
def meta_read(t):
    return meta.read_meta(documents(t))


@query("meta_set", """
SELECT doc_id, concat_ws('|', 'ModDate=D:2024', CASE WHEN charset <> '' THEN 'charset=' || charset END, CASE WHEN lang <> '' AND doc_id % 2 <> 0 THEN 'lang=' || lang END, CASE WHEN doc_id % 2 = 0 THEN 'title=new' WHEN title <> '' THEN 'title=' || title END, CASE WHEN url <> '' THEN 'url=' || url END) AS info, FALSE AS xmp, has_id FROM fx_meta""", "fx_meta")  # fmt: skip
def meta_set(t):
    docs = documents(t)
    changes = docs.where("doc_id % 2 = 0").select("doc_id", F.create_map(F.lit("title"), F.lit("new"), F.lit("lang"), F.lit("")).alias("changes"))
    done = meta.set_meta(docs, changes, "D:2024")
    return done.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("info"), "xmp", "has_id")


@query("meta_wipe", "SELECT doc_id, 0 AS n, FALSE AS xmp, FALSE AS has_id FROM fx_meta", "fx_meta")
def meta_wipe(t):
    return meta.scrub(documents(t)).select("doc_id", F.size("info").alias("n"), "xmp", "has_id")


def annots(t):
    attrs = F.create_map(F.lit("T"), F.lit("who"), F.lit("M"), F.lit("when"), F.lit("Popup"), F.lit("p"), F.lit("A"), F.col("target"))
    return t.fx_annots.withColumn("subtype", F.when(F.col("ord") % 3 == 0, "Widget").otherwise(F.col("subtype"))).withColumn("attrs", attrs)


@query("meta_scrub_annots", """
SELECT doc_id, ord, subtype, CASE WHEN subtype = 'Widget' THEN 'A=' || target || '|T=who' ELSE 'A=' || target END AS attrs FROM (SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN 'Widget' ELSE subtype END AS subtype, target FROM fx_annots) WHERE subtype IN ('Link', 'Widget')""", "fx_annots")  # fmt: skip
def meta_scrub_annots(t):
    done = meta.scrub_annots(annots(t))
    return done.select("doc_id", "ord", "subtype", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("attrs"))


@query("meta_comment_count", "SELECT doc_id, CAST(sum(CASE WHEN subtype IN ('Link', 'Widget') THEN 0 ELSE 1 END) AS BIGINT) AS comments FROM fx_annots GROUP BY doc_id", "fx_annots")
def meta_comment_count(t):
    return meta.comment_count(t.fx_annots)


@query("meta_leak_report", f"""
SELECT doc_id, CASE key WHEN 'title' THEN 'Title' WHEN 'lang' THEN 'Language' WHEN 'charset' THEN 'Encoding' ELSE 'Address' END AS label, value FROM ({PAIRS_SQL})
UNION ALL SELECT doc_id, 'XMP data', 'yes' FROM fx_meta WHERE xmp UNION ALL SELECT doc_id, 'Document ID', 'yes' FROM fx_meta WHERE has_id""", "fx_meta")  # fmt: skip
def meta_leak_report(t):
    return meta.leak_report(documents(t))


@query("meta_date", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN CAST(date_trunc('month', ts) AS TIMESTAMP) ELSE date_trunc('second', ts) END AS at FROM events")
def meta_date(t):
    shown = F.when(F.col("event_id") % 7 == 0, F.lit("unknown")).when(F.col("event_id") % 3 == 0, F.date_format("ts", "'D:'yyyyMM")).otherwise(F.date_format("ts", "'D:'yyyyMMddHHmmss'+01'"))
    return t.events.select("event_id", meta.parse_doc_date(shown).alias("at"))


@query("sec_encrypt_roundtrip", "SELECT doc_id, md5(text) AS plain, TRUE AS ok, FALSE AS wrong_ok FROM documents")
def sec_encrypt_roundtrip(t):
    locked = meta.protect(t.documents.select("doc_id", "text"), "secret")
    right = meta.unlock(locked, "secret").select("doc_id", "cipher", F.md5("plain").alias("right"), F.col("ok").alias("right_ok"))
    return meta.unlock(right, "guess").select("doc_id", F.col("right").alias("plain"), F.col("right_ok").alias("ok"), F.col("ok").alias("wrong_ok"))


@query("sec_is_protected", "SELECT doc_id, bool_or(type = 'purchase' AND value > 90) AS found FROM fx_objects GROUP BY doc_id", "fx_objects")
def sec_is_protected(t):
    return graph.has_key(t.fx_objects, (F.col("type") == "purchase") & (F.col("value") > 90))


@query("sec_digest", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def sec_digest(t):
    return meta.digests(t.documents).select("doc_id", "md5", "sha256")


@query("sec_digest_all")
def sec_digest_all(t):
    return meta.digests(t.documents).select("doc_id", "sha384", "sha512", "crc32")


@query("sec_permissions", """
SELECT p_partkey, CAST(-3904 | (CASE WHEN p_size % 2 = 0 THEN 4 ELSE 0 END) | (CASE WHEN p_size % 3 = 0 THEN 8 ELSE 0 END) | (CASE WHEN p_size % 5 = 0 THEN 16 ELSE 0 END) | 32 | 256 | 512 | 1024
 | (CASE WHEN p_size % 2 = 0 AND p_size % 7 <> 0 THEN 2048 ELSE 0 END) AS INT) AS bits FROM part""")  # fmt: skip
def sec_permissions(t):
    size = F.col("p_size")
    return t.part.select("p_partkey", meta.perm_bits({"print": size % 2 == 0, "modify": size % 3 == 0, "copy": size % 5 == 0, "printHigh": size % 7 != 0}).alias("bits"))


@query("sec_strength", """
SELECT c_custkey, CASE WHEN length(p) < 6 THEN 0 ELSE CAST((length(p) >= 8)::INT + (length(p) >= 12)::INT + (regexp_matches(p, '[a-z]') AND regexp_matches(p, '[A-Z]'))::INT + (regexp_matches(p, '[0-9]') AND regexp_matches(p, '[^A-Za-z0-9]'))::INT AS INT) END AS score
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name WHEN 2 THEN CAST(c_custkey AS STRING) ELSE lower(c_mktsegment) END AS p FROM customer)""")  # fmt: skip
def sec_strength(t):
    kind = F.col("c_custkey") % 4
    return t.customer.select("c_custkey", meta.password_score(F.when(kind == 0, F.col("c_mktsegment")).when(kind == 1, F.col("c_name")).when(kind == 2, F.col("c_custkey").cast("string")).otherwise(F.lower("c_mktsegment"))).alias("score"))
