"""Known values and invariants of single operators."""

import pytest
from pyspark.sql import functions as F

from folio.functions.columns import lenient
from folio.operators import assembly, graph, layout, masks, meta, names, outline, pages, place, raster, search
from folio.operators import text as tx


def image(spark, w, h, color="255 AS r, 255 AS g, 255 AS b, 255 AS a"):
    return spark.sql(f"SELECT 1 AS image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {color} FROM (SELECT explode(sequence(0, {w - 1})) AS x) CROSS JOIN (SELECT explode(sequence(0, {h - 1})) AS y)")


@pytest.mark.parametrize("spec,want", [("1-3, 5", [(1, 3), (5, 5)]), ("2", [(2, 2)]), (" 4 - 6 ", [(4, 6)]), ("0", None), ("3-1", None), ("9", None), ("x", None), ("", None), ("1,,2", None)])
def test_range_parse(spark, spec, want):
    rows = pages.parse_ranges(spark.createDataFrame([(1, spec, 8)], "doc_id long, spec string, total int")).orderBy("ord").collect()
    if want is None:
        assert any(r["error"] for r in rows)
    else:
        assert [(r["from_page"], r["to_page"]) for r in rows] == want and not any(r["error"] for r in rows)


def test_split_then_merge_returns_the_pages(spark):
    p = spark.range(1, 10).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_no"))
    parts = assembly.split_every(p, 4)
    assert [r["page_no"] for r in parts.orderBy("out_id", "page_no").collect()] == list(range(1, 10))
    assert parts.groupBy("out_id").count().orderBy("out_id").collect()[-1]["count"] == 1


def test_four_turns_are_identity(spark):
    shapes = spark.createDataFrame([(1, "rect", 3.0, 5.0, 20.0, 8.0, 0), (2, "stamp", 30.0, 50.0, 20.0, 8.0, 0)], "shape_id int, t string, x double, y double, w double, h double, rot int")
    turned = shapes
    for w, h in ((600, 800), (800, 600)) * 2:
        turned = place.turn(turned, w, h)
    assert turned.orderBy("shape_id").collect() == shapes.orderBy("shape_id").collect()
    px = image(spark, 3, 2, "x * 10 + y AS r, 0 AS g, 0 AS b, 255 AS a")
    again = px
    for _ in range(4):
        again = raster.turn_px(again)
    assert sorted(map(tuple, again.select(*px.columns).collect())) == sorted(map(tuple, px.collect()))


def test_mask_areas(spark):
    g = image(spark, 10, 10).select("image_id", "x", "y")
    area = lambda m: m.where("m = 255").count()
    assert area(masks.mask_rect(g, 2, 3, 5, 4)) == 20
    assert area(masks.mask_rect(g, -5, -5, 50, 50)) == 100
    assert area(masks.mask_rect(g, 7, 7, -5, -4)) == 20
    assert area(masks.mask_ellipse(g, 0, 0, 0.5, 9)) == 0


def test_flood_stops_at_a_wall(spark):
    px = image(spark, 10, 10, "CASE WHEN x = 3 THEN 0 ELSE 255 END AS r, 255 AS g, 255 AS b, 255 AS a")
    seeds = spark.createDataFrame([(1, 0, 0)], "image_id int, sx int, sy int")
    assert masks.flood(px, seeds, 10).where("m = 255").count() == 30
    assert masks.similar(px, seeds, 10).where("m = 255").count() == 90


def test_outline_of_a_square_has_four_segments(spark):
    m = masks.mask_rect(image(spark, 6, 6).select("image_id", "x", "y"), 1, 1, 3, 3)
    assert sorted(map(tuple, masks.outline(m).select("x1", "y1", "x2", "y2").collect())) == [(1, 1, 1, 4), (1, 1, 4, 1), (1, 4, 4, 4), (4, 1, 4, 4)]


def test_invert(spark):
    px = image(spark, 1, 1, "100 AS r, 150 AS g, 200 AS b, 255 AS a")
    assert tuple(raster.adjust(px, invert=100).select("r", "g", "b").first()) == (155, 105, 55)
    assert raster.adjust(px) is px


def test_saturation_of_grey_is_grey_and_hue_turns_red_to_green(spark):
    grey = image(spark, 1, 1, "90 AS r, 90 AS g, 90 AS b, 255 AS a")
    assert tuple(raster.adjust(grey, saturation=80).select("r", "g", "b").first()) == (90, 90, 90)
    red = image(spark, 1, 1, "255 AS r, 0 AS g, 0 AS b, 255 AS a")
    assert tuple(raster.adjust(red, hue=120).select("r", "g", "b").first()) == (0, 255, 0)


def test_content_margins(spark):
    px = image(spark, 10, 10, "CASE WHEN x BETWEEN 3 AND 7 AND y BETWEEN 2 AND 5 THEN 0 ELSE 255 END AS r, 255 AS g, 255 AS b, 255 AS a")
    got = place.content_margins(px, pad=0).first()
    assert [round(got[k], 6) for k in "ltrb"] == [0.3, 0.2, 0.2, 0.4]
    assert tuple(place.content_margins(image(spark, 4, 4)).select(*"ltrb").first()) == (0, 0, 0, 0)


def test_names_after_a_merge(spark):
    rows = spark.createDataFrame([(1, 1, 1, "name"), (1, 2, 2, "name"), (1, 3, 3, "name_2"), (1, 4, 4, "name"), (1, 5, 5, "other")], "out_id int, arrival int, node_id int, t string")
    got = {r["node_id"]: r["name"] for r in names.dedupe_names(rows).collect()}
    assert len(set(got.values())) == 5 and got[1] == "name" and got[2] == "name_2" and got[5] == "other"


def test_kerned_fragments_join(spark):
    runs = spark.createDataFrame([(1, 1, 1, 10, 0, 18, 10, 10, "Quar", 0.0), (1, 1, 2, 10, 18, 24, 10, 10, "terly", 0.0), (1, 1, 3, 11, 46, 36, 10, 10, "Report", 0.0)], "doc_id int, page_no int, run_id int, y int, x int, w int, h int, size int, str string, rot double")
    assert [r["text"] for r in tx.join_runs(tx.group_lines(runs)).collect()] == ["Quarterly Report"]


def test_reflow(spark):
    text = "The quick hyphen-\nated word\nwraps here.\nNew sentence\n\nPara"
    assert spark.range(1).select(tx.reflow(F.lit(text))).first()[0] == "The quick hyphenated word wraps here.\nNew sentence\n\nPara"


def test_no_match_is_left_after_redaction(spark):
    df = spark.createDataFrame([(1, "Write to a.b@c.example or +1 (743) 555-3824, ref 123456."), (2, None), (3, "")], "doc_id int, text string")
    blank = df.withColumn("text", search.redact_text(F.col("text"), ["email", "phone", "number"]))
    assert search.find_pii(blank, ["email", "phone", "number"]).count() == 0
    assert len(blank.where("doc_id = 1").first()["text"]) == len(df.first()["text"])


def test_search_is_lenient(spark):
    df = spark.createDataFrame([(1, "one  two\nthree")], "doc_id int, text string")
    assert search.find(df, "").count() == 0 and search.find(df, "(").count() == 0 and lenient("[") is None
    assert search.find(df, search.literal_pattern("TWO three")).first()["start"] == 5
    assert search.find(df, search.literal_pattern("  ")).count() == 0


def test_wrap_is_greedy(spark):
    got = spark.range(1).select(layout.wrap(F.lit("aa bb cc dd\nlongword x"), 5)).first()[0]
    assert got == ["aa bb", "cc dd", "longword", "x"]


def test_permissions(spark):
    got = spark.range(1).select(meta.perm_bits({}), meta.perm_bits({"print": F.lit(False)}), meta.perm_bits({"copy": F.lit(False)})).first()
    assert list(got) == [-4, -2056, -20]


def test_wrong_password_is_an_error_of_the_row(spark):
    df = spark.createDataFrame([(1, "secret text")], "doc_id int, text string")
    locked = meta.protect(df, "pw")
    assert meta.unlock(locked, "pw").first()["plain"] == "secret text"
    assert meta.unlock(locked, "other").first()["ok"] is False


def test_plans_have_no_python_and_no_cartesian_product(spark, data):
    from folio.plans.all import QUERIES

    for name in ("search_presets", "asm_merge", "redact_regions", "shape_hit", "px_blur"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name


def test_damaged_outlines_end(spark):
    nodes = [(1, None, None), (2, None, 1), (3, None, 4), (4, None, 3), (5, None, 4)]
    df = spark.createDataFrame(nodes, "node_id long, parent_id long, prev long")
    assert sorted(map(tuple, outline.sibling_ranks(df).collect())) == [(1, 0), (2, 1)]
    tree = [(1, None), (2, 1), (3, 4), (4, 3), (5, 4)]
    rows = spark.createDataFrame(tree, "node_id long, parent_id long").selectExpr("*", "node_id AS target", "node_id AS ord", "true AS is_open")
    pages = spark.createDataFrame([(i, i + 10) for i in range(1, 6)], "page long, new_page long")
    assert sorted(map(tuple, outline.remap_outline(rows, pages).collect())) == [(1, None, 11), (2, 1, 12)]
    assert {r["node_id"]: r["count"] for r in outline.link_outline(rows).collect() if r["node_id"] < 3} == {1: 1, 2: 0}


def test_a_chain_of_ten_thousand_outline_nodes(spark):
    n = 10_000
    chain = spark.range(1, n + 1).selectExpr("id AS node_id", "nullif(id - 1, 0) AS parent_id", "nullif(id - 1, 0) AS prev", "id AS ord", "true AS is_open", "id AS target")
    assert outline.sibling_ranks(chain).agg({"rank": "max"}).first()[0] == n - 1
    counts = {r["node_id"]: r["count"] for r in outline.link_outline(chain).collect()}
    assert counts == {i: n - i for i in range(1, n + 1)}
    pages = spark.createDataFrame([(1, 7), (n, 9)], "page long, new_page long")
    assert sorted(map(tuple, outline.remap_outline(chain, pages).collect())) == [(1, None, 7), (n, 1, 9)]


def test_many_clashing_names(spark):
    rows = spark.range(20_000).selectExpr("1 AS out_id", "id AS node_id", "id AS arrival", "if(id = 5, 'name_7', 'name') AS t")
    got = {r["node_id"]: r["name"] for r in names.dedupe_names(rows).collect()}
    assert len(set(got.values())) == 20_000 and got[0] == "name" and got[1] == "name_2" and got[5] == "name_7" and got[7] == "name_8"


def test_unknown_blend_mode_is_an_error(spark):
    row = "1 AS image_id, 0 AS x, 0 AS y, {v} AS r, {v} AS g, {v} AS b, 255 AS a, {z} AS z, 1D AS opacity, '{m}' AS blend, false AS hidden"
    two = lambda m: spark.sql("SELECT " + row.format(v=100, z=0, m="normal") + " UNION ALL SELECT " + row.format(v=200, z=1, m=m))
    assert raster.composite(two("overlay")).first()["r"] == 157
    with pytest.raises(Exception, match="unknown blend mode"):
        raster.composite(two("dissolve")).collect()


DATES = {
    "D:20240102153000+01'00'": "2024-01-02 15:30:00", "D:2024": "2024-01-01 00:00:00", "D:20241332": "2025-02-01 00:00:00", "D:20230229": "2023-03-01 00:00:00",
    "D:20240000256161": "2024-01-02 02:02:01", "D:0099": "1999-01-01 00:00:00", "x": None,
}


def test_dates_roll_over(spark):
    rows = spark.createDataFrame([(s,) for s in [*DATES, None]], "s string")
    found = rows.select("s", meta.parse_doc_date(F.col("s")).cast("string").alias("at")).collect()
    assert {r["s"]: r["at"] for r in found} == DATES | {None: None}


def test_short_paths_stay_as_they_are(spark):
    rows = spark.sql("SELECT array(struct(1.0D AS x, 2.0D AS y)) AS p UNION ALL SELECT array(struct(1.0D AS x, 2.0D AS y), struct(3.0D AS x, 5.0D AS y))")
    assert all(r["p"] == r["q"] for r in rows.select("p", place.smooth(F.col("p")).alias("q")).collect())


def test_characters_have_their_own_advances(spark):
    df = spark.createDataFrame([(1, "iiiW"), (2, "Ünï é"), (3, "字\t?")], "doc_id int, text string")
    of = lambda table: {r["doc_id"]: r["width"] for r in layout.text_width(df, table, 1000.0).collect()}
    assert of(layout.widths(spark, ord)) == {1: 3 * 105 + 87, 2: 220 + 110 + 239 + 32 + 233, 3: 63 + 63}
    assert of(layout.face_widths(spark, "sans")) == {1: 3 * 222 + 944, 2: 722 + 556 + 278 + 278 + 556, 3: 556 + 556}
    assert of(layout.face_widths(spark, "fixed"))[1] == 2400
    assert len(layout.advances("serif")) == len(layout.advances("fixed"))


def test_wrapping_by_measured_width(spark):
    texts = ["iiii iiii WWWW WWWW", "  lead in", "averyveryverylongword x", "", "a\n\nb c", "end  "]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    advance = layout.advances("sans")
    got = {r["n"]: r["l"] for r in df.select("n", layout.wrap_measured(F.col("text"), 40.0, 10.0, advance).alias("l")).collect()}

    def plain(text):
        import re

        wide = lambda s: sum(advance.get(c, advance["?"]) for c in s) / 100
        out = []
        for para in text.split("\n"):
            line = ""
            for token in filter(None, re.split(r"(\s+)", para)):
                if line and wide((line + token).rstrip()) > 40:
                    out.append(line.rstrip())
                    line = token.lstrip()
                else:
                    line += token
            out.append(line)
        return out

    assert got == {n: plain(t) for n, t in enumerate(texts)}


def test_containers_become_equal_when_references_are_repaired(spark):
    same = "x" * 70
    objects = spark.createDataFrame([(1, same, "a"), (2, same, "a"), (3, same, "b"), (4, "short", "a"), (5, "short", "a"), (10, "c" * 64, "k"), (11, "c" * 64, "k"), (12, "c" * 64, "k"), (20, "d" * 64, "k"), (21, "d" * 64, "k")], "object_id long, data string, attrs string")
    refs = spark.createDataFrame([(10, "p", 1), (11, "p", 2), (12, "p", 3), (20, "q", 10), (21, "q", 11), (20, "q", 4), (21, "q", 4), (10, "lost", 99), (11, "lost", 99), (4, "up", 21)], "src long, slot string, dst long")
    keepers, repaired = graph.dedupe_objects(objects, refs, ["attrs"])
    assert {r[0]: r[1] for r in keepers.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 10: 10, 11: 10, 12: 12, 20: 20, 21: 20}
    assert sorted(map(tuple, repaired.collect())) == [(4, "up", 20), (10, "lost", 99), (10, "p", 1), (12, "p", 3), (20, "q", 4), (20, "q", 10)]


def test_a_report_shows_the_first_hits_in_page_order(spark):
    docs = spark.createDataFrame([(1, "\n".join(["ta tb"] * 130)), (2, "none"), (3, "tc"), (4, None)], "doc_id long, text string")
    matches = search.find_on_pages(search.page_bodies(docs), "t[a-e]")
    hits = search.first_hits(matches)
    assert "WindowGroupLimit" in hits._jdf.queryExecution().executedPlan().toString()
    shown = sorted((r["doc_id"], r["hit_no"], r["page_no"], r["match"]) for r in hits.collect())
    assert len(shown) == 201 and shown[79:82] == [(1, 80, 1, "tb"), (1, 81, 2, "ta"), (1, 82, 2, "tb")] and shown[199][2] == 3
    assert {r["doc_id"]: (r["hits"], r["pages"], r["status"]) for r in search.hit_status(docs, matches).collect()} == {1: (260, 4, "260 matches"), 2: (0, 0, "No matches"), 3: (1, 1, "1 match"), 4: (0, 0, "No matches")}
    assert {(r["doc_id"], r["page_no"]): r["hits"] for r in search.page_hits(matches).collect()} == {(1, 1): 80, (1, 2): 80, (1, 3): 80, (1, 4): 20, (3, 1): 1}


def test_text_of_lines_takes_one_exchange(spark, data):
    from folio.plans.all import QUERIES

    plan = QUERIES["text_join"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_digests_of_known_texts(spark):
    df = spark.createDataFrame([(1, "123456789"), (2, "")], "doc_id int, text string")
    rows = {r["doc_id"]: r.asDict() for r in meta.digests(df).collect()}
    assert rows[1]["crc32"] == 3421780262 and rows[1]["md5"] == "25f9e794323b453885f5181f1b624d0b"
    assert rows[2]["sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert rows[2]["sha384"].startswith("38b060a751ac96384cd9327eb1b1e36a21fdb71114be0743") and rows[2]["sha512"].startswith("cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce")


def test_bytes_round_exact_halves_to_even(spark):
    from folio.functions.columns import format_bytes

    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([1023, 8448, 8704, 151040, 152064, 1048576 * 9 // 8, 1048576 * 11 // 8])], "i int, n long")
    assert [r["s"] for r in sizes.select("i", format_bytes(F.col("n")).alias("s")).orderBy("i").collect()] == ["1023 B", "8.2 KB", "8.5 KB", "148 KB", "148 KB", "1.12 MB", "1.38 MB"]


def test_saturation_divides_by_two_less_each_end(spark):
    # tones of a pixel for which (2 - top) - low and 2 - (top + low) differ by a bit
    tones = spark.range(256).crossJoin(spark.range(256).withColumnRenamed("id", "low")).where("id > low AND id + low > 255")
    px = tones.select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("x"), F.col("low").cast("int").alias("y"), F.col("id").cast("double").alias("r"), F.col("low").cast("double").alias("g"), F.col("low").cast("double").alias("b"))
    for row in raster.to_hsl(px).collect():
        top, low = row["r"] / 255, row["g"] / 255
        assert row["sat"] == (top - low) / (2 - top - low)


@pytest.mark.parametrize("name", ["text_lines", "text_join", "text_rotated_tail", "align_text", "text_unit_merge"])
def test_pages_in_one_row_are_neither_sorted_nor_exchanged(spark, data, name):
    from folio.plans.all import QUERIES

    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    # the texts are dealt once, before they become runs
    assert plan.count("Exchange") == 1
    assert not any(step in plan for step in ("Window", "Sort ", "HashAggregate", "SortAggregate"))


def test_whole_texts_explode_no_runs(spark, data):
    from folio.plans.all import QUERIES

    plan = QUERIES["sink_text"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list(struct(line0" not in plan


def test_page_previews_collect_no_runs(spark, data):
    from folio.plans.all import QUERIES

    assert "collect_list" not in QUERIES["page_preview"](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_running_values_of_long_lists(spark):
    from folio.functions.columns import running

    made = spark.range(1).select(*[running(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, b: a + b).alias(f"s{n}") for n in (1, 32, 33, 200)], running(F.array(*[F.lit(v) for v in [3, 9, 2] * 40]), F.lit(None).cast("int"), F.greatest).alias("most")).collect()[0]
    for n in (1, 32, 33, 200):
        assert made[f"s{n}"] == [i * (i + 1) // 2 for i in range(n)]
    assert made["most"] == [None, 3] + [9] * 118


GLYPH_PAGE = "array<struct<line0:int,word0:int,g_no:int,s:string,x:int,w:int,base:int,size:int>>"


def test_character_index_of_words_is_that_of_their_glyphs(spark):
    # on the second page two words run into each other, so their glyphs are read in turns
    apart, mixed = [(0, 0, 0, "far", 50, 6, 40, 10), (0, 1, 0, "er", 74, 6, 40, 10), (0, 2, 0, "𝄞x", 86, 6, 40, 10), (1, 0, 0, "the", 50, 6, 52, 10)], [(0, 0, 0, "ace", 50, 10, 40, 10), (0, 1, 0, "bd", 55, 10, 40, 10), (0, 2, 0, "er", 90, 6, 40, 10)]
    single = lambda page: [(line, word, g, c, x + g * w, w, base, size) for line, word, _, s, x, w, base, size in page for g, c in enumerate(s)]
    rows = [(1, 1, apart), (1, 2, mixed), (2, 1, single(apart)[::-1]), (2, 2, single(mixed)[::-1])]
    index = tx.char_index(spark.createDataFrame(rows, f"doc_id int, page_no int, glyphs {GLYPH_PAGE}"))
    texts = {(r["doc_id"], r["page_no"]): r["text"] for r in tx.search_text(index).collect()}
    assert texts == {(1, 1): "far er𝄞x the", (1, 2): "abcde er", (2, 1): "far er𝄞x the", (2, 2): "abcde er"}
    boxes = {tuple(r) for r in search.find_boxes(index, "er[^a-z]x the?|bc").collect()}
    one = {(1, 0, 40, 73.5, 98.5, 10.2), (1, 0, 52, 49.5, 68.5, 10.2), (2, 0, 40, 54.5, 70.5, 10.2)}
    assert boxes == {(doc, *b) for b in one for doc in (1, 2)}
    assert search.find_boxes(index, "(").isEmpty() and search.find_boxes(index, "z*").isEmpty()


def test_character_index_and_boxes_exchange_no_glyphs(spark, data):
    from folio.plans.all import QUERIES

    for name in ("text_char_index", "search_boxes"):  # the texts alone are dealt
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Sort " not in plan


def test_units_of_words_are_those_of_their_glyphs(spark):
    run = [(1, "a", 50, 6, 10), (2, " ", 56, 6, 10), (3, "bc\td", 60, 6, 10), (7, " ", 84, 6, 10), (8, " ", 87, 6, 10), (9, "ef", 90, 6, 10), (11, "g", 109, 6, 10)]
    single = [(g + i, c, x + i * w, w, size) for g, s, x, w, size in run for i, c in enumerate(s)][::-1]
    df = spark.createDataFrame([(1, 1, 0, 0, run), (2, 1, 0, 0, single)], "doc_id int, page_no int, line0 int, word0 int, glyphs array<struct<g_no:int,s:string,x:int,w:int,size:int>>")
    got = {(r["doc_id"], r["unit"], r["x0"], r["x1"], r["n"]) for r in tx.split_runs(df).collect()}
    assert got == {(doc, *u) for u in [(0, 50, 84, 4), (1, 90, 102, 2), (2, 109, 115, 1)] for doc in (1, 2)}


def test_regions_take_glyphs_out_of_words(spark):
    page = [(0, 0, 0, "abcde", 50, 6, 40, 10), (0, 1, 0, "fg", 86, 6, 40, 10), (1, 0, 0, "hij", 50, 6, 52, 10)]
    df = spark.createDataFrame([(1, 1, page, [(60, 30, 12, 8), (70, 30, 4, 8)]), (1, 2, page, None)], f"doc_id int, page_no int, glyphs {GLYPH_PAGE}, regions array<struct<rx:int,ry:int,rw:int,rh:int>>")
    assert {(r["page_no"], r["word0"], r["g_no"]) for r in search.hit_glyphs(df).collect()} == {(1, 0, g) for g in (2, 3)}
    left = {r["page_no"]: "".join(g["s"] for g in r["glyphs"]) for r in search.redact_glyphs(df).collect()}
    assert left == {1: "abefghij", 2: "abcdefghij"}


def test_selection_is_found_in_the_page(spark):
    runs = [(40, 50, 12, "a"), (40, 80, 12, "b"), (52, 50, 12, "c"), (400, 50, 12, "z")]
    spans = [(1, 95.0, 40.0, 55.0, 51.0), (2, 50.0, 40.0, 50.0, 300.0)]
    df = spark.createDataFrame([(1, 1, runs, spans)], "doc_id int, page_no int, runs array<struct<y:int,x:int,w:int,str:string>>, spans array<struct<span_id:int,px0:double,py0:double,px1:double,py1:double>>")
    assert sorted(map(tuple, search.select_between(df).collect())) == [(1, 2, "b"), (1, 3, "c")]


def test_pages_are_not_exchanged_by_glyph(spark, data):
    from folio.plans.all import QUERIES

    for name in ("text_unit_split", "text_selection"):  # the texts alone are dealt
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Sort " not in plan and "Join" not in plan


def test_measured_width_is_that_of_the_face(spark):
    advance = layout.advances("serif")
    text = "".join(advance) + "ж𝄞\x01"
    width = sum(advance.values()) + 2 * advance["?"]
    for limit, lines in ((width, 1), (width - 1, 1)):  # without blanks, a word stays whole
        assert len(spark.range(1).select(layout.wrap_measured(F.lit("x" + text.replace(" ", "").replace("\xa0", "")), limit, 1000.0, advance)).first()[0]) == lines
    words = f"{text.replace(' ', '').replace(chr(0xa0), '')} i"
    full = width - advance[" "] - advance["\xa0"] + advance[" "] + advance["i"]
    got = [len(spark.range(1).select(layout.wrap_measured(F.lit(words), float(limit), 1000.0, advance)).first()[0]) for limit in (full, full - 1)]
    assert got == [1, 2]


def test_wrapping_looks_widths_up_by_code(spark, data):
    from folio.plans.all import QUERIES

    plan = QUERIES["wrap_measured"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "map(" not in plan and "REPARTITION_BY_NUM" in plan


def test_ranks_are_not_broadcast(spark, monkeypatch):
    plans, keep = [], outline.written
    monkeypatch.setattr(outline, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    chain = spark.sql("SELECT id AS node_id, CASE WHEN id > 1 THEN id - 1 END AS prev FROM range(1, 40)")
    assert outline.sibling_ranks(chain).agg({"rank": "max"}).first()[0] == 38
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
