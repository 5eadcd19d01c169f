"""How page queries are dealt: by document, in as many parts as the rows ask for, nulls apart."""

from pyspark.sql import functions as F

from folio.operators.assembly import assemble, page_file
from folio.operators.pages import pick_pages
from folio.plans.all import QUERIES
from folio.sources import fixtures


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_parts_follow_the_rows(spark, data, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_LINES", 200)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    for name in ("range_pick", "asm_page_file", "asm_resolve"):
        assert QUERIES[name](spark, data).rdd.getNumPartitions() == -(-lines // 200), name
    assert max(sizes(fixtures.Tables(spark, data).fx_pages)) < 600


def test_nothing_is_dealt_by_page(spark, data):
    for name in ("range_pick", "asm_page_file"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == 1 and "page_no" not in "".join(x for x in plan.splitlines() if "Exchange" in x), name


def test_blanks_do_not_meet_in_one_task(spark):
    ops = spark.range(4000).selectExpr("id % 5 AS out_id", "CAST(id DIV 5 + 1 AS INT) AS seq", "CAST(NULL AS LONG) AS src_doc", "CAST(NULL AS INT) AS src_page", "0 AS rotation", "CAST(NULL AS INT) AS blank_w", "CAST(NULL AS INT) AS blank_h")
    pages = spark.range(4000).selectExpr("id AS doc_id", "1 AS page_no", "0 AS x0", "0 AS y0", "100 AS x1", "200 AS y1", "90 AS rotate")
    found = assemble(ops, pages, 8)
    assert max(sizes(found)) < 1000 and found.where("status = 'blank' AND w = 612 AND h = 792 AND rotate = 0").count() == 4000


def test_half_a_name_is_no_page(spark):
    ops = spark.createDataFrame([(1, 1, 7, 2), (1, 2, None, 2), (1, 3, 7, None), (1, 4, 7, 9), (1, 5, 0, 1)], "out_id long, seq int, src_doc long, src_page int").selectExpr("*", "0 AS rotation", "50 AS blank_w", "60 AS blank_h")
    pages = spark.createDataFrame([(7, 2), (0, 2), (0, 1)], "doc_id long, page_no int").selectExpr("*", "0 AS x0", "0 AS y0", "100 AS x1", "200 AS y1", "90 AS rotate")
    got = {r["seq"]: (r["src_doc"], r["src_page"], r["w"], r["status"]) for r in assemble(ops, pages).collect()}
    assert got == {1: (7, 2, 100, "page"), 2: (None, 2, None, "missing"), 3: (7, None, 50, "blank"), 4: (7, 9, None, "missing"), 5: (0, 1, 100, "page")}


def test_first_mention_counts(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 6)] + [(2, 1)], "doc_id long, page_no int")
    ranges = spark.createDataFrame([(1, 1, 4, 9), (1, 2, 1, 1), (1, 3, 1, 5), (2, 1, 2, 3)], "doc_id long, ord int, from_page int, to_page int")
    assert [tuple(r) for r in pick_pages(pages, ranges).orderBy("doc_id", "seq").collect()] == [(1, 4, 1), (1, 5, 2), (1, 1, 3), (1, 2, 4), (1, 3, 5)]
    assert {(r["page_no"], r["out_id"]) for r in page_file(pages, ranges).collect()} == {(4, 1), (5, 1), (1, 2), (2, 3), (3, 3)}
