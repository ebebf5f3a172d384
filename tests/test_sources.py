"""File sources: scans, question sets, catalogues, databases, index writes and redacted writes."""

import datetime as dt
import decimal
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from supportlake.operators import index, safety
from supportlake.sources import files, pages


def test_scan_skips_hidden_and_unknown_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.md", ".b.md", "~c.txt", "d.exe", "in/e.HTML"):
        (tmp_path / name).write_text("x")
    names = lambda recursive: sorted(r.path.rsplit("/", 1)[1] for r in files.scan_files(spark, f"file://{tmp_path}", recursive).select("path").collect())
    assert names(True) == ["a.md", "e.HTML"] and names(False) == ["a.md"]


def test_question_sets(spark, tmp_path):
    path = f"file://{tmp_path}/cases"
    cases = spark.createDataFrame([("q", "a", ["k"], "x", "easy")], files.CASES)
    assert files.read_eval_cases(spark, path, cases).collect() == cases.collect()
    files.write_eval_cases(cases, path)
    assert files.read_eval_cases(spark, path, cases.limit(0)).collect() == cases.collect()


def test_catalogue_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "p.csv").write_text("\ufeff商品ID,名称,价格,库存,上架时间,备注\nP1,杯,79.00,5,2026-06-01,n\nP2,碗,?,x,,\n", encoding="utf-8")
    rows = files.read_catalogue(spark, f"file://{tmp_path}/p.csv").orderBy("商品ID").collect()
    assert rows[0].asDict() == {c: None for c in files.CATALOGUE} | {"商品ID": "P1", "名称": "杯", "价格": decimal.Decimal("79.00"), "库存": 5, "上架时间": dt.date(2026, 6, 1), "备注": "n"}
    assert (rows[1]["价格"], rows[1]["库存"], rows[1]["上架时间"]) == (None, None, None)


@pytest.mark.parametrize(("html", "text"), [
    ("<body><div class='x detail y'><p>inner text</p></div></body>", "inner text"), ('<div id="detail">by id here</div><p>outside</p>', "by id here"), ("<body><p>whole body</p></body>", "whole body"), (None, ""), ("no tags at all", "no tags at all"),
])
def test_page_regions(spark, html, text):
    assert spark.createDataFrame([(html,)], "h string").select(pages.main_text(F.col("h")).alias("t")).first().t == text


def test_regions_end_at_their_own_depth(spark):
    cases = {
        "<body><div class='x'>menu one</div><div class='detail'>first<div>inner text</div>last</div><div>after it</div></body>": "first\ninner text\nlast",
        "<div id=detail2>nothing</div><div id='detail'>wanted<div><div>deep one</div></div></div><div>after it</div>": "wanted\ndeep one",
        "<main>open <div>region</div> goes on": "open\nregion\ngoes on",
        "<article></article><body>body text</body>": "",
        "<main>one text</main><main>two text</main>": "one text",
        "<div class='detail'>a long one</div></div></div>": "a long one",
        "<p>plain page</p>": "plain page",
        "<DIV CLASS=\"big detail\">upper<DIV>case text</DIV></DIV>rest of it": "upper\ncase text",
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i int, h string")
    assert [r.t for r in df.select("i", pages.main_text(F.col("h")).alias("t")).orderBy("i").collect()] == list(cases.values())


def test_index_keeps_whole_texts_on_request(spark, tmp_path):
    df = spark.createDataFrame([("s", "x" * 9000, None), ("t", "short", 2), ("u", None, 1)], "source_file string, text string, access_level int")
    assert sorted((r.source_file, r.truncated, r.access_level) for r in index.index_rows(df).collect()) == [("s", True, 0), ("t", False, 2), ("u", False, 1)]
    assert index.index_rows(df).filter("length(text) = 8000").count() == 1
    assert index.write_index(df, f"file://{tmp_path}/ix", None).read().filter("length(text) = 9000").count() == 1


def test_pages_past_the_limit_stay(spark):
    df = spark.createDataFrame([("f", i, 0, 1) for i in range(60)], "file string, page int, text_length int, image_count int")
    rows = index.page_route(df).collect()
    assert len(rows) == 60 and sum(r.over_limit for r in rows) == 10 and {r.file_cost for r in rows} == {0.25} and all((r.route is None) == r.over_limit for r in rows)
    assert {r.file_cost for r in index.page_route(df, None).collect()} == {0.3}


def test_long_sheets_are_whole_on_request(spark):
    df = spark.range(6000).selectExpr("'s' as sheet", "id", "id as a")
    r = pages.table_markdown(df, "sheet", "id", ["a"], None).first()
    assert r.markdown.count("\n") == 6001 and not r.truncated
    r = pages.table_markdown(df, "sheet", "id", ["a"]).first()
    assert r.markdown.count("\n") == 5001 and r.truncated


def test_redacted_write_and_long_input(spark, tmp_path):
    df = spark.createDataFrame([("mail a.b@c.com now",), ("x" * 6000,)], "text string")
    safety.redacted_write(df, ["text"], f"file://{tmp_path}/r")
    assert spark.read.parquet(f"file://{tmp_path}/r").filter("text like '%@%'").count() == 0
    assert [(r.truncated, len(r.safe_text)) for r in safety.check_input(df).collect()] == [(False, 18), (True, 5000)]
    assert safety.check_input(df, limit=None).filter("truncated").count() == 0


def test_files_tell_their_type(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1"), "pdf"), (bytearray(b"%PDF-1"), "word"), (bytearray(b"plain"), "pdf"), (None, "pdf")], "content binary, doc_type string")
    assert [r.w for r in df.select(index.type_warning(F.col("content"), F.col("doc_type")).alias("w")).collect()] == [None, "content is pdf, not word", None, None]


def test_database_is_read_by_ranges_and_in_steps(spark):
    """An embedded database: bounds found by the reader, rows without a key, an empty table, then new rows alone and again after a stop."""
    url, props = f"jdbc:derby:memory:{os.path.basename(tempfile.mkdtemp(prefix='spark-', dir='/tmp')).replace('-', '')};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    marks = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/marks"
    put = lambda ids: spark.createDataFrame([(i, f"x{i}") for i in ids], "ID long, NAME string").coalesce(1).write.jdbc(url, "ORDERS", "append", props)
    put([])
    assert files.key_bounds(spark, url, "ORDERS", props, "ID") is None
    new = files.NewRows(spark, url, "ORDERS", props, "ID", marks, 3)
    rows, upto = new.read()
    assert rows.count() == 0 and upto is None
    put([*range(100), None])
    whole = files.read_jdbc_table(spark, url, "ORDERS", props, "ID", parts=4)
    assert files.key_bounds(spark, url, "ORDERS", props, "ID") == (0, 99)
    assert whole.rdd.getNumPartitions() == 4 and sorted(r.ID for r in whole.filter("ID is not null").collect()) == list(range(100)) and whole.count() == 101
    sizes = [n for n in whole.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert max(sizes) <= 27
    rows, upto = new.read()
    put([100])  # comes while the rows are stored: the next step's
    assert upto == 99 and sorted(r.ID for r in rows.collect()) == list(range(100))
    assert new.read()[1] == 100 and new.last() is None  # a stop before `done`: all again
    new.done(upto)
    rows, upto = files.NewRows(spark, url, "ORDERS", props, "ID", marks).read()
    assert [r.ID for r in rows.collect()] == [100] and upto == 100
    new.done(upto)
    assert new.read()[1] is None and new.read()[0].count() == 0
