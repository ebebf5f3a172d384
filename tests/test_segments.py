"""Sums by ranges against plain windows, and how evenly one giant key spreads."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from supportlake.functions.tables import OwnTable
from supportlake.operators import evaluate, index, oplog, segments, sessions


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(6)
    made = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i, rnd.choice([None, 0, 1, 5])) for i in range(4000)]
    return spark.createDataFrame([*made, ("null", 1, None), ("null", 2, None)], "key string, at int, v int").repartition(5)


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_sums_equal_plain_windows(rows, parts):
    w = Window.partitionBy("key")
    want = rows.withColumn("run", F.sum("v").over(w.orderBy("at"))).withColumn("n", F.count("*").over(w.orderBy("at"))).withColumn("total", F.sum("v").over(w))
    got = segments.with_sums(rows, "key", [F.col("at")], running={"run": F.col("v"), "n": F.lit(1)}, totals={"total": F.col("v")}, parts=parts)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    down = segments.with_sums(rows, "key", [F.desc("at")], running={"n": F.lit(1)}, parts=parts)
    assert sorted(map(tuple, down.collect()), key=repr) == sorted(map(tuple, rows.withColumn("n", F.row_number().over(w.orderBy(F.desc("at")))).collect()), key=repr)
    assert segments.with_sums(rows.filter("at < 0"), "key", [F.col("at")], running={"n": F.lit(1)}).count() == 0


def test_one_giant_key_spreads_evenly(spark):
    one = spark.range(40_000).select(F.lit("hot").alias("service"), F.col("id").alias("ts"), F.lit(0).alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("ok"))
    sizes = [r["count"] for r in OwnTable(one.repartitionByRange(8, "service", "ts", "seq").withColumn("p", F.spark_partition_id()), "even").df.groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(oplog.failure_runs(one, 4, largest=100)) == key(oplog.failure_runs(one, 4)) != []


def test_pages_and_messages_by_ranges(spark):
    rnd = random.Random(7)
    pages = spark.createDataFrame([(rnd.choice("ffffg"), i, rnd.choice([0, 10, 60]), rnd.choice([0, 1])) for i in range(900)], "file string, page int, text_length int, image_count int")
    for cap in (50, None):
        assert sorted(map(tuple, index.page_route(pages, cap, largest=10).collect()), key=repr) == sorted(map(tuple, index.page_route(pages, cap).collect()), key=repr)
    said = spark.createDataFrame([(rnd.choice("ssst"), i, "user", rnd.choice(["", None, "x" * 30, "y" * 7])) for i in range(900)], "session_id string, msg_id int, role string, content string")
    for budget in (100, 900):
        assert sorted(map(tuple, sessions.context_window(said, budget, 3, largest=10).collect()), key=repr) == sorted(map(tuple, sessions.context_window(said, budget, 3).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 777])
def test_wide_percentiles_are_exact(spark, n):
    rnd = random.Random(n)
    df = spark.createDataFrame([(None if i == 5 else rnd.choice([1.0, 2.5, rnd.random() * 100]),) for i in range(n)], "latency_ms double")
    want = df.agg(*(F.percentile("latency_ms", F.lit(q / 100)).alias(f"p{q}") for q in (50, 95, 99))).first()
    got = evaluate.wide_percentiles(df, "latency_ms", 5).collect()
    assert len(got) == 1 and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got[0], want, strict=True))
    assert tuple(evaluate.summary(df, wide=True).first()) == tuple(evaluate.summary(df).first())
