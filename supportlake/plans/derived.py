"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: source_file, level and validity dates by arithmetic on the id."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("doc_id"), F.lit(200)).cast("int"))
    return d.select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_file"), F.col("lang").alias("doc_type"),
        F.pmod(F.col("doc_id"), F.lit(3)).cast("int").alias("access_level"), day.alias("effective_from"), F.date_add(day, 90).alias("effective_to"),
    )


CHUNKS = """(SELECT doc_id AS chunk_id, text, source AS source_file, lang AS doc_type, CAST(doc_id % 3 AS INTEGER) AS access_level,
 DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) AS effective_from, DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) + 90 AS effective_to FROM documents)"""


#: Ids of a range that is numbered by itself.
RANGE = 100_000


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their place in the source. Ids alone are numbered, range by range; counts of the ranges before are added, so no task sees a whole source."""
    ids = chunks(spark, sf_dir).select("chunk_id", "source_file", F.floor(F.col("chunk_id") / RANGE).alias("_r"))
    before = Window.partitionBy("source_file").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ids.groupBy("source_file", "_r").agg(F.count("*").alias("n")).select("source_file", "_r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    local = ids.withColumn("_n", F.row_number().over(Window.partitionBy("source_file", "_r").orderBy("chunk_id")) - 1)
    placed = local.join(starts, ["source_file", "_r"]).select("chunk_id", (F.col("_start") + F.col("_n")).alias("chunk_index"))
    return chunks(spark, sf_dir).join(placed, "chunk_id")


INDEXED = f"(SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_id) - 1 AS chunk_index FROM {CHUNKS})"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return vectors(spark, sf_dir).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("qvec"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_id"), "role", F.col("text").alias("content"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("query_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("intent"), F.col("value").alias("total_time_ms"), F.col("user_id").alias("session_id"),
        (F.col("event_type") == "error").alias("hallucination_detected"), F.when(F.col("event_type") == "click", "hit").when(F.col("event_type") == "view", "miss").alias("cache_hit"), F.round(F.col("value") / 1000, 6).alias("embedding_cost"),
        F.floor("value").cast("long").alias("prompt_tokens"), F.floor(F.col("value") / 2).cast("long").alias("completion_tokens"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "qwen-plus").when(F.pmod("event_id", F.lit(3)) == 1, "qwen3.7-plus").otherwise("other").alias("model_used"),
    )


LOG = """(SELECT event_id AS query_id, ts AS "timestamp", event_type AS intent, value AS total_time_ms, user_id AS session_id, event_type = 'error' AS hallucination_detected,
 CASE event_type WHEN 'click' THEN 'hit' WHEN 'view' THEN 'miss' END AS cache_hit, round(value / 1000, 6) AS embedding_cost, CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(floor(value / 2) AS BIGINT) AS completion_tokens,
 CASE WHEN event_id % 3 = 0 THEN 'qwen-plus' WHEN event_id % 3 = 1 THEN 'qwen3.7-plus' ELSE 'other' END AS model_used FROM events)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("ORD"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("order_no"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("create_time"), F.lit(None).cast("timestamp").alias("complete_time"))


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("ORD"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("order_no"), F.col("l_returnflag").alias("carrier"),
        F.concat_ws("-", F.lit("T"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tracking_number"), F.col("l_shipdate").alias("shipped"),
    )
