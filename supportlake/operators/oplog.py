"""Query-log statistics (N1-N7) and failure runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import lexicons as lex
from supportlake.operators import segments


def with_cost(log: DataFrame, prices: dict[str, tuple[float, float]] = lex.PRICES, default: tuple[float, float] = (0.001, 0.002)) -> DataFrame:
    """Price per thousand input and output tokens by model."""
    side = lambda i: F.coalesce(F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, p[i])])[F.col("model_used")], F.lit(default[i]))
    return log.withColumn("llm_cost", F.round(F.col("prompt_tokens") / 1000 * side(0) + F.col("completion_tokens") / 1000 * side(1), 6))


def daily_columns() -> list:
    """N2's aggregates of a day, and an approximate 99th percentile that streams can hold."""
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return [
        F.count("*").alias("n_queries"), F.round(F.sum("llm_cost"), 4).alias("llm_cost"), F.round(F.sum("embedding_cost"), 4).alias("embedding_cost"),
        F.round(F.sum(F.col("llm_cost") + F.col("embedding_cost")), 4).alias("cost"), F.round(F.avg("total_time_ms"), 1).alias("avg_ms"),
        rate(F.col("hallucination_detected")).alias("hallucination_rate"), rate(F.col("cache_hit") == "hit").alias("cache_hit_rate"),
        *(F.sum(c).alias(f"total_{c}") for c in ("prompt_tokens", "completion_tokens")), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.percentile_approx("total_time_ms", 0.99, 10_000).alias("p99_ms"),
    ]


def daily_stats(log: DataFrame) -> DataFrame:
    """One row a day."""
    return log.groupBy(F.to_date("timestamp").alias("day")).agg(*daily_columns()).drop("p99_ms")


def intent_mix(log: DataFrame) -> DataFrame:
    """Intents a day, most frequent first."""
    n = log.groupBy(F.to_date("timestamp").alias("day"), "intent").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "intent")))


def rank_p99(log: DataFrame) -> DataFrame:
    """The value at offset max(0, int(n / 100) - 1) of the descending latencies of a day.

    Latencies are counted by value first, so that the window holds distinct values and not rows.
    """
    v = log.groupBy(F.to_date("timestamp").alias("day"), F.col("total_time_ms").alias("ms")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("day").orderBy(F.desc("ms"))
    n = F.sum("c").over(Window.partitionBy("day"))
    at = v.withColumn("upto", F.sum("c").over(w)).withColumn("offset", F.greatest(F.lit(0), F.floor(n * 0.01) - 1))
    return at.filter((F.col("upto") > F.col("offset")) & (F.col("upto") - F.col("c") <= F.col("offset"))).select("day", F.col("ms").alias("p99_ms"))


def recent_queries(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest n rows."""
    return log.orderBy(F.desc("timestamp"), "query_id").limit(n)


LIMITS = {"hallucination_rate": 0.05, "p99_ms": 3000.0, "cost": 10.0}


def alerts(daily: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """One row a day and metric above its limit."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(v).alias("limit_value")) for m, v in limits.items()))
    return daily.select("day", F.explode(rows).alias("r")).select("day", "r.*").filter("value > limit_value")


def hit_rate(log: DataFrame) -> DataFrame:
    """Hits among hits and misses; rows that asked no cache do not count."""
    return log.agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("cache_hit") == "hit"), F.count_if(F.col("cache_hit").isin("hit", "miss"))), F.lit(0.0)), 6).alias("hit_rate"))


def failure_runs(events: DataFrame, n: int, largest: int = segments.LARGEST) -> DataFrame:
    """Runs of at least n failures in a row, events (service, ts, seq, ok); a success ends a run.

    Successes are counted along each service. Where one has more than `largest` events they are counted by ranges.
    """
    good = F.col("ok").cast("int")
    if segments.giant(events, "service", largest):
        counted = segments.with_sums(events, "service", [F.col("ts"), F.col("seq")], running={"run": good})
    else:
        counted = events.withColumn("run", F.sum(good).over(Window.partitionBy("service").orderBy("ts", "seq")))
    runs = counted.filter(~F.col("ok"))
    return runs.groupBy("service", "run").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("failures")).filter(F.col("failures") >= n).drop("run")
