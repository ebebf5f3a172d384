"""Retrieval and answer quality (E1-E11): aggregations over (query_id, rank, rel)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions.text import cosine, empty, word_overlap
from supportlake.operators import segments


def relevance(hits: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Cosine with the truth's vector where both exist, else the truth is part of the text, any case."""
    by_vector = cosine(F.col("vec"), F.col("truth_vec")) >= threshold
    by_text = F.contains(F.lower(empty(F.col("text"))), F.lower(empty(F.col("truth")))) & (F.length(empty(F.col("truth"))) > 0)
    return hits.withColumn("rel", F.when(F.col("vec").isNotNull() & F.col("truth_vec").isNotNull(), by_vector).otherwise(by_text))


def ranking_metrics(rel: DataFrame, k: int = 5) -> DataFrame:
    """E2-E5 for each query: recall@k (hit or not), reciprocal rank, precision@k over what was returned, NDCG@k."""
    r, on = F.col("rel").cast("int"), F.col("rank") <= k
    gain = F.sum(F.when(on, r / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_rel"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    one = rel.groupBy("query_id").agg(
        F.max(F.when(on, r).otherwise(0)).cast("double").alias("recall"), F.max(r / F.col("rank")).alias("rr"),
        F.avg(F.when(on, r.cast("double"))).alias("precision"), gain.alias("dcg"), F.sum(F.when(on, r).otherwise(0)).cast("int").alias("n_rel"),
    )
    ndcg = F.when(F.col("n_rel") > 0, F.col("dcg") / best).otherwise(0.0)
    rounded = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n)
    return one.select("query_id", "recall", rounded(F.col("rr"), "rr"), rounded(F.col("precision"), "precision"), rounded(ndcg, "ndcg"))


def faithfulness(answer: Column, source: Column, a_vec: Column | None = None, s_vec: Column | None = None) -> Column:
    """Cosine cut to [0, 1], or word overlap without vectors."""
    if a_vec is None or s_vec is None:
        return word_overlap(answer, source)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a_vec, s_vec)))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of the keywords in the answer, any case; 1 without keywords."""
    found = F.filter(keywords, lambda w: F.contains(F.lower(empty(answer)), F.lower(w)))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, F.size(found) / F.size(keywords)).otherwise(1.0)


def latency_score(ms: Column, t: float = 1000.0) -> Column:
    """1 at no latency, 0 from three times t on."""
    return F.when(ms <= 0, 1.0).when(ms >= 3 * t, 0.0).otherwise(1 - ms / (3 * t))


def latency_percentiles(df: DataFrame, ms: str, by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation.

    Values are counted first, so a group's buffer never holds rows; the percentile reads (value, count).
    """
    n = df.filter(F.col(ms).isNotNull()).groupBy(*(by or []), F.col(ms).alias("_v")).agg(F.count("*").alias("_n"))
    return n.groupBy(*(by or [])).agg(*(F.round(F.percentile("_v", F.lit(q / 100), F.col("_n")), 6).alias(f"p{q}") for q in (50, 95, 99)))


def wide_percentiles(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """The exact 50th, 95th and 99th percentiles of a column of any size, one row (p50, p95, p99), with E9's interpolation.

    Rows are counted by value, the distinct values are dealt into ranges and their counts summed along them, and the values at
    the wanted places are picked out. No task holds more than a range of distinct values. Nulls do not count; no values give nulls.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    total = counted.agg(F.sum("_c")).first()[0] or 0
    upto = segments.with_sums(counted.withColumn("_k", F.lit(0)), "_k", [F.col("_v")], running={"_n": F.col("_c")}, parts=parts)
    at, out = lambda place: F.max(F.when((F.col("_n") > place) & (F.col("_n") - F.col("_c") <= place), F.col("_v"))), []
    for q in (50, 95, 99):
        spot = (total - 1) * (q / 100)
        low, high = math.floor(spot), math.ceil(spot)
        out.append((at(low) if low == high else (high - spot) * at(low) + (spot - low) * at(high)).alias(f"p{q}"))
    return upto.agg(*out)


MEANS = ("recall", "rr", "precision", "ndcg", "faithfulness", "coverage", "latency_score", "hallucination", "rounds")


def summary(cases: DataFrame, wide: bool = False) -> DataFrame:
    """Means over all cases, latency and its percentiles, rates; columns that a table of cases lacks are left out.

    cases (recall, rr, precision, ndcg, faithfulness, coverage, latency_score, hallucination 0/1, rounds, latency_ms). With `wide` the
    percentiles come from ranges of values: the same numbers, for tables with more distinct latencies than one task can hold.
    """
    means = [F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in MEANS if c in cases.columns)]
    if "latency_ms" not in cases.columns:
        return cases.agg(*means)
    means.append(F.round(F.avg("latency_ms"), 1).alias("avg_ms"))
    if wide:
        spots = wide_percentiles(cases, "latency_ms").select(*(F.round(f"p{q}", 1).alias(f"p{q}_ms") for q in (50, 95, 99)))
        return cases.agg(*means).join(F.broadcast(spots))  # one row
    return cases.agg(*means, *(F.round(F.percentile("latency_ms", F.lit(q / 100)), 1).alias(f"p{q}_ms") for q in (50, 95, 99)))


def gate(result: DataFrame, limits: dict[str, float], failed: DataFrame | None = None) -> DataFrame:
    """One row a metric with its value, limit and verdict; cases that failed to run are counted beside (`failed`, one row n) and do not decide."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(v).alias("at_least")) for m, v in limits.items()))
    out = result.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.value") >= F.col("r.at_least")).alias("passed"))
    return out if failed is None else out.join(F.broadcast(failed.agg(F.count("*").alias("failed_cases"))))  # one row
