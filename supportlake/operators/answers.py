"""Claim checks and answer gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import lexicons as lex
from supportlake.functions.text import any_of, empty
from supportlake.operators.safety import high_stakes


def normalise_verdict(c: Column) -> Column:
    """A1: known aliases; anything else is a hallucination."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in lex.VERDICTS.items() for x in kv])[F.lower(F.trim(empty(c)))], F.lit("hallucination"))


def claim_scores(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """A2: share of supported and half of partial claims; flagged on any hallucination, below 0.6, or without claims."""
    v = normalise_verdict(F.col("verdict"))
    n = claims.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if(v == "supported").alias("s"), F.count_if(v == "partially").alias("p"), F.count_if(v == "hallucination").alias("h"))
    score = F.round(F.coalesce((F.col("s") + 0.5 * F.col("p")) / F.col("n"), F.lit(0.0)), 4)
    joined = answers.join(n, "answer_id", "left").withColumn("faithfulness", score)
    return joined.withColumn("has_hallucination", (F.coalesce("h", F.lit(0)) > 0) | (F.col("faithfulness") < 0.6)).drop("n", "s", "p", "h")


def fallback_check(df: DataFrame) -> DataFrame:
    """A3: without claims: honest phrases 0.9, else 0.5, both clean; an empty answer or no documents 0 and flagged."""
    none = (empty(F.col("answer")) == "") | (F.coalesce("n_docs", F.lit(0)) == 0)
    return df.withColumn("faithfulness", F.when(none, 0.0).when(any_of(F.col("answer"), lex.HONEST), 0.9).otherwise(0.5)).withColumn("has_hallucination", none)


def partial_answer(claims: DataFrame) -> DataFrame:
    """A4: supported claims, then those that could not be confirmed, else an apology."""
    v = normalise_verdict(F.col("verdict"))
    lines = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(v == kind, F.struct("pos", "text")))), lambda x: F.concat(F.lit("- "), x["text"]))
    g = claims.groupBy("answer_id").agg(lines("supported").alias("yes"), lines("hallucination").alias("no"))
    text = F.concat_ws(
        "\n", F.when(F.size("yes") > 0, F.concat(F.lit("根据已有信息：\n"), F.array_join("yes", "\n"))),
        F.when((F.size("yes") > 0) & (F.size("no") > 0), F.concat(F.lit("以下内容暂时无法确认：\n"), F.array_join("no", "\n"))),
    )
    return g.select("answer_id", F.when(F.size("yes") > 0, text).otherwise("抱歉，根据已有信息无法确认，建议您咨询人工客服。").alias("answer"))


def accepted_round(rounds: DataFrame, min_score: float = 0.8, max_rounds: int = 2, max_calls: int = 8) -> DataFrame:
    """A5: the first round without hallucination and with enough faithfulness, else the last one allowed.

    The budget is asked before a round: it runs if fewer than `max_calls` model calls were made up to then (`calls` counts them up
    to a round's end, where given), and may itself go beyond. The first round always runs.
    """
    inside = rounds.filter(F.col("round") <= max_rounds)
    if "calls" in rounds.columns:
        made = F.max("calls").over(Window.partitionBy("answer_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
        inside = inside.withColumn("_made", made).filter(F.coalesce(F.col("_made") < max_calls, F.lit(True))).drop("_made")
    ok = ~F.col("has_hallucination") & (F.col("faithfulness") >= min_score)
    order = Window.partitionBy("answer_id").orderBy(F.desc(ok.cast("int")), F.when(ok, F.col("round")).otherwise(-F.col("round")))
    return inside.withColumn("accepted", ok).withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def quality_gate(df: DataFrame) -> DataFrame:
    """At least 0.85 for promises and 0.7 otherwise; level 4 and unsure phrases fail; the third loop passes unless a promise is below."""
    stakes = F.size(high_stakes(F.col("answer"))) > 0
    least = F.when(stakes, 0.85).otherwise(0.7)
    below = F.col("faithfulness") < least
    bad = below | (F.col("degradation_level") >= 4) | any_of(F.col("answer"), lex.GATE_UNSURE)
    return df.withColumn("passed", F.when(F.col("loop_count") >= 3, ~(stakes & below)).otherwise(~bad))


def surface_review(df: DataFrame) -> DataFrame:
    """A failed gate asks for a human."""
    return df.withColumn("needs_human", F.coalesce("needs_human", F.lit(False)) | ~F.col("passed"))
