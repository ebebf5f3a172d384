"""Routing, emotion, escalation and policy (X1-X12): rule tables compiled into one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import lexicons as lex
from supportlake.functions.text import any_of, empty, first_label, hits
from supportlake.functions.words import FEW, group_numbers


def classify_intent(df: DataFrame, rules: Sequence[tuple] = lex.INTENT_RULES, text: str = "text") -> DataFrame:
    """The first rule by priority gives intent and confidence."""
    c = F.lower(empty(F.col(text)))
    confidence = first_label(c, rules, F.lit(lex.DEFAULT_CONFIDENCE), 2)
    return df.withColumn("intent", first_label(c, rules, F.lit(lex.DEFAULT_INTENT))).withColumn("confidence", confidence)


def reroute_followup(df: DataFrame, markers: Sequence[str] = lex.FOLLOW_UP, text: str = "text") -> DataFrame:
    """Small talk that refers back becomes a product question."""
    on = (F.col("intent") == "chitchat") & any_of(F.col(text), markers)
    return df.withColumn("confidence", F.when(on, 0.5).otherwise(F.col("confidence"))).withColumn("intent", F.when(on, "product_consult").otherwise(F.col("intent")))


def route_target(df: DataFrame) -> DataFrame:
    """Sql for order and logistics questions that carry a number, but rag for these below 0.4 confidence; else by intent."""
    has = (F.length(empty(F.col("order_id"))) > 0) | (F.length(empty(F.col("tracking_number"))) > 0)
    by_intent = F.create_map(*[F.lit(x) for kv in lex.ROUTES.items() for x in kv])[F.col("intent")]
    return df.withColumn("target", F.when(F.col("intent").isin("order_query", "logistics") & has, F.when(F.col("confidence") < 0.4, "rag").otherwise("sql")).otherwise(F.coalesce(by_intent, F.lit("rag"))))


def branch(df: DataFrame, rules: Sequence[tuple] = lex.POLICY_RULES) -> DataFrame:
    """Human first, then policy for return questions with a scenario, then the target."""
    policy = (F.col("intent") == "return_refund") & (F.size(policy_scenarios(F.col("text"), rules)) > 0)
    return df.withColumn("branch", F.when(F.col("needs_human"), "human").when(policy, "policy").otherwise(F.col("target")))


def emotion(df: DataFrame, text: str = "text", extreme=lex.EXTREME, angry=lex.ANGRY, dissatisfied=lex.DISSATISFIED) -> DataFrame:
    """Level and confidence from word hits and exclamation marks."""
    c = empty(F.col(text))
    n = {k: F.size(hits(c, w)) for k, w in (("x", extreme), ("a", angry), ("d", dissatisfied))}
    marks = F.length(c) - F.length(F.regexp_replace(c, "[！!]", ""))
    level = F.when(c == "", "calm").when(n["x"] > 0, "extreme").when((n["a"] > 0) | (marks >= 2), "angry").when(n["d"] > 0, "dissatisfied").otherwise("calm")
    sure = (
        F.when(c == "", 0.0)
        .when(n["x"] > 0, F.least(F.lit(0.95), 0.7 + 0.15 * n["x"]))
        .when((n["a"] > 0) | (marks >= 2), F.least(F.lit(0.85), 0.6 + 0.1 * n["a"] + 0.05 * marks))
        .when(n["d"] > 0, F.least(F.lit(0.7), 0.5 + 0.1 * n["d"]))
        .otherwise(0.3)
    )
    return df.withColumn("emotion", level).withColumn("emotion_confidence", F.round(sure, 4))


def escalate(df: DataFrame, rules: Sequence[tuple] = lex.HUMAN_RULES, unsure: Sequence[str] = lex.UNSURE, reasons: Mapping[str, str] = lex.REASONS) -> DataFrame:
    """(needs_human, scenario, priority, reason) from emotion, intent, words of the text, the answer and the confidence, in this order.

    The reason is the text an agent reads; a rule of the caller's own without one has its label there. No escalation: empty strings.
    """
    extreme = F.col("emotion") == "extreme"
    angry = (F.col("emotion") == "angry") & F.col("intent").isin("return_refund", "complaint", "order_query")
    by_rule = first_label(F.col("text"), rules, F.lit(None).cast("string"))
    doubted, low = any_of(F.col("answer"), unsure), F.coalesce(F.col("confidence") < 0.4, F.lit(False))
    hot = F.coalesce(extreme | angry, F.lit(False))
    scenario = F.when(hot, "high_emotion").otherwise(F.coalesce(by_rule, F.when(doubted | low, "low_confidence"), F.lit("")))
    ranks = F.create_map(*[F.lit(x) for r in rules for x in (r[1], r[2])], F.lit("high_emotion"), F.lit("high"), F.lit("low_confidence"), F.lit("low"))
    told = F.create_map(*[F.lit(x) for r in rules for x in (r[1], reasons.get(r[1], r[1]))], F.lit(""), F.lit(""))
    label = F.col("scenario")
    reason = F.when(label == "high_emotion", F.when(extreme, lex.EXTREME_REASON).otherwise(lex.ANGRY_REASON)).when(label == "low_confidence", F.when(doubted, lex.UNSURE_REASON).otherwise(lex.LOW_REASON)).otherwise(told[label])
    return df.withColumn("scenario", scenario).withColumn("needs_human", label != "").withColumn("priority", F.coalesce(ranks[label], F.lit(""))).withColumn("reason", reason)


def reply_template(scenario: Column) -> Column:
    """X7."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in lex.REPLIES.items() for x in kv])[scenario], F.lit(lex.DEFAULT_REPLY))


def policy_scenarios(text: Column, rules: Sequence[tuple] = lex.POLICY_RULES) -> Column:
    """All scenarios with a hit, in order."""
    if sum(len(r[2]) for r in rules) > FEW:
        ordered = sorted(rules)
        return F.transform(group_numbers(text, [r[2] for r in ordered]), lambda i: F.get(F.array(*(F.lit(r[1]) for r in ordered)), i))
    return F.array_compact(F.array(*(F.when(any_of(text, words), F.lit(label)) for _, label, words in sorted(rules))))


def policy_answer(df: DataFrame, lines: DataFrame, text: str = "text", rules: Sequence[tuple] = lex.POLICY_RULES) -> DataFrame:
    """Lines (scenario, pos, line) of all scenarios hit, repeats out, joined. `lines` is a small table of the caller's policy."""
    asked = df.select("id", F.posexplode(policy_scenarios(F.col(text), rules)).alias("at", "scenario"))
    found = asked.join(lines, "scenario").groupBy("id", "line").agg(F.min(F.struct("at", "pos")).alias("first"))
    return found.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "line"))), lambda x: x["line"]), "\n").alias("reply"))


def needs_web(n_docs: Column, level: Column) -> Column:
    """X10."""
    return (F.coalesce(n_docs, F.lit(0)) == 0) | (level >= 4)


def handoff(df: DataFrame, memory_chars: int = 500) -> DataFrame:
    """X11: one JSON record for the agent; empty entities are left out, the memory is cut to `memory_chars`, the reason is the escalation's."""
    entities = F.map_filter(F.create_map(*[x for c in ("order_id", "tracking_number", "product_name") for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: F.length(empty(v)) > 0)
    record = F.struct("text", "intent", "emotion", entities.alias("entities"), F.substring(empty(F.col("memory")), 1, memory_chars).alias("memory"), "attempts", "reason")
    return df.withColumn("handoff", F.to_json(record))


def prefix_product(query: Column, product: Column) -> Column:
    """X12."""
    p = empty(product)
    return F.when((p != "") & ~F.contains(empty(query), p), F.concat(p, F.lit(" "), empty(query))).otherwise(query)
