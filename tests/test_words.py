"""Rule tables of many words against a search for each word."""

import random

import pytest
from pyspark.sql import functions as F

from supportlake.functions import lexicons as lex
from supportlake.functions import text as tx
from supportlake.functions.words import FEW, group_numbers
from supportlake.operators import retrieve, rules

SHAPE = "id int, text string, query string"


def padded(words, n=FEW):
    """The same words and many that no text holds."""
    return (*words, *(f"zq{k}x" for k in range(n)))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    known = [w for r in lex.INTENT_RULES for w in r[3]] + list(lex.EXTREME + lex.ANGRY) + [m for h, v in lex.SYNONYMS.items() for m in (h, *v)]
    rows = [(k, "".join(rng.choice([*known, "好", "，", "！", "x"]) for _ in range(rng.randint(0, 12)))) for k in range(300)] + [(300, None), (301, ""), (302, "退" * 50_000 + "款退货")]
    return spark.createDataFrame([(k, t, t) for k, t in rows], SHAPE)


def same(a, b):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(a) == rows(b)


def test_group_numbers_by_both_forms(texts):
    groups = [("退款", "退"), (), ("款退", "货"), ("",), ("退款",), ("退退退退退退退款",)]
    both = texts.select("id", group_numbers(F.col("text"), groups).alias("a"), group_numbers(F.col("text"), groups, few=0).alias("b")).collect()
    assert all(r.a == r.b for r in both)
    plain = {r.id: [k for k, g in enumerate(groups) if any(w in (r.text or "") for w in g)] for r in texts.collect()}
    assert {r.id: r.b for r in both} == plain
    assert texts.select(group_numbers(F.col("text"), [()], few=-1).alias("b")).distinct().collect() == [([],)]


def test_large_rule_tables_give_the_same_labels(texts):
    large = tuple((*r[:3], padded(r[3])) for r in lex.INTENT_RULES)
    same(rules.classify_intent(texts, large), rules.classify_intent(texts))
    same(rules.emotion(texts, extreme=padded(lex.EXTREME), angry=padded(lex.ANGRY)), rules.emotion(texts))
    of = lambda r: texts.select("id", rules.policy_scenarios(F.col("text"), r).alias("x"))
    same(of(tuple((a, b, padded(w)) for a, b, w in lex.POLICY_RULES)), of(lex.POLICY_RULES))
    judged = texts.withColumns({"emotion": F.lit("calm"), "intent": F.lit("x"), "answer": F.lit(""), "confidence": F.lit(0.9)})
    same(rules.escalate(judged, tuple((a, b, c, padded(w)) for a, b, c, w in lex.HUMAN_RULES), padded(lex.UNSURE)), rules.escalate(judged))
    same(texts.select("id", tx.hits(F.col("text"), padded(lex.EXTREME)).alias("x")), texts.select("id", tx.hits(F.col("text"), lex.EXTREME).alias("x")))


def test_large_synonym_tables_expand_the_same(texts):
    large = lex.SYNONYMS | {f"zq{k}x": (f"zq{k}y",) for k in range(FEW)}
    same(retrieve.expand_synonyms(texts, large), retrieve.expand_synonyms(texts))
