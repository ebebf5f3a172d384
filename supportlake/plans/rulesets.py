"""Queries for rules (X*), privacy and guards (G*) and answers (A*), with rule words of the data's language where the defaults have none there."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import answers as an
from supportlake.operators import rules as ru
from supportlake.operators import safety as sa
from supportlake.plans.derived import LOG, log, table

INTENTS = ((1, "return_refund", 0.6, ("the ",)), (2, "logistics", 0.6, ("que", "der ")), (3, "order_query", 0.3, ("le ",)))
POLICIES = ((1, "quality", ("tion",)), (2, "freight", ("ough", "und")), (3, "window", ("ment", "ung")))
HUMANS = ((1, "refund_request", "high", ("oux",)), (2, "complaint", "high", ("ungen",)), (3, "high_value_order", "medium", ("ando",)))
FOLLOW = ("es ", "an ")
ANGRY, EXTREME, SLOW = ("ich",), ("ough",), ("et ",)


def _asked(spark, sf_dir):
    """Conversation turns with intent, follow-up rule, emotion and numbers taken as order ids."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    c = ru.reroute_followup(ru.classify_intent(c, INTENTS), FOLLOW)
    number = F.regexp_extract("text", "[0-9]{2,}", 0)
    return ru.emotion(c.withColumn("order_id", number).withColumn("tracking_number", F.lit("")), "text", EXTREME, ANGRY, SLOW)


ASKED = r"""(SELECT *, CASE WHEN i = 'chitchat' AND follow THEN 'product_consult' ELSE i END AS intent, CASE WHEN i = 'chitchat' AND follow THEN 0.5 ELSE conf END AS confidence,
 CASE WHEN text = '' THEN 'calm' WHEN contains(text, 'ough') THEN 'extreme' WHEN contains(text, 'ich') OR marks >= 2 THEN 'angry' WHEN contains(text, 'et ') THEN 'dissatisfied' ELSE 'calm' END AS emotion FROM (SELECT conv_id, turn, text,
 CASE WHEN contains(l, 'the ') THEN 'return_refund' WHEN contains(l, 'que') OR contains(l, 'der ') THEN 'logistics' WHEN contains(l, 'le ') THEN 'order_query' ELSE 'chitchat' END AS i,
 CASE WHEN contains(l, 'the ') OR contains(l, 'que') OR contains(l, 'der ') THEN 0.6 WHEN contains(l, 'le ') THEN 0.3 ELSE 0.4 END AS conf, contains(text, 'es ') OR contains(text, 'an ') AS follow,
 length(text) - length(replace(replace(text, '!', ''), '！', '')) AS marks, regexp_extract(text, '[0-9]{2,}') AS order_id FROM (SELECT conv_id, turn, coalesce(text, '') AS text, lower(coalesce(text, '')) AS l FROM conversations)))"""


def x03_routing(spark, sf_dir):
    """Follow-ups, targets and branches of conversation turns; angry turns ask for a human."""
    routed = ru.route_target(_asked(spark, sf_dir)).withColumn("needs_human", F.col("emotion") == "extreme")
    return ru.branch(routed, POLICIES).select("conv_id", "turn", "intent", "confidence", "target", "branch")


X03_SQL = f"""WITH a AS (SELECT *, CASE WHEN intent IN ('order_query', 'logistics') AND order_id <> '' THEN CASE WHEN confidence < 0.4 THEN 'rag' ELSE 'sql' END WHEN intent = 'chitchat' THEN 'direct' ELSE 'rag' END AS target FROM {ASKED})
SELECT conv_id, turn, intent, confidence, target, CASE WHEN emotion = 'extreme' THEN 'human' WHEN intent = 'return_refund' AND regexp_matches(text, 'tion|ough|und|ment|ung') THEN 'policy' ELSE target END AS branch FROM a"""


def x06_escalation(spark, sf_dir):
    """Escalation, the reply for its scenario, and the handoff record of conversation turns."""
    a = _asked(spark, sf_dir).withColumn("answer", F.when(F.pmod("turn", F.lit(5)) == 0, "不确定").otherwise(""))
    e = ru.escalate(a, HUMANS).withColumn("reply", ru.reply_template(F.col("scenario")))
    e = e.withColumn("product_name", F.lit("")).withColumn("memory", F.repeat("text", F.lit(3))).withColumn("attempts", F.col("turn"))
    field = lambda p: F.get_json_object("handoff", p)
    return ru.handoff(e).select(
        "conv_id", "turn", "scenario", "priority", F.md5("reply").alias("reply_md5"), F.coalesce(field("$.entities.order_id"), F.lit("")).alias("order_id"), F.length(field("$.memory")).alias("memory_chars"), field("$.reason").alias("reason"),
    )


def _x06_sql() -> str:
    from supportlake.functions import lexicons as lex

    reply = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lex.REPLIES.items())
    told = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lex.REASONS.items())
    reason = f"""CASE scenario {told} WHEN 'high_emotion' THEN CASE WHEN emotion = 'extreme' THEN '{lex.EXTREME_REASON}' ELSE '{lex.ANGRY_REASON}' END
     WHEN 'low_confidence' THEN CASE WHEN turn % 5 = 0 THEN '{lex.UNSURE_REASON}' ELSE '{lex.LOW_REASON}' END ELSE '' END"""
    rule = "CASE WHEN contains(text, 'oux') THEN 'refund_request' WHEN contains(text, 'ungen') THEN 'complaint' WHEN contains(text, 'ando') THEN 'high_value_order' WHEN turn % 5 = 0 OR confidence < 0.4 THEN 'low_confidence' ELSE '' END"
    return f"""WITH s AS (SELECT *, CASE WHEN emotion = 'extreme' OR (emotion = 'angry' AND intent IN ('return_refund', 'complaint', 'order_query')) THEN 'high_emotion' ELSE {rule} END AS scenario FROM {ASKED})
    SELECT conv_id, turn, scenario, CASE WHEN scenario IN ('high_emotion', 'refund_request', 'complaint') THEN 'high' WHEN scenario = 'high_value_order' THEN 'medium' WHEN scenario = 'low_confidence' THEN 'low' ELSE '' END AS priority,
     md5(CASE scenario {reply} ELSE '{lex.DEFAULT_REPLY}' END) AS reply_md5, order_id, least(500, 3 * length(text)) AS memory_chars, {reason} AS reason FROM s"""


def x09_policy_answers(spark, sf_dir):
    """Policy scenarios of documents and their lines, which are the names of regions here."""
    names = F.element_at(F.array(*(F.lit(r[1]) for r in POLICIES)), F.pmod("r_regionkey", F.lit(3)) + 1)
    lines = table(spark, sf_dir, "region").select(names.alias("scenario"), F.col("r_regionkey").alias("pos"), F.col("r_name").alias("line"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return ru.policy_answer(d, lines, "text", POLICIES)


X09_SQL = """WITH l AS (SELECT r_regionkey AS pos, r_name AS line, r_regionkey % 3 AS s FROM region), d AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, 'tion') THEN 0 END, CASE WHEN contains(text, 'ough') OR contains(text, 'und') THEN 1 END,
 CASE WHEN contains(text, 'ment') OR contains(text, 'ung') THEN 2 END], lambda x: x IS NOT NULL)) AS s FROM documents)
SELECT doc_id AS id, string_agg(line, chr(10) ORDER BY s, pos) AS reply FROM d JOIN l USING (s) GROUP BY doc_id"""


def x12_product_queries(spark, sf_dir):
    """Part names put before their types, and whether a search would go to the web."""
    p = table(spark, sf_dir, "part")
    brand = F.when(F.pmod("p_partkey", F.lit(3)) != 0, F.element_at(F.split("p_type", " "), F.when(F.pmod("p_partkey", F.lit(2)) == 0, 1).otherwise(-1)))
    brand = F.when(F.pmod("p_partkey", F.lit(4)) == 0, F.col("p_brand")).otherwise(brand)
    return p.select("p_partkey", ru.prefix_product(F.col("p_type"), brand).alias("query"), ru.needs_web(F.col("p_size") - 1, F.pmod("p_partkey", F.lit(6))).alias("web"))


X12_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND NOT contains(p_type, p_brand) AND p_brand <> '' THEN p_brand || ' ' || p_type ELSE p_type END AS query, p_size - 1 = 0 OR p_partkey % 6 >= 4 AS web FROM part"""


def g03_detected(spark, sf_dir):
    """Kinds of personal data in documents, and whether a text is safe under the rules with one of the caller's own."""
    own = sa.merged_rules({"邮箱": "[A-Za-z0-9]@[A-Za-z0-9]", "akia": "AKIA[A-Z0-9]{8}"})
    d = sa.detect_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.array_join("found", ",").alias("found"), sa.is_safe(F.col("text"), own).alias("safe"))


#: The rules as DuckDB patterns with the bounding characters as groups 1 and 3: its regular expressions look neither ahead nor behind.
BOUNDED = (
    ("手机号", "(^|[^0-9])(1[3-9][0-9]{9})($|[^0-9])"), ("身份证", "(^|[^0-9])([0-9]{17}[0-9Xx])($|[^0-9])"), ("银行卡", "(^|[^0-9])([0-9]{16,19})($|[^0-9])"),
    ("邮箱", r"(^|[^a-zA-Z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,})($|[^a-zA-Z0-9.])".replace("\\\\", "\\")),
    ("IP地址", r"(^|[^0-9])([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})($|[^0-9])"), ("订单号", "(^|[^a-zA-Z])((?:DD|TB|JD|PDD|DY|MT|E)[0-9]{12,20})($|[^0-9])"),
)


def redacted_sql(text: str) -> str:
    """Each pattern twice, as two neighbours share a bounding character."""
    for label, p in BOUNDED:
        for _ in range(2):
            text = f"regexp_replace({text}, '{p}', '\\1[{label}]\\3', 'g')"
    return text


def _g03_sql() -> str:
    rest, kinds = "coalesce(text, '')", []
    for label, p in BOUNDED:
        kinds.append(f"CASE WHEN regexp_matches({rest}, '{p}') THEN '{label}' END")
        for _ in range(2):
            rest = f"regexp_replace({rest}, '{p}', '\\1□\\3', 'g')"
    own = [p for label, p in BOUNDED if label != "邮箱"] + ["[A-Za-z0-9]@[A-Za-z0-9]", "AKIA[A-Z0-9]{8}"]
    safe = " AND ".join(f"NOT regexp_matches(coalesce(text, ''), '{p}')" for p in own)
    return f"SELECT doc_id, coalesce(array_to_string(list_filter([{', '.join(kinds)}], lambda x: x IS NOT NULL), ','), '') AS found, {safe} AS safe FROM documents"


def g06_document_guard(spark, sf_dir):
    """What the guards of documents and of outputs say of page texts."""
    t = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "\n")
    p = sa.check_document(table(spark, sf_dir, "pages").select("page_id", t.alias("text"))).withColumnRenamed("safe_text", "inner")
    return sa.check_output(p).select("page_id", "suspicious", F.md5("inner").alias("inner_md5"), F.array_join("warnings", ",").alias("warnings"), F.md5("safe_text").alias("safe_md5"))


def _g06_sql() -> str:
    from supportlake.functions import lexicons as lex

    any_of = lambda patterns: "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    warned = ", ".join(f"CASE WHEN regexp_matches(t, '{any_of(p)}') THEN '{n}' END" for n, p in lex.OUTPUT_LEAKS)
    return f"""WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g') AS t FROM pages), w AS (SELECT *, regexp_matches(t, '{any_of(lex.DOCUMENT_ATTACKS)}') AS bad, list_filter([{warned}], lambda x: x IS NOT NULL) AS w FROM p)
    SELECT page_id, bad AS suspicious, md5(CASE WHEN bad THEN '{lex.REMOVED}' ELSE t END) AS inner_md5, coalesce(array_to_string(w, ','), '') AS warnings,
     md5(CASE WHEN len(w) > 0 THEN array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '{any_of(lex.LEAK_LINES)}')), chr(10)) ELSE t END) AS safe_md5 FROM w"""


def g10_access_ranks(spark, sf_dir):
    """Ranks of customers' levels and roles, both written in several ways."""
    n = F.col("c_custkey")
    level = F.element_at(F.array(*map(F.lit, ("public", " VIP", "member", "2", "1", "0", "gold", ""))), F.pmod(n, F.lit(8)).cast("int") + 1)
    role = F.element_at(F.array(*map(F.lit, ("admin", "Member ", "normal", "guest"))), F.pmod(n, F.lit(4)).cast("int") + 1)
    rank, own = tx.access_rank(level), sa.role_rank(role)
    rows = table(spark, sf_dir, "customer").select("c_custkey", rank.cast("int").alias("chunk_rank"), own.cast("int").alias("user_rank"), sa.rank_name(rank).alias("name"), sa.is_admin(role).alias("admin"))
    return rows.withColumn("visible", F.col("chunk_rank") <= F.col("user_rank"))


G10_SQL = """SELECT *, chunk_rank <= user_rank AS visible FROM (SELECT c_custkey, [0, 2, 1, 2, 1, 0, 0, 0][c_custkey % 8 + 1] AS chunk_rank, [2, 1, 0, 0][c_custkey % 4 + 1] AS user_rank,
 ['public', 'vip', 'member', 'vip', 'member', 'public', 'public', 'public'][c_custkey % 8 + 1] AS name, c_custkey % 4 = 0 AS admin FROM customer)"""


def a03_fallback(spark, sf_dir):
    """Log rows as answers without claims; a failed gate asks for a human."""
    e = log(spark, sf_dir)
    answer = F.when(F.col("intent") == "purchase", "没有找到").when(F.col("intent") == "view", "").otherwise(F.col("intent"))
    checked = an.fallback_check(e.select("query_id", answer.alias("answer"), F.pmod("query_id", F.lit(4)).alias("n_docs"), F.lit(1).alias("degradation_level"), F.lit(0).alias("loop_count")))
    return an.surface_review(an.quality_gate(checked).withColumn("needs_human", F.pmod("query_id", F.lit(7)) == 0)).select("query_id", "faithfulness", "has_hallucination", "passed", "needs_human")


A03_SQL = f"""WITH e AS (SELECT query_id, intent = 'view' OR query_id % 4 = 0 AS none, intent = 'purchase' AS honest FROM {LOG}), f AS (SELECT *, CASE WHEN none THEN 0.0 WHEN honest THEN 0.9 ELSE 0.5 END AS faithfulness FROM e)
SELECT query_id, faithfulness, none AS has_hallucination, faithfulness >= 0.7 AND NOT honest AS passed, query_id % 7 = 0 OR NOT (faithfulness >= 0.7 AND NOT honest) AS needs_human FROM f"""


def _claims(spark, sf_dir):
    """Line items as claims of their order, the return flag as the verdict."""
    li = table(spark, sf_dir, "lineitem")
    verdict = F.when(F.col("l_returnflag") == "N", "有依据").when(F.col("l_returnflag") == "A", "无依据").otherwise("部分")
    return li.select(F.col("l_orderkey").alias("answer_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("pos"), F.col("l_partkey").cast("string").alias("text"), verdict.alias("verdict"))


def a04_partial_answers(spark, sf_dir):
    return an.partial_answer(_claims(spark, sf_dir)).select("answer_id", F.md5("answer").alias("answer_md5"))


A04_SQL = """WITH g AS (SELECT l_orderkey AS answer_id, string_agg('- ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) FILTER (l_returnflag = 'N') AS yes,
 string_agg('- ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) FILTER (l_returnflag = 'A') AS no FROM lineitem GROUP BY l_orderkey)
SELECT answer_id, md5(CASE WHEN yes IS NULL THEN '抱歉，根据已有信息无法确认，建议您咨询人工客服。' ELSE '根据已有信息：' || chr(10) || yes || coalesce(chr(10) || '以下内容暂时无法确认：' || chr(10) || no, '') END) AS answer_md5 FROM g"""


def a05_accepted_rounds(spark, sf_dir):
    """A5: line items as correction rounds of their order, three calls each."""
    w = Window.partitionBy("answer_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("answer_id", F.col("l_orderkey")).withColumn("round", F.row_number().over(w))
    rounds = li.select("answer_id", "round", (F.col("l_quantity") / 50).alias("faithfulness"), (F.col("l_returnflag") == "A").alias("has_hallucination"), (F.col("round") * 3).alias("calls"))
    return an.accepted_round(rounds, 0.8, 4).select("answer_id", "round", "accepted")


A05_SQL = """WITH r AS (SELECT l_orderkey AS answer_id, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS round FROM lineitem),
o AS (SELECT answer_id, round, l_returnflag <> 'A' AND l_quantity / 50 >= 0.8 AS accepted FROM r WHERE round <= 4 AND (round = 1 OR (round - 1) * 3 < 8))
SELECT answer_id, round, accepted FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY accepted DESC, CASE WHEN accepted THEN round ELSE -round END) AS rn FROM o) WHERE rn = 1"""

QUERIES = {
    f.__name__: f
    for f in (x03_routing, x06_escalation, x09_policy_answers, x12_product_queries, g03_detected, g06_document_guard, g10_access_ranks, a03_fallback, a04_partial_answers, a05_accepted_rounds)
}
ORACLES = {
    "x03_routing": X03_SQL, "x06_escalation": _x06_sql(), "x09_policy_answers": X09_SQL, "x12_product_queries": X12_SQL, "g03_detected": _g03_sql(), "g06_document_guard": _g06_sql(), "g10_access_ranks": G10_SQL,
    "a03_fallback": A03_SQL, "a04_partial_answers": A04_SQL, "a05_accepted_rounds": A05_SQL,
}
