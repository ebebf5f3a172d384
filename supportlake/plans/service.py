"""Queries for conversations (M*), orders (B*), the log (N*), answers (A*) and failure runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import answers as an
from supportlake.operators import oplog as ol
from supportlake.operators import orders as od
from supportlake.operators import safety as sa
from supportlake.operators import sessions as se
from supportlake.plans.derived import LOG, log, messages, orders, table, tracking
from supportlake.streaming import jobs

MSG = "(SELECT conv_id AS session_id, turn AS msg_id, role, text AS content FROM conversations)"


def _turns(spark, sf_dir):
    """A user's message with the assistant's next one, if that comes before the user's next."""
    w = Window.partitionBy("session_id").orderBy("msg_id")
    m = messages(spark, sf_dir).filter("role in ('user', 'assistant')").withColumn("_r", F.lead("role").over(w)).withColumn("_t", F.lead("content").over(w))
    reply = F.when(F.col("_r") == "assistant", F.col("_t"))
    return m.filter("role = 'user'").select("session_id", F.col("msg_id").alias("turn"), F.col("content").alias("user_text"), reply.alias("assistant_text"))


TURNS = f"""(SELECT session_id, msg_id AS turn, content AS user_text, reply AS assistant_text FROM (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(content) OVER w END AS reply FROM {MSG}
 WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY msg_id)) WHERE role = 'user')"""


def m01_turn_counts(spark, sf_dir):
    return se.turn_counts(messages(spark, sf_dir))


def m02_recent(spark, sf_dir):
    return se.recent(messages(spark, sf_dir), 1).select("session_id", "msg_id", "role")


def m03_context_window(spark, sf_dir):
    return se.context_window(messages(spark, sf_dir), 600, 2).select("session_id", "msg_id")


M03_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_id DESC) AS rn, count(*) OVER (PARTITION BY session_id) AS c FROM {MSG}),
j AS (SELECT *, sum(CASE WHEN rn <= 2 THEN length(coalesce(content, '')) END) OVER (PARTITION BY session_id) + least(2, c) - 1 AS joined FROM r),
u AS (SELECT *, CASE WHEN joined = 0 THEN 0 ELSE greatest(1, floor(joined / 1.8)) END AS used,
 sum(CASE WHEN rn > 2 AND length(coalesce(content, '')) > 0 THEN greatest(1, floor(length(content) / 1.8)) ELSE 0 END) OVER (PARTITION BY session_id ORDER BY msg_id DESC ROWS UNBOUNDED PRECEDING) AS older FROM j)
SELECT session_id, msg_id FROM u WHERE rn <= 2 OR (used < 600 AND older <= 600 - used)"""


def m06_entities(spark, sf_dir):
    """M6, M7: numbers and capitalised words of conversations as entities, one ledger entry each."""
    rules = (("order", r"[A-Z][a-z]{9,}"), ("amount", r"[0-9]+(?:\.[0-9]+)?"))
    return se.ledger(se.entities(messages(spark, sf_dir), rules))


M06_SQL = f"""WITH e AS (SELECT session_id, msg_id, 'order' AS type, unnest(regexp_extract_all(coalesce(content, ''), '[A-Z][a-z]{{9,}}')) AS value FROM {MSG} UNION ALL SELECT session_id, msg_id, 'amount', unnest(regexp_extract_all(coalesce(content, ''), '[0-9]+(?:\\.[0-9]+)?')) FROM {MSG})
SELECT session_id, type, value, min(msg_id) AS first_msg, max(msg_id) AS last_msg, count(*) AS times FROM e GROUP BY ALL"""


def m09_recall(spark, sf_dir):
    """Each session's last user turn as the query, recalled against turns older than the last one."""
    t = _turns(spark, sf_dir)
    q = t.groupBy("session_id").agg(F.max_by("user_text", "turn").alias("query")).withColumn("query_id", F.col("session_id"))
    return se.recall_history(q, t, 1, 0.15, 2).select("query_id", "rank", "turn", "score")


PAIRS = "list_distinct(list_transform(range(1, length({a})), lambda i: substring({a}, i, 2)))"
M09_SQL = f"""WITH t AS (SELECT session_id, turn, user_text AS u, '用户: ' || coalesce(user_text, '') || ' 客服: ' || coalesce(assistant_text, '') AS both, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM {TURNS}),
s AS (SELECT q.session_id AS query_id, t.turn, round(CASE WHEN length(q.u) >= 2 THEN len(list_intersect({PAIRS.format(a="q.u")}, {PAIRS.format(a="t.both")})) / len({PAIRS.format(a="q.u")}) ELSE 0 END, 6) AS score FROM t q JOIN t ON t.session_id = q.session_id WHERE q.rn = 1 AND t.rn > 1)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn) AS rank, turn, score FROM s WHERE score > 0.15) WHERE rank <= 2"""


def m11_rolling_summary(spark, sf_dir):
    """What the turns before the last one leave."""
    return se.rolling_summary(_turns(spark, sf_dir), 1).select("session_id", F.md5("summary").alias("summary_md5"))


M11_SQL = f"""WITH t AS (SELECT session_id, msg_id, content, row_number() OVER (PARTITION BY session_id ORDER BY msg_id DESC) AS rn FROM {MSG} WHERE role = 'user')
SELECT session_id, md5(string_agg('[' || substring(coalesce(content, ''), 1, 40) || ']', chr(10) ORDER BY msg_id)) AS summary_md5 FROM t WHERE rn > 1 GROUP BY session_id"""


def m13_history(spark, sf_dir):
    return se.history_text(messages(spark, sf_dir), 6).select("session_id", F.md5("history").alias("history_md5"))


M13_SQL = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_id DESC) AS rn FROM {MSG})
SELECT session_id, md5(string_agg(role || ': ' || substring(coalesce(content, ''), 1, 200), chr(10) ORDER BY msg_id)) AS history_md5 FROM t WHERE rn <= 6 GROUP BY session_id"""


def b01_order_lookup(spark, sf_dir):
    """A request for each order: every second one by its owner, the others by the next customer, every tenth as an admin. All get a reply."""
    o = orders(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit(" ord"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("order_no"), (F.col("o_custkey") + F.pmod("o_orderkey", F.lit(2))).alias("user_id"), (F.pmod("o_orderkey", F.lit(10)) == 0).alias("is_admin"))
    out = od.order_replies(asked, od.order_lookup(asked, o, tracking(spark, sf_dir)))
    return out.select("request_id", "found", F.md5(F.regexp_replace("reply", "下单时间: .*", "下单时间")).alias("reply_md5"))


B01_SQL = """WITH t AS (SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, 'T-' || l_orderkey || '-' || l_linenumber, l_returnflag)) AS carrier, arg_max('T-' || l_orderkey || '-' || l_linenumber, (l_shipdate, 'T-' || l_orderkey || '-' || l_linenumber, l_returnflag)) AS tracking_number, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS request_id, 'ORD' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_no, o_orderstatus AS status, o_totalprice AS price, carrier, tracking_number, CAST(CAST(shipped AS DATE) + 3 AS VARCHAR) AS eta, o_orderkey % 2 = 0 OR o_orderkey % 10 = 0 AS found FROM orders LEFT JOIN t ON l_orderkey = o_orderkey)
SELECT request_id, found, md5(CASE WHEN found THEN '订单 ' || order_no || '：' || status || chr(10) || '- 下单时间' || chr(10) || '- 订单金额: ¥' || CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) || coalesce(chr(10) || '- 承运商: ' || carrier || ' (' || tracking_number || ')', '') || coalesce(chr(10) || '- 预计送达: ' || eta, '')
 ELSE '未查询到订单 ' || order_no || ' 的记录（或不属于当前账号），请核对订单号，或联系人工客服查询。' END) AS reply_md5 FROM o"""


def b04_ticket_queue(spark, sf_dir):
    """Orders as tickets: pending ones by priority and age, resolved ones by their customer."""
    o = table(spark, sf_dir, "orders")
    priority = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low")
    t = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), priority.alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("resolved").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("resolution"), F.col("o_orderdate").alias("resolved_at"))
    busy = od.in_human_mode(od.latest_resolution(t), t)
    return busy.select("session_id", "resolution")


B04_SQL = """WITH r AS (SELECT o_custkey AS session_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS resolution FROM orders WHERE o_orderstatus <> 'O' AND coalesce(o_orderpriority, '') <> '' GROUP BY o_custkey)
SELECT * FROM r WHERE session_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"""


def b04_queue_head(spark, sf_dir):
    """The first fifty open tickets by priority, then newest; orders as tickets."""
    o = table(spark, sf_dir, "orders")
    priority = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low")
    status = F.when(F.col("o_orderstatus") == "O", "pending").otherwise("resolved")
    return od.ticket_queue(o.select(F.col("o_orderkey").alias("id"), priority.alias("priority"), status.alias("status"), F.col("o_orderdate").alias("created_at")), 50).select("id", "priority")


B04_HEAD_SQL = """SELECT o_orderkey AS id, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' ELSE 'low' END AS priority FROM orders WHERE o_orderstatus = 'O'
ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 50"""


def n01_cost_by_model(spark, sf_dir):
    return ol.with_cost(log(spark, sf_dir)).groupBy("model_used").agg(F.count("*").alias("n"), F.round(F.sum("llm_cost"), 4).alias("cost"))


N01_SQL = f"""SELECT model_used, count(*) AS n, round(sum(round(CASE model_used WHEN 'qwen-plus' THEN prompt_tokens / 1000 * 0.001 + completion_tokens / 1000 * 0.002 WHEN 'qwen3.7-plus' THEN prompt_tokens / 1000 * 0.004 + completion_tokens / 1000 * 0.012 ELSE prompt_tokens / 1000 * 0.001 + completion_tokens / 1000 * 0.002 END, 6)), 4) AS cost FROM {LOG} GROUP BY model_used"""


def n02_daily_stats(spark, sf_dir):
    return ol.daily_stats(ol.with_cost(log(spark, sf_dir))).withColumn("day", F.col("day").cast("string"))


PRICE = """round(CASE model_used WHEN 'qwen-plus' THEN prompt_tokens / 1000 * 0.001 + completion_tokens / 1000 * 0.002 WHEN 'qwen3.7-plus' THEN prompt_tokens / 1000 * 0.004 + completion_tokens / 1000 * 0.012 ELSE prompt_tokens / 1000 * 0.001 + completion_tokens / 1000 * 0.002 END, 6)"""
N02_SQL = f"""SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, count(*) AS n_queries, round(sum({PRICE}), 4) AS llm_cost, round(sum(embedding_cost), 4) AS embedding_cost, round(sum({PRICE} + embedding_cost), 4) AS cost, round(avg(total_time_ms), 1) AS avg_ms,
 round(avg(CASE WHEN hallucination_detected THEN 1.0 ELSE 0.0 END), 4) AS hallucination_rate, round(avg(CASE WHEN cache_hit = 'hit' THEN 1.0 ELSE 0.0 END), 4) AS cache_hit_rate, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens,
 CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM {LOG} GROUP BY 1"""


def n03_intent_mix(spark, sf_dir):
    return ol.intent_mix(log(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "intent", "n", "place")


N03_SQL = f"""SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, intent) AS place FROM (SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, intent, count(*) AS n FROM {LOG} GROUP BY ALL)"""


def n04_rank_p99(spark, sf_dir):
    return ol.rank_p99(log(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "p99_ms")


N04_SQL = f"""WITH r AS (SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, total_time_ms AS p99_ms, row_number() OVER (PARTITION BY CAST("timestamp" AS DATE) ORDER BY total_time_ms DESC) AS rn, count(*) OVER (PARTITION BY CAST("timestamp" AS DATE)) AS n FROM {LOG})
SELECT day, p99_ms FROM r WHERE rn = greatest(0, CAST(floor(n * 0.01) AS BIGINT) - 1) + 1"""


def n05_recent_queries(spark, sf_dir):
    return ol.recent_queries(log(spark, sf_dir), 20).select("query_id", "intent", "total_time_ms")


def n06_alerts(spark, sf_dir):
    daily = ol.daily_stats(ol.with_cost(log(spark, sf_dir))).join(ol.rank_p99(log(spark, sf_dir)), "day")
    return ol.alerts(daily, {"hallucination_rate": 0.05, "p99_ms": 100.0, "cost": 10.0}).select(F.col("day").cast("string").alias("day"), "metric", F.round("value", 6).alias("value"), "limit_value")


N06_SQL = f"""WITH d AS ({N02_SQL}), p AS ({N04_SQL}) SELECT day, 'hallucination_rate' AS metric, hallucination_rate AS value, 0.05::DOUBLE AS limit_value FROM d WHERE hallucination_rate > 0.05 UNION ALL SELECT day, 'p99_ms', round(p99_ms, 6), 100.0::DOUBLE FROM p WHERE p99_ms > 100 UNION ALL SELECT day, 'cost', round(cost, 6), 10.0::DOUBLE FROM d WHERE cost > 10"""


def n07_hit_rate(spark, sf_dir):
    return ol.hit_rate(log(spark, sf_dir))


def _since_epoch(unit: str, column: str):
    """The events' times carry no zone, so the session's zone plays no part."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def w02_request_rate(spark, sf_dir):
    """W2 over a table: requests of a user in fixed windows of a minute, by the stream's own operator."""
    return jobs.stream_rate(table(spark, sf_dir, "events"), "user_id", 60, 3).withColumn("start", _since_epoch("SECOND", "start"))


def w07_failure_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("service"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return ol.failure_runs(e, 2, largest=1000).select("service", _since_epoch("MICROSECOND", "started").alias("started"), _since_epoch("MICROSECOND", "ended").alias("ended"), "failures")


W07_SQL = """WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT CAST(user_id AS VARCHAR) AS service, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS failures FROM r WHERE event_type = 'error' GROUP BY user_id, run HAVING count(*) >= 2"""


def a02_claim_scores(spark, sf_dir):
    """Labels as verdicts of their document's source: quality is support, toxic text a hallucination."""
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    verdict = F.when(F.col("toxic") == 1, "no").when(F.col("quality") == 1, "Supported").otherwise("部分")
    claims = lab.select(F.col("source").alias("answer_id"), verdict.alias("verdict"))
    answers = table(spark, sf_dir, "documents").select(F.col("source").alias("answer_id")).distinct()
    return an.claim_scores(answers, claims)


A02_SQL = """WITH c AS (SELECT source, CASE WHEN toxic = 1 THEN 'h' WHEN quality = 1 THEN 's' ELSE 'p' END AS v FROM labels JOIN documents USING (doc_id)),
n AS (SELECT source, round((count(*) FILTER (v = 's') + 0.5 * count(*) FILTER (v = 'p')) / count(*), 4) AS f, count(*) FILTER (v = 'h') AS h FROM c GROUP BY source)
SELECT a.source AS answer_id, coalesce(f, 0) AS faithfulness, coalesce(h, 0) > 0 OR coalesce(f, 0) < 0.6 AS has_hallucination FROM (SELECT DISTINCT source FROM documents) a LEFT JOIN n USING (source)"""


def a06_quality_gate(spark, sf_dir):
    """Log rows as answers: latency scaled to a score, the kind of event as text."""
    e = log(spark, sf_dir).select("query_id", F.when(F.col("intent") == "purchase", "承诺 30 元").otherwise(F.col("intent")).alias("answer"), F.round(F.least(F.lit(1.0), F.col("total_time_ms") / 100), 6).alias("faithfulness"), F.pmod("query_id", F.lit(6)).cast("int").alias("degradation_level"), F.pmod("query_id", F.lit(4)).cast("int").alias("loop_count"))
    return an.quality_gate(e).select("query_id", "passed", sa.needs_review(F.col("answer"), F.col("faithfulness")).alias("review"))


A06_SQL = f"""WITH e AS (SELECT query_id, intent = 'purchase' AS st, round(least(1.0, total_time_ms / 100), 6) AS f, query_id % 6 AS lv, query_id % 4 AS lc FROM {LOG}), b AS (SELECT *, f < CASE WHEN st THEN 0.85 ELSE 0.7 END AS below FROM e)
SELECT query_id, CASE WHEN lc >= 3 THEN NOT (st AND below) ELSE NOT (below OR lv >= 4) END AS passed, st AND f < 0.85 AS review FROM b"""

QUERIES = {
    f.__name__: f
    for f in (
        m01_turn_counts, m02_recent, m03_context_window, m06_entities, m09_recall, m11_rolling_summary, m13_history, b01_order_lookup, b04_ticket_queue, b04_queue_head, n01_cost_by_model, n02_daily_stats, n03_intent_mix, n04_rank_p99,
        n05_recent_queries, n06_alerts, n07_hit_rate, w02_request_rate, w07_failure_runs, a02_claim_scores, a06_quality_gate,
    )
}
ORACLES = {
    "m01_turn_counts": f"SELECT session_id, count(*) FILTER (role = 'user') AS turns FROM {MSG} GROUP BY session_id",
    "m02_recent": f"SELECT session_id, msg_id, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_id DESC) AS rn FROM {MSG}) WHERE rn <= 2",
    "m03_context_window": M03_SQL, "m06_entities": M06_SQL, "m09_recall": M09_SQL, "m11_rolling_summary": M11_SQL, "m13_history": M13_SQL, "b01_order_lookup": B01_SQL, "b04_ticket_queue": B04_SQL, "b04_queue_head": B04_HEAD_SQL, "n01_cost_by_model": N01_SQL,
    "n02_daily_stats": N02_SQL, "n03_intent_mix": N03_SQL, "n04_rank_p99": N04_SQL, "n05_recent_queries": f'SELECT query_id, intent, total_time_ms FROM {LOG} ORDER BY "timestamp" DESC, query_id LIMIT 20', "n06_alerts": N06_SQL,
    "n07_hit_rate": f"SELECT round(count(*) FILTER (cache_hit = 'hit') / count(*) FILTER (cache_hit IN ('hit', 'miss')), 6) AS hit_rate FROM {LOG}",
    "w02_request_rate": "SELECT CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS start, user_id, count(*) AS requests, count(*) > 3 AS over FROM events GROUP BY 1, 2", "w07_failure_runs": W07_SQL, "a02_claim_scores": A02_SQL, "a06_quality_gate": A06_SQL,
}
