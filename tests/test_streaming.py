"""Streams run to their end over files and agree with their batch twins."""

import datetime as dt
import json
import tempfile

from pyspark.sql import functions as F

from supportlake.operators import oplog, sessions
from supportlake.operators.indexstore import IndexStore
from supportlake.streaming import jobs


def drained(df, mode="append"):
    name = f"out_{abs(hash(df))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def stream_of(spark, df):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_daily_stats(spark):
    rows = [(dt.datetime(2024, 1, d, 5), float(d), 6.0, 0.5, d == 2, "hit" if d == 1 else None, 10, 5) for d in (1, 1, 2, 9)]
    log = spark.createDataFrame(rows, "timestamp timestamp, total_time_ms double, llm_cost double, embedding_cost double, hallucination_detected boolean, cache_hit string, prompt_tokens long, completion_tokens long")
    got = {r.day.day: (r.n_queries, r.avg_ms, r.cost, r.hallucination_rate, r.cache_hit_rate, r.total_tokens) for r in drained(jobs.stream_daily_stats(stream_of(spark, log))).collect()}
    assert got == {1: (2, 1.0, 13.0, 0.0, 1.0, 30), 2: (1, 2.0, 6.5, 1.0, 0.0, 15)}
    batch = {r.day.day: (r.n_queries, r.avg_ms, r.cost, r.hallucination_rate, r.cache_hit_rate, r.total_tokens) for r in oplog.daily_stats(log).collect()}
    assert {d: v for d, v in batch.items() if d < 9} == got
    alerts = sorted((r.day.day, r.metric) for r in drained(jobs.stream_alerts(stream_of(spark, log), {"hallucination_rate": 0.05, "cost": 10.0, "p99_ms": 1.5})).collect())
    assert alerts == [(1, "cost"), (2, "hallucination_rate"), (2, "p99_ms")]


def test_request_rate(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, s), "k") for s in range(5)] + [(dt.datetime(2024, 1, 1, 1), "k")]
    out = drained(jobs.stream_rate(stream_of(spark, spark.createDataFrame(rows, "ts timestamp, key string")), "key", 60, 4)).collect()
    assert [(r.requests, r.over) for r in out] == [(5, True)]


def test_session_memory(spark):
    m = spark.createDataFrame([("s", 1, "user", "满 300 减 50 券"), ("s", 2, "assistant", "b"), ("s", 3, "user", "OD123456 满300减50券 30元"), ("t", 1, "user", None)], "session_id string, msg_id int, role string, content string")
    out = {r.session_id: (r.turns, r.last_text, r.ledger) for r in drained(jobs.stream_session_memory(stream_of(spark, m)), "update").collect()}
    assert out["t"] == (1, "", "{}") and out["s"][:2] == (2, "OD123456 满300减50券 30元")
    batch = {f"{r.type}:{r.value}": r.last_msg for r in sessions.ledger(sessions.entities(m.filter("role = 'user'"))).collect() if r.session_id == "s"}
    assert json.loads(out["s"][2]) == batch


def test_agent_replies_are_sent_once(spark):
    m = spark.createDataFrame([("s", 1, "agent", "a"), ("s", 2, "user", "b")], "session_id string, id int, role string, content string")
    assert [(r.session_id, r.id) for r in drained(jobs.stream_agent_replies(stream_of(spark, m))).collect()] == [("s", 1)]


def test_tickets_keep_latest_state(spark):
    rows = [(1, "pending", None, None, dt.datetime(2024, 1, 1)), (1, "resolved", "done", "x", dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id int, status string, resolution string, assigned_to string, changed_at timestamp")
    assert [(r.id, r.status) for r in drained(jobs.stream_tickets(stream_of(spark, df)), "update").collect()] == [(1, "resolved")]


def test_failure_runs_equal_batch(spark):
    oks = [False, False, True, False, True, False, False, False, True]
    e = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 0, i), i, ok) for i, ok in enumerate(oks)], "service string, ts timestamp, seq int, ok boolean")
    key = lambda df: sorted((r.service, r.started, r.ended, r.failures) for r in df.collect())
    assert key(drained(jobs.stream_failure_runs(stream_of(spark, e), 2))) == key(oplog.failure_runs(e, 2))


def test_ingest_replaces_sources(spark):
    folder, ck = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index", tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for text in ("the first version of it", "the second version of it"):
        src = stream_of(spark, spark.createDataFrame([("a", text), ("b", "another text of some length")], "source_file string, text string"))
        jobs.stream_ingest(spark, src, folder, tempfile.mkdtemp(dir=ck)).awaitTermination(120)
    out = IndexStore(spark, folder).read().select("source_file", F.col("text"), "chunk_index", "chunk_total").collect()
    assert sorted(map(tuple, out)) == [("a", "the second version of it", 0, 1), ("b", "another text of some length", 0, 1)]
    jobs.stream_ingest(spark, stream_of(spark, spark.createDataFrame([("a", " ")], "source_file string, text string")), folder, tempfile.mkdtemp(dir=ck)).awaitTermination(120)
    assert [r.source_file for r in IndexStore(spark, folder).read().collect()] == ["b"]


def test_ingest_orders_versions(spark):
    """Two versions in one batch, an older one in the next, then an emptied source whose old version comes late."""
    folder, ck, src = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    shape = "source_file string, text string, version int"
    text = "version number {} of this text"

    def feed(*rows):
        spark.createDataFrame(list(rows), shape).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_ingest(spark, spark.readStream.schema(shape).parquet(src), f"{folder}/ix", ck, order="version").awaitTermination(120)
        return {(r.source_file, r.text) for r in IndexStore(spark, f"{folder}/ix").read().collect()}

    assert feed(("a", text.format(2), 2), ("a", text.format(1), 1), ("b", text.format(5), 5)) == {("a", text.format(2)), ("b", text.format(5))}
    assert feed(("a", text.format(3), 3), ("b", text.format(4), 4)) == {("a", text.format(3)), ("b", text.format(5))}
    assert feed(("b", " ", 6), (None, text.format(0), 1)) == {("a", text.format(3)), (None, text.format(0))}
    assert feed(("b", text.format(5), 5)) == {("a", text.format(3)), (None, text.format(0))}
    assert feed(("b", text.format(7), 7)) == {("a", text.format(3)), (None, text.format(0)), ("b", text.format(7))}
    at = IndexStore(spark, f"{folder}/ix").versions()
    assert IndexStore(spark, f"{folder}/ix").replace(f"{ck}#1", spark.createDataFrame([("a", "x")], "source_file string, text string")) is False
    assert IndexStore(spark, f"{folder}/ix").versions() == at
