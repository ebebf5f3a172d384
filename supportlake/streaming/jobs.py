"""Streams of log rows, messages, tickets and files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from supportlake.functions import lexicons as lex
from supportlake.operators import chunk, clean, index, oplog


def stream_daily_stats(log: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The columns of the daily statistics, one row a day once the watermark has passed it; later rows are dropped. Also over a table."""
    n = log.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", "1 day")).agg(*oplog.daily_columns())
    return n.select(F.col("window.start").alias("day"), *(c for c in n.columns if c != "window"))


def stream_rate(events: DataFrame, key: str, seconds: int = 60, limit: int = 120, watermark: str = "5 minutes") -> DataFrame:
    """Requests of a key in fixed windows, flagged above the limit."""
    n = events.withWatermark("ts", watermark).groupBy(F.window("ts", f"{seconds} seconds"), key).agg(F.count("*").alias("requests"))
    return n.select(F.col("window.start").alias("start"), key, "requests", (F.col("requests") > limit).alias("over"))


MEMORY = "session_id string, turns int, last_text string, n_entities int, ledger string"
#: Turns that a session's state keeps, and characters of each.
KEPT_TURNS, KEPT_CHARS = 60, 180


def _values(text: str, rules) -> Iterator[tuple[str, str]]:
    """(type, value) of the entities of a text, as the batch operator extracts them."""
    for kind, pattern in rules:
        for found in re.findall(pattern, text):
            if kind == "coupon":
                yield kind, re.sub(r"\s+", "", found)
            elif kind == "order":
                yield kind, re.sub(r"^订单号\s*[:：]?\s*", "", found).strip()
            else:
                yield kind, found.strip()


def _remember(kept_turns: int, kept_chars: int, idle_minutes: int, rules):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns, texts, known = state.get if state.exists else (0, "[]", "{}")
        kept, ledger = json.loads(texts), json.loads(known)
        for b in batches:
            for number, t in b.sort_values("msg_id")[["msg_id", "content"]].fillna({"content": ""}).itertuples(index=False):
                turns += 1
                kept = [*kept, t[:kept_chars]][-kept_turns:]
                for kind, value in _values(t, rules):
                    ledger[f"{kind}:{value}"] = int(number)  # the latest message, in order of first sight
        state.update((turns, json.dumps(kept), json.dumps(ledger)))
        state.setTimeoutDuration(idle_minutes * 60 * 1000)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [turns], "last_text": [kept[-1] if kept else ""], "n_entities": [len(ledger)], "ledger": [json.dumps(ledger, ensure_ascii=False)]})

    return step


def stream_session_memory(messages: DataFrame, kept_turns: int = KEPT_TURNS, kept_chars: int = KEPT_CHARS, idle_minutes: int = 30, rules=lex.ENTITIES) -> DataFrame:
    """Turns, recent texts and the entity ledger of a session as keyed state, dropped after silence."""
    users = messages.filter("role = 'user'").select("session_id", "msg_id", "content")
    return users.groupBy("session_id").applyInPandasWithState(_remember(kept_turns, kept_chars, idle_minutes, rules), MEMORY, "turns int, texts string, ledger string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def latest_versions(batch: DataFrame, order: str | None) -> DataFrame:
    """One row a source: the greatest of `order`, equal ones by the greater text; without an order the greater text. Nulls come first."""
    by = F.struct(*([F.col(order).isNotNull(), F.col(order)] if order else []), F.col("text").isNotNull(), F.col("text"))
    return batch.groupBy("source_file").agg(F.max_by("text", by).alias("text"), F.max(F.col(order) if order else F.lit(None)).cast("long").alias("_order"))


def stream_ingest(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str, overlap: int = 80, order: str | None = None):
    """New documents (source_file, text) cleaned, chunked and put in place of their source's rows, batch by batch.

    `order` names a whole-number column (a version, a time in microseconds) that orders the versions of a source within a batch and across
    batches; an older one that comes late changes nothing. Without it a later batch replaces an earlier one. The index store
    takes each batch once, under the checkpoint's name and the batch's number, so a batch that is repeated after a stop
    has no effect. A source whose text comes to nothing loses its rows.
    """
    store = index.IndexStore(spark, folder, index.BUCKETS)

    def put(batch: DataFrame, number: int) -> None:
        last = latest_versions(batch, order)
        cleaned = last.select("source_file", "_order", clean.clean_text(F.col("text")).alias("text"), F.lit(None).cast("string").alias("doc_type"))
        rows = chunk.number_chunks(chunk.with_overlap(chunk.split_chosen(cleaned.drop("_order"), overlap=overlap))).withColumn("access_level", F.lit(0))
        names = last.select("source_file", "_order")
        placed = index.index_rows(rows)
        if order is not None:
            placed = placed.join(names.withColumnRenamed("source_file", "_s"), placed["source_file"].eqNullSafe(F.col("_s"))).drop("_s")
        store.replace(f"{checkpoint}#{number}", placed, names, "_order" if order else None)

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_agent_replies(messages: DataFrame) -> DataFrame:
    """New replies of agents (id, session_id, role, content), each once, as the checkpoint remembers what was sent."""
    return messages.filter("role = 'agent'").select("session_id", "id", "content")


def stream_alerts(log: DataFrame, limits: dict[str, float] | None = None, watermark: str = "1 day") -> DataFrame:
    """One row a day and metric of the daily statistics above its limit. `p99_ms` is the approximate percentile, as a stream keeps no ranks."""
    return oplog.alerts(stream_daily_stats(log, watermark), limits or oplog.LIMITS)


def stream_tickets(changes: DataFrame) -> DataFrame:
    """The latest state of each ticket, in update mode."""
    return changes.groupBy("id").agg(F.max_by(F.struct("status", "resolution", "assigned_to"), "changed_at").alias("s"), F.max("changed_at").alias("changed_at")).select("id", "s.*", "changed_at")


RUNS = "service string, started timestamp, ended timestamp, failures int"


def _failures(n: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, start, end = state.get if state.exists else (0, None, None)
        out = []
        for b in batches:
            for ts, ok in b.sort_values(["ts", "seq"])[["ts", "ok"]].itertuples(index=False):
                if ok:
                    if count >= n:
                        out.append((key[0], pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), count))
                    count, start, end = 0, None, None
                else:
                    us = pd.Timestamp(ts).value // 1000
                    count, start, end = count + 1, us if start is None else start, us
        state.update((count, start or 0, end or 0))
        if out:
            yield pd.DataFrame(out, columns=["service", "started", "ended", "failures"])

    return step


def stream_failure_runs(events: DataFrame, n: int) -> DataFrame:
    """Runs of n failures or more, sent when a success ends them."""
    return events.groupBy("service").applyInPandasWithState(_failures(n), RUNS, "n int, start long, end long", "append", GroupStateTimeout.NoTimeout)
