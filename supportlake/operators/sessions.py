"""Conversation memory (M1-M13) over messages (session_id, msg_id, role, content, …)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import lexicons as lex
from supportlake.functions.text import bigram_overlap, empty
from supportlake.operators import segments


def _newest() -> Window:
    return Window.partitionBy("session_id").orderBy(F.desc("msg_id"))


def turn_counts(messages: DataFrame) -> DataFrame:
    """M1: turns are the user's messages."""
    return messages.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("turns"))


def recent(messages: DataFrame, rounds: int) -> DataFrame:
    """M2: the last 2 x rounds messages."""
    return messages.withColumn("_rn", F.row_number().over(_newest())).filter(F.col("_rn") <= 2 * rounds).drop("_rn")


def message_tokens(c: Column) -> Column:
    """An empty message costs nothing, any other one token at least."""
    return F.when(F.length(empty(c)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(empty(c)) / 1.8).cast("int")))


def context_window(messages: DataFrame, budget: int = 6000, keep: int = 4, largest: int = segments.LARGEST) -> DataFrame:
    """M3: the last `keep` always; older ones newest first while the running total fits what they leave of the budget.

    The running total only grows, so `total <= budget` is the same as stopping at the first overflow. Sessions of more
    than `largest` messages are numbered and added up by ranges.
    """
    last, size = F.col("_rn") <= keep, F.length(empty(F.col("content")))
    kept_length, kept_number, older = F.when(last, size), F.when(last, 1), F.when(~last, message_tokens(F.col("content"))).otherwise(0)
    if segments.giant(messages, "session_id", largest):
        order = [F.desc("msg_id")]
        ranked = segments.with_sums(messages, "session_id", order, running={"_rn": F.lit(1)})
        sized = segments.with_sums(ranked, "session_id", order, running={"_older": older}, totals={"_length": kept_length, "_number": kept_number})
    else:
        whole, upto = Window.partitionBy("session_id"), _newest().rowsBetween(Window.unboundedPreceding, 0)
        ranked = messages.withColumn("_rn", F.row_number().over(_newest()))
        sized = ranked.withColumns({"_older": F.sum(older).over(upto), "_length": F.sum(kept_length).over(whole), "_number": F.sum(kept_number).over(whole)})
    joined = F.col("_length") + F.col("_number") - 1  # joined by spaces
    used = F.when(joined == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(joined / 1.8).cast("int")))
    return sized.withColumn("_used", used).filter(last | ((F.col("_used") < budget) & (F.col("_older") <= budget - F.col("_used")))).drop("_rn", "_used", "_older", "_length", "_number")


def sessions(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """M4: sessions with their last activity, newest first."""
    s = messages.groupBy("session_id").agg(F.max("ts").alias("last_active"), F.count("*").alias("n_messages")).orderBy(F.desc("last_active"), "session_id")
    return s.limit(limit) if limit else s


def history(messages: DataFrame, session_id) -> DataFrame:
    """M4: one session's messages in order."""
    return messages.filter(F.col("session_id") == session_id).orderBy("msg_id")


def upsert_sessions(sessions_: DataFrame, changes: DataFrame) -> DataFrame:
    """M4: create or replace: a session of the changes takes the place of the one of that id."""
    return sessions_.join(changes.select("session_id").distinct(), "session_id", "left_anti").unionByName(changes, allowMissingColumns=True)


def append_messages(sessions_: DataFrame, new: DataFrame) -> DataFrame:
    """M4: last_active rises to the newest message of each session; messages of unknown sessions change nothing."""
    at = new.groupBy("session_id").agg(F.max("ts").alias("_ts"))
    return sessions_.join(at, "session_id", "left").withColumn("last_active", F.greatest("last_active", "_ts")).drop("_ts")


def delete_sessions(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """M4: messages of all other sessions."""
    return messages.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def session_key(user: Column, session: Column) -> Column:
    """M5: keeps users apart that name a session alike."""
    return F.concat_ws(":", user.cast("string"), session.cast("string"))


def entities(messages: DataFrame, rules: Sequence[tuple[str, str]] = lex.ENTITIES, text: str = "content") -> DataFrame:
    """M6: (session_id, msg_id, type, value, pos)."""
    found = [F.transform(F.regexp_extract_all(empty(F.col(text)), F.lit(p), F.lit(0)), _entity(kind)) for kind, p in rules]
    rows = messages.select("session_id", "msg_id", F.posexplode(F.concat(*found)).alias("pos", "e"))
    return rows.select("session_id", "msg_id", "pos", "e.type", "e.value")


def _entity(kind: str):
    plain = lambda v: F.regexp_replace(v, r"\s+", "") if kind == "coupon" else F.trim(F.regexp_replace(v, r"^订单号\s*[:：]?\s*", "")) if kind == "order" else F.trim(v)
    return lambda v: F.struct(F.lit(kind).alias("type"), plain(v).alias("value"))


def ledger(found: DataFrame) -> DataFrame:
    """M7: one entry a type and value: first seen and last seen."""
    at = F.struct("msg_id", "pos")
    return found.groupBy("session_id", "type", "value").agg(F.min(at).alias("f"), F.max("msg_id").alias("last_msg"), F.count("*").alias("times")).select("session_id", "type", "value", F.col("f.msg_id").alias("first_msg"), "last_msg", "times")


def relevant_entities(queries: DataFrame, entries: DataFrame, n: int = 5, words: Sequence[tuple[str, str]] = lex.TYPE_WORDS) -> DataFrame:
    """M8: entries of the session whose value is in the query, or whose type the first type word in the query names; in the ledger's order."""
    asked = F.lit(None).cast("string")
    for word, kind in reversed(words):
        asked = F.when(F.contains(F.col("query"), F.lit(word)), F.lit(kind)).otherwise(asked)
    hit = queries.withColumn("_asked", asked).join(entries, "session_id").filter(((F.length("value") > 0) & F.contains("query", "value")) | (F.col("type") == F.col("_asked"))).drop("_asked")
    order = Window.partitionBy("query_id").orderBy("first_msg", "type", "value")
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def retain(turns: DataFrame, n: int = 60) -> DataFrame:
    """The last n turns (session_id, turn, …)."""
    return turns.withColumn("_rn", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))).filter(F.col("_rn") <= n).drop("_rn")


def folded(turns: DataFrame, window: int = 6) -> DataFrame:
    """Turns older than the last `window` ones."""
    return turns.withColumn("_rn", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))).filter(F.col("_rn") > window).drop("_rn")


def turn_text() -> Column:
    """A turn as one text, both sides."""
    return F.concat(F.lit("用户: "), empty(F.col("user_text")), F.lit(" 客服: "), empty(F.col("assistant_text")))


def recall_history(queries: DataFrame, turns: DataFrame, window: int = 6, min_score: float = 0.15, k: int = 2, chars: int | None = 180) -> DataFrame:
    """M9: folded turns (session_id, turn, user_text, assistant_text) of the session, both sides together, that share enough character pairs with the query."""
    scored = queries.join(folded(turns, window).withColumn("_t", turn_text()), "session_id").withColumn("score", F.round(bigram_overlap(F.col("query"), F.col("_t")), 6)).filter(F.col("score") > min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "turn")
    text = F.col("_t") if chars is None else F.substring("_t", 1, chars)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "turn", "score", text.alias("text"))


def rolling_summary(turns: DataFrame, window: int = 6, chars: int = 40) -> DataFrame:
    """The first `chars` characters of each folded turn, in order."""
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("["), F.substring(empty(F.col("user_text")), 1, chars), F.lit("]")).alias("x"))))
    return folded(turns, window).groupBy("session_id").agg(F.array_join(F.transform(lines, lambda t: t["x"]), "\n").alias("summary"))


def build_context(parts: DataFrame, max_tokens: int = 1500) -> DataFrame:
    """Parts (query_id, entities, history, summary, recent; null: none) under their headings, cut to max(2 x tokens, 200) characters with a notice."""
    heads = {"entities": "【相关实体】\n", "history": "【历史相关片段】\n", "summary": "【旧对话摘要】", "recent": "【最近对话】\n"}
    whole, most = F.concat_ws("\n\n", *(F.when(F.length(c) > 0, F.concat(F.lit(h), F.col(c))) for c, h in heads.items())), max(2 * max_tokens, 200)
    return parts.select("query_id", F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.substring(whole, 1, most), F.lit("\n[上下文过长，已截断]"))).alias("context"))


def recent_text(turns: DataFrame, window: int = 6, user_chars: int = 120, reply_chars: int = 200) -> DataFrame:
    """The last turns of each session as lines, each side cut."""
    last = retain(turns, window)
    side = lambda head, c, n: F.when(F.length(empty(F.col(c))) > 0, F.concat(F.lit(head), F.substring(c, 1, n)))
    line = F.concat_ws("\n", side("用户: ", "user_text", user_chars), side("客服: ", "assistant_text", reply_chars)).alias("x")
    return last.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line))), lambda t: t["x"]), "\n").alias("recent"))


def history_text(messages: DataFrame, n: int = 6, chars: int = 200) -> DataFrame:
    """The last n messages as `role: text` lines."""
    last = messages.withColumn("_rn", F.row_number().over(_newest())).filter(F.col("_rn") <= n)
    line = F.concat("role", F.lit(": "), F.substring(empty(F.col("content")), 1, chars)).alias("x")
    return last.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("msg_id", line))), lambda t: t["x"]), "\n").alias("history"))
