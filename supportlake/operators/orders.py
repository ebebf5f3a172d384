"""Orders, tracking and tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "array<struct<time:string,desc:string>>"


def order_lookup(requests: DataFrame, orders: DataFrame, tracking: DataFrame, arrival_days: int = 3) -> DataFrame:
    """B1: requests (request_id, order_no, user_id, is_admin); only the owner or an admin sees an order, nobody without identity.

    One tracking row an order, the latest shipped; of several, that with the highest tracking number, then carrier. ETA: completion date, else shipping date + 3 days.
    """
    asked = requests.withColumn("order_no", F.upper(F.trim("order_no"))).filter(F.col("user_id").isNotNull() | F.col("is_admin"))
    one = tracking.groupBy("order_no").agg(F.max_by(F.struct("carrier", "tracking_number", "shipped"), F.struct("shipped", "tracking_number", "carrier")).alias("t"))
    seen = asked.join(orders.withColumnRenamed("user_id", "owner"), "order_no").filter(F.col("is_admin") | (F.col("owner") == F.col("user_id")))
    eta = F.coalesce(F.to_date("complete_time"), F.date_add(F.to_date("t.shipped"), arrival_days))
    created = F.col("create_time") if "create_time" in orders.columns else F.lit(None).cast("timestamp")
    return seen.join(one, "order_no", "left").select("request_id", "order_no", "status", "price", created.alias("created_at"), F.col("t.carrier").alias("carrier"), F.col("t.tracking_number").alias("tracking_number"), eta.alias("eta"))


def parse_events(c: Column) -> Column:
    """B2: objects {time, desc} or pairs [time, desc]; anything else has no events."""
    pairs = F.transform(F.from_json(c, "array<array<string>>"), lambda p: F.struct(F.get(p, 0).alias("time"), F.get(p, 1).alias("desc")))
    objects = F.from_json(c, EVENTS)
    ok = lambda a: F.size(F.filter(a, lambda x: x["time"].isNotNull())) > 0
    return F.when(ok(objects), objects).when(ok(pairs), pairs).otherwise(F.array().cast(EVENTS))


def tracking_lookup(requests: DataFrame, tracking: DataFrame, orders: DataFrame) -> DataFrame:
    """B2: tracking rows of orders the asker owns."""
    mine = orders.select("order_no", F.col("user_id").alias("owner"))
    rows = requests.join(tracking, "tracking_number").join(mine, "order_no").filter(F.col("is_admin") | (F.col("owner") == F.col("user_id")))
    return rows.withColumn("events", parse_events(F.col("events_json"))).drop("owner")


def order_reply(found: DataFrame) -> DataFrame:
    """Lines for each order found; what is unknown has no line."""
    text = F.concat_ws(
        "\n", F.concat(F.lit("订单 "), "order_no", F.lit("："), "status"), F.concat(F.lit("- 下单时间: "), F.col("created_at").cast("string")),
        F.concat(F.lit("- 订单金额: ¥"), F.col("price").cast("decimal(18,2)").cast("string")), F.concat(F.lit("- 承运商: "), "carrier", F.lit(" ("), "tracking_number", F.lit(")")), F.concat(F.lit("- 预计送达: "), F.date_format("eta", "yyyy-MM-dd")),
    )
    return found.withColumn("reply", text)


def order_replies(requests: DataFrame, found: DataFrame) -> DataFrame:
    """A reply for each request (request_id, order_no), also where nothing was found or the order is someone else's."""
    none = F.concat(F.lit("未查询到订单 "), F.upper(F.trim("order_no")), F.lit(" 的记录（或不属于当前账号），请核对订单号，或联系人工客服查询。"))
    told = order_reply(found).select("request_id", "reply")
    return requests.join(told, "request_id", "left").select("request_id", F.col("reply").isNotNull().alias("found"), F.coalesce("reply", none).alias("reply"))


def ticket_queue(tickets: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending tickets by priority, then newest."""
    p = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    q = tickets.filter("status = 'pending'").orderBy(p, F.desc("created_at"), "id")
    return q.limit(limit) if limit else q


def resolve(tickets: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (id, resolution, resolved_at) close their tickets."""
    u = updates.select("id", F.col("resolution").alias("_r"), F.col("resolved_at").alias("_t"))
    j = tickets.join(u, "id", "left")
    done = F.col("_t").isNotNull()
    new = {"status": F.when(done, "resolved").otherwise(F.col("status")), "resolution": F.coalesce("_r", "resolution"), "resolved_at": F.coalesce("_t", "resolved_at")}
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in tickets.columns))


def latest_resolution(tickets: DataFrame) -> DataFrame:
    """The newest non-empty resolution of each session."""
    return tickets.filter("status = 'resolved' and coalesce(resolution, '') <> ''").groupBy("session_id").agg(F.max_by("resolution", F.struct("resolved_at", "id")).alias("resolution"))


def in_human_mode(sessions: DataFrame, tickets: DataFrame) -> DataFrame:
    return sessions.join(tickets.filter("status = 'pending'").select("session_id").distinct(), "session_id", "left_semi")


def thread(messages: DataFrame, since_id: int = 0) -> DataFrame:
    """A session's messages after an id, in order."""
    return messages.filter(F.col("id") > since_id).withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("id")))
