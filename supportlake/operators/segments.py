"""Running sums and totals of keys of any size.

A window over a key is one task's work, however large the key. Here rows are dealt into ranges of (key, order), so
a giant key spreads over as many ranges as its rows need; sums run inside each range, and what the
ranges before it add up to is carried over. Only keys that cross a border need that: each range has two at most, so
the carried table has a proven bound and is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions.tables import OwnTable

#: Rows of a key up to which a plain window serves.
LARGEST = 1_000_000
#: Rows of a range, about.
RANGE = 500_000


def giant(df: DataFrame, key: str, largest: int = LARGEST) -> bool:
    """Whether some key has more than `largest` rows; the count is partly made before its shuffle."""
    return bool((df.groupBy(key).count().agg(F.max("count")).first()[0] or 0) > largest)


def with_sums(df: DataFrame, key: str, order: Sequence[Column], running: dict[str, Column] | None = None, totals: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """df with running sums (in order, the row itself included) and totals by key as further columns.

    The order must be full: rows equal in key and order are taken as they come and stay in one range. Null keys are
    one key; null values add nothing; a key whose values are all null has null sums; an empty table gives an empty one.
    """
    running, totals = running or {}, totals or {}
    n = parts or max(2, -(-df.count() // RANGE))
    dealt = OwnTable(df.repartitionByRange(n, F.col(key), *order).withColumn("_part", F.spark_partition_id()), "segments").df
    dealt = dealt.withColumns({f"_v_{name}": value for name, value in (running | totals).items()})
    inside = Window.partitionBy(key, "_part")
    upto = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy(key, "_part").agg(*(F.sum(f"_v_{name}").alias(name) for name in running | totals))
    of_key = Window.partitionBy(key)
    before = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = sums.select(
        F.col(key).alias("_key"), F.col("_part").alias("_at"), *(F.sum(name).over(before).alias(f"_b_{name}") for name in running), *(F.sum(name).over(of_key).alias(f"_t_{name}") for name in totals),
        F.count("*").over(of_key).alias("_n"),
    ).filter("_n > 1").drop("_n")
    added = lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))
    ranged = dealt.repartitionByRange(n, "_part")
    local = ranged.withColumns({f"_l_{name}": F.sum(f"_v_{name}").over(upto) for name in running} | {f"_l_{name}": F.sum(f"_v_{name}").over(inside) for name in totals})
    met = local.join(F.broadcast(crossing), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")), "left")  # two rows a range at most
    out = {name: added(F.col(f"_l_{name}"), F.col(f"_b_{name}")) for name in running} | {name: F.coalesce(f"_t_{name}", f"_l_{name}") for name in totals}
    return met.select(*df.columns, *(c.alias(name) for name, c in out.items()))
