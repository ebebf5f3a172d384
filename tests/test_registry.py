"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from supportlake.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(registry.queries()) & set(registry.oracle_sql()))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(frame):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(db.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_findings_and_guard_use_the_whole_rules(spark):
    found = {r.type for r in registry.queries()["g02_findings"](spark, SF).select("type").distinct().collect()}
    assert {"邮箱", "IP地址", "银行卡"} <= found
    longest = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("max(length(text)) n").first().n
    assert longest > 100 and registry.queries()["g05_input_guard"](spark, SF).selectExpr("max(n) n").first().n == min(longest, 5000)
