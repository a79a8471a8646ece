"""Every registered query against its SQL, and what its plan must not hold."""

import math
import os

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as registered

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        name = file.removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain_rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(plain_rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, duck, name):
    df = registered.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert forbidden not in plan
    got = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    if name not in registered.ORACLE:
        assert got
        return
    relation = duck.sql(registered.oracle_sql()[name])
    assert dict(zip(relation.columns, map(str, relation.types))) == {
        column: TYPES[kind] for column, kind in df.dtypes
    }
    assert rows_of(df.columns, got) == rows_of(relation.columns, relation.fetchall())


def test_all_have_sql():
    assert set(registered.QUERIES) == set(registered.ORACLE)
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    df = registered.entry(spark)
    assert df.count() == 1500 and "is_anomaly" in df.columns


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_both_windows_share_one_shuffle_and_one_sort(spark):
    plan = physical(registered.queries()["anomaly_flags_30_7"](spark, SMALL))
    assert plan.count("Exchange hashpartitioning(city") == 1
    assert plan.count("Sort [city") == 1


def test_a_city_filter_passes_below_the_window(spark, make, history, tmp_path):
    from weatherloom.operators.rolling import rolling_stats
    from weatherloom.sources import readings

    path = str(tmp_path / "store")
    readings.write_parquet(make(history), path)
    rolled = rolling_stats(readings.read_parquet(spark, path))
    plan = physical(rolled.where("city = 'Long'").select("seq", "rolling_mean"))
    assert "EqualTo(city,Long)" in plan
    # A season filter must stay above: the window needs the rows of other seasons.
    plan = physical(rolled.where("season = 'winter'"))
    assert "EqualTo(season,winter)" not in plan


def test_top_k_and_tails_are_cut_before_the_shuffle(spark):
    queries = registered.queries()
    for name in ("warmest_winter_top3", "most_stable_city", "recommend_city"):
        assert "TakeOrderedAndProject" in physical(queries[name](spark, SMALL))
    for name in ("tail5_by_city", "season_analysis"):
        plan = physical(queries[name](spark, SMALL))
        assert "WindowGroupLimit" in plan and ", Partial" in plan


def test_aggregates_are_combined_before_the_shuffle(spark):
    for name in ("season_profile", "daily_mean", "histogram_30", "density_month", "city_norm"):
        assert "partial_" in physical(registered.queries()[name](spark, SMALL))
