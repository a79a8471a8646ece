"""Linear trend: least-squares slope of temperature on whole days since a series began."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.calendar import calendar_date, whole_days_since
from ..functions.measures import trend_label
from ..functions.rows import present
from ..plans.sizing import written
from ..schema import CITY, TEMPERATURE, TIMESTAMP


def group_starts(readings: DataFrame, keys=(CITY,)) -> DataFrame:
    """First timestamp of every group."""
    return readings.groupBy(*keys).agg(F.min(TIMESTAMP).alias("first_timestamp"))


def with_first_timestamp(readings: DataFrame, keys=(CITY,)) -> DataFrame:
    """Every row with the first timestamp of its group; rows without a key are left out.

    The starts are one row per group. They are written first, so that Catalyst knows their size: it
    broadcasts few groups, and joins many by shuffle with adaptive skew handling.
    """
    keyed = present(readings, *keys)
    starts = written(group_starts(keyed, keys), "group-starts")
    return keyed.join(starts, list(keys))


def _slope(days: Column) -> Column:
    return F.coalesce(F.regr_slope(F.col(TEMPERATURE), days.cast("double")), F.lit(0.0))


def group_trends(readings: DataFrame, keys=(CITY,), *extra) -> DataFrame:
    """Slope per day and its sign per group, next to any extra aggregates.

    A shift of the days leaves the slope as it is. So where all readings of a group have the same
    time of day, days can be counted from any date, and one pass over the readings is enough. Only
    groups with mixed times take a second pass, which counts from their first timestamp.
    """
    keys = list(keys)
    keyed = present(readings, *keys)
    date = calendar_date(TIMESTAMP)
    time_of_day = F.col(TIMESTAMP) - date.cast("timestamp_ntz")
    seen = Observation()
    first_pass = keyed.groupBy(*keys).agg(
        *extra,
        _slope(F.unix_date(date)).alias("slope"),
        F.min(TIMESTAMP).alias("first_timestamp"),
        (F.min(time_of_day) < F.max(time_of_day)).alias("mixed_times"),
    )
    any_mixed = F.bool_or("mixed_times").alias("any_mixed")
    first_pass = written(first_pass.observe(seen, any_mixed), "trends")
    if not seen.get["any_mixed"]:
        trends = first_pass
    else:
        mixed = first_pass.where("mixed_times").select(*keys, "first_timestamp")
        days = whole_days_since(F.col(TIMESTAMP), F.col("first_timestamp"))
        exact = keyed.join(mixed, keys).groupBy(*keys).agg(_slope(days).alias("exact_slope"))
        trends = first_pass.join(exact, keys, "left").withColumn(
            "slope", F.coalesce("exact_slope", "slope")
        )
    names = [c for c in first_pass.columns if c not in ("first_timestamp", "mixed_times")]
    return trends.select(*names, trend_label(F.col("slope")).alias("trend"))


def linear_trend(readings: DataFrame, keys=(CITY,)) -> DataFrame:
    """Slope per day and its sign per group. Rows without time or temperature are skipped.

    A group on a single day has slope 0.
    """
    return group_trends(readings, keys)
