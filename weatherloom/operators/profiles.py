"""Seasonal profiles, summaries, rankings, and lists of cities."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import (
    calendar_date,
    in_season,
    known_season,
    season_label,
    season_name,
    season_number,
)
from ..functions.rows import present
from ..schema import CITY, SEASON, SEQ, SERIES_ORDER, TEMPERATURE, TIMESTAMP


def season_profile(readings: DataFrame) -> DataFrame:
    """Mean and sample deviation per city and stored season."""
    return (
        present(readings, CITY, SEASON)
        .groupBy(CITY, SEASON)
        .agg(
            F.avg(TEMPERATURE).alias("mean"),
            F.stddev_samp(TEMPERATURE).alias("std"),
        )
        .orderBy(CITY, SEASON)
    )


def seasonal_profile(readings: DataFrame, city: str | None = None) -> DataFrame:
    """Mean, deviation, max and min per city and season of the timestamp, for one city or all."""
    chosen = readings if city is None else readings.where(F.col(CITY) == city)
    return (
        present(chosen, CITY, TIMESTAMP)
        .groupBy(CITY, season_number(TIMESTAMP).alias("season_number"))
        .agg(
            F.max(season_label(season_name(TIMESTAMP))).alias(SEASON),
            F.avg(TEMPERATURE).alias("mean"),
            F.stddev_samp(TEMPERATURE).alias("std"),
            F.max(TEMPERATURE).alias("max"),
            F.min(TEMPERATURE).alias("min"),
        )
        .orderBy(CITY, "season_number")
    )


def summary_columns():
    return (
        F.min(TEMPERATURE).alias("min"),
        F.max(TEMPERATURE).alias("max"),
        F.avg(TEMPERATURE).alias("mean"),
    )


def temperature_summary(readings: DataFrame, *keys) -> DataFrame:
    """Min, max and mean, over all rows or per group of `keys`."""
    return readings.groupBy(*keys).agg(*summary_columns())


def city_summary(readings: DataFrame) -> DataFrame:
    return temperature_summary(present(readings, CITY), CITY)


def season_summary(readings: DataFrame, season=None) -> DataFrame:
    """Min, max and mean per city and derived season; `season` (number, name or label) keeps one.

    A city without readings in the season has no row.
    """
    dated = present(readings, CITY, TIMESTAMP)
    if season is not None:
        dated = dated.where(in_season(TIMESTAMP, season))
    return temperature_summary(dated, CITY, season_name(TIMESTAMP).alias(SEASON))


def city_means(readings: DataFrame) -> DataFrame:
    return present(readings, CITY).groupBy(CITY).agg(F.avg(TEMPERATURE).alias("mean")).orderBy(CITY)


def daily_mean(readings: DataFrame, *keys) -> DataFrame:
    """Mean per calendar date, per group of `keys` if given."""
    return (
        present(readings, TIMESTAMP, *keys)
        .groupBy(*keys, calendar_date(TIMESTAMP).alias("day"))
        .agg(F.avg(TEMPERATURE).alias("mean"))
        .orderBy(*keys, "day")
    )


def warmest_in_season(readings: DataFrame, season: str = "winter", n: int = 3) -> DataFrame:
    """The n cities with the highest mean in a stored season; equal means go by name.

    The season is given by name or label, and stored as either.
    """
    season = known_season(season)
    return (
        city_means(readings.where(F.col(SEASON).isin(season, season.capitalize())))
        .orderBy(F.desc_nulls_last("mean"), CITY)
        .limit(n)
    )


def season_spread(readings: DataFrame) -> DataFrame:
    """Sample deviation across the season means of each city."""
    return season_profile(readings).groupBy(CITY).agg(F.stddev_samp("mean").alias("spread"))


def most_stable_city(readings: DataFrame) -> DataFrame:
    return season_spread(readings).orderBy(F.asc_nulls_last("spread"), CITY).limit(1)


def anomaly_counts(flagged: DataFrame) -> DataFrame:
    """Number of anomalous rows per city."""
    return present(flagged, CITY).groupBy(CITY).agg(
        F.count_if("is_anomaly").alias("anomalies")
    )


def anomaly_extremes(flagged: DataFrame) -> DataFrame:
    """The city with the most and the one with the fewest anomalies; ties go by name.

    Both come out of one pass over the per-city counts.
    """
    counts = anomaly_counts(flagged)
    most = F.min(F.struct((-F.col("anomalies")).alias("n"), CITY))
    fewest = F.min(F.struct(F.col("anomalies").alias("n"), CITY))
    return (
        counts.agg(most.alias("most"), fewest.alias("fewest"))
        .selectExpr(
            "stack(2, 'most', most.city, -most.n, 'fewest', fewest.city, fewest.n)"
            " AS (extreme, city, anomalies)"
        )
        .where(F.col(CITY).isNotNull())
    )


def city_frequency(readings: DataFrame) -> DataFrame:
    return present(readings, CITY).groupBy(CITY).agg(F.count(F.lit(1)).alias("n"))


def most_frequent_city(readings: DataFrame) -> DataFrame:
    """The city with the most rows; ties go by name."""
    return city_frequency(readings).orderBy(F.desc("n"), CITY).limit(1)


def city_list(readings: DataFrame) -> DataFrame:
    """Distinct cities with their first row, in order of first appearance."""
    return readings.groupBy(CITY).agg(F.min(SEQ).alias("first_seq")).orderBy("first_seq")


def first_cities(readings: DataFrame, n: int = 2) -> DataFrame:
    return city_list(readings).limit(n)


def city_count(readings: DataFrame) -> DataFrame:
    return readings.agg(F.count_distinct(CITY).alias("cities"))


def rows_from_end(readings: DataFrame, n: int, keys=(CITY,)) -> DataFrame:
    """The last n rows of each series with `from_end`, 1 for the last.

    Each task keeps n rows per series before the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in SERIES_ORDER])
    numbered = present(readings, *keys).withColumn("from_end", F.row_number().over(newest))
    return numbered.where(F.col("from_end") <= n)


def last_rows(readings: DataFrame, n: int = 5, keys=(CITY,)) -> DataFrame:
    return rows_from_end(readings, n, keys).drop("from_end")


def seq_at(readings: DataFrame, place: int, bins: int = 1000) -> int | None:
    """The `seq` of the row at `place` in table order, counted from 0; None beyond the end.

    Counts of equal ranges of `seq`, narrowed until one value is left: a few jobs over that column,
    of which at most `bins` counts each reach the driver.
    """
    low, high, n = readings.agg(F.min(SEQ), F.max(SEQ), F.count(SEQ)).first()
    if place >= n:
        return None
    while low < high:
        width = -(-(high - low + 1) // bins)
        inside = readings.where(F.col(SEQ).between(low, high))
        counts = inside.groupBy(F.expr(f"({SEQ} - {low}) div {width}").alias("bin")).count()
        for row in counts.orderBy("bin").collect():
            if place < row["count"]:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            place -= row["count"]
    return low


def rows_between(readings: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows start .. stop - 1 of the table, in table order, counted from 0.

    The bounds in `seq` are found by counting, at once; the slice is then a filter on `seq` that
    reaches the files, however deep it lies.
    """
    first = seq_at(readings, start) if start < stop else None
    if first is None:
        return readings.where(F.lit(False))
    last = seq_at(readings, stop - 1)
    chosen = readings.where(F.col(SEQ) >= first)
    return (chosen if last is None else chosen.where(F.col(SEQ) <= last)).orderBy(SEQ)
