"""Tables behind charts: series, histogram, density."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_start
from ..functions.measures import bin_number
from ..functions.rows import present
from ..plans.sizing import written
from ..schema import CITY, SERIES_ORDER, TEMPERATURE, TIMESTAMP


def chart_series(readings: DataFrame, *extra: str) -> DataFrame:
    """Points of a line or scatter chart in time order.

    seq makes the sort key unique, so that one crowded instant does not land in one task.
    """
    return readings.orderBy(*SERIES_ORDER).select(TIMESTAMP, TEMPERATURE, *extra)


def _with_bins(readings: DataFrame, bins: int, keys) -> DataFrame:
    """Present temperatures with `low`, `high` of their group and `bin`.

    The bounds of the whole table are two scalar subqueries; those of groups are a written table.
    """
    rows = present(readings, TEMPERATURE, *keys)
    bounds = rows.groupBy(*keys).agg(
        F.min(TEMPERATURE).alias("low"), F.max(TEMPERATURE).alias("high")
    )
    if keys:
        ranged = rows.join(written(bounds, "bin-bounds"), list(keys))
    else:
        ranged = rows.withColumns(
            {"low": bounds.select("low").scalar(), "high": bounds.select("high").scalar()}
        )
    number = bin_number(F.col(TEMPERATURE), F.col("low"), F.col("high"), bins)
    return ranged.withColumn("bin", number)


def _bin_edges(bins: int):
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    return (
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("bin_end"),
    )


def histogram(readings: DataFrame, bins: int = 30, keys=()) -> DataFrame:
    """Rows per equal-width temperature bin, over the whole table or per group; empty bins are absent."""
    counted = (
        _with_bins(readings, bins, keys)
        .groupBy(*keys, "bin", "low", "high")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(*keys, "bin", *_bin_edges(bins), "n")


def density(readings: DataFrame, bins: int = 30, keys=()) -> DataFrame:
    """Rows per month and equal-width temperature bin; empty cells are absent."""
    dated = present(readings, TIMESTAMP)
    counted = (
        _with_bins(dated, bins, keys)
        .groupBy(*keys, month_start(TIMESTAMP).alias("month"), "bin", "low", "high")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(*keys, "month", "bin", *_bin_edges(bins), "n")


def city_histogram(readings: DataFrame, city: str, bins: int = 30) -> DataFrame:
    return histogram(readings.where(F.col(CITY) == city), bins)


def city_density(readings: DataFrame, city: str, bins: int = 30) -> DataFrame:
    return density(readings.where(F.col(CITY) == city), bins)
