"""Historical norms: the band a current reading is compared with."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import season_name
from ..functions.measures import lower_bound, upper_bound
from ..functions.rows import present, without_nan
from ..plans.sizing import LONG_SERIES
from ..schema import CITY, SEASON, TEMPERATURE, TIMESTAMP
from .rolling import rolling_anomalies, rolling_stats


def _band(rows: DataFrame, keys: dict, value: str, k: float, only: DataFrame | None) -> DataFrame:
    """Bands by `keys` (names and their columns), for all or for those that are in `only`.

    NaN counts as a missing value.
    """
    rows = without_nan(rows, value)
    mean, std = F.col("mean"), F.col("std")
    rows = rows.select(*[column.alias(name) for name, column in keys.items()], value)
    if only is not None:
        rows = rows.join(only, list(keys), "left_semi")
    return (
        rows.groupBy(*keys)
        .agg(
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.count(value).alias("n"),
        )
        .withColumn("lower", lower_bound(mean, std, k))
        .withColumn("upper", upper_bound(mean, std, k))
    )


def city_norm(readings: DataFrame, k: float = 2, only: DataFrame | None = None) -> DataFrame:
    """Band over a city's whole history. `only` names the cities wanted."""
    return _band(present(readings, CITY), {CITY: F.col(CITY)}, TEMPERATURE, k, only)


def season_norm(readings: DataFrame, k: float = 2, only: DataFrame | None = None) -> DataFrame:
    """Band over a city's history in one season of the year. `only` names the pairs wanted."""
    dated = present(readings, CITY, TIMESTAMP)
    keys = {CITY: F.col(CITY), SEASON: season_name(TIMESTAMP)}
    return _band(dated, keys, TEMPERATURE, k, only)


def day_month_norm(
    readings: DataFrame,
    k: float = 3,
    mean_rows: int = 30,
    std_rows: int = 7,
    exclude_anomalies: bool = False,
    series_rows: int = LONG_SERIES,
    only: DataFrame | None = None,
) -> DataFrame:
    """Band over the rolling means of one calendar day in all years.

    The rolling mean runs over the whole history. Anomalous days count unless they are excluded.
    `only` names the cities, days and months wanted: rows of other days go above the windows, which
    need them, and below the aggregate.
    """
    if exclude_anomalies:
        flagged = rolling_anomalies(readings, mean_rows, std_rows, series_rows=series_rows)
        rolled = flagged.where(~F.col("is_anomaly"))
    else:
        rolled = rolling_stats(readings, mean_rows, None, series_rows=series_rows)
    dated = present(rolled, CITY, TIMESTAMP)
    keys = {CITY: F.col(CITY), "day": F.dayofmonth(TIMESTAMP), "month": F.month(TIMESTAMP)}
    return _band(dated, keys, "rolling_mean", k, only)
