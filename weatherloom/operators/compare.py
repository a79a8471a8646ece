"""Comparison of chosen cities."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import present
from ..plans.sizing import LONG_SERIES
from ..schema import CITY
from .charts import chart_series
from .profiles import city_means, first_cities
from .rolling import rolling_anomalies

DEFAULT_CITIES = 2


def choose_cities(readings: DataFrame, cities=None) -> DataFrame:
    """Rows of the chosen cities: names, a DataFrame with a `city` column, or the first two seen."""
    if cities is None:
        # Two rows by the limit, so the broadcast is safe.
        chosen = F.broadcast(first_cities(present(readings, CITY), DEFAULT_CITIES))
        return readings.join(chosen, CITY, "left_semi")
    if isinstance(cities, DataFrame):
        return readings.join(cities, CITY, "left_semi")
    return readings.where(F.col(CITY).isin(list(cities)))


def compare_series(readings: DataFrame, cities=None) -> DataFrame:
    return chart_series(choose_cities(readings, cities), CITY)


def compare_means(readings: DataFrame, cities=None) -> DataFrame:
    return city_means(choose_cities(readings, cities))


def compare_anomalies(
    readings: DataFrame, cities=None, rows: int = 30, k: float = 2, series_rows: int = LONG_SERIES
) -> DataFrame:
    """Chosen cities with rolling statistics over equal windows and anomaly flags."""
    chosen = choose_cities(readings, cities)
    return rolling_anomalies(chosen, rows, rows, k, series_rows=series_rows)
