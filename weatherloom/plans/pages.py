"""The tables behind each page of an interactive report; the choices on a page are parameters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts, compare, profiles, recommend, rolling
from ..operators.current import compare_current
from ..schema import CITY


def overview(readings: DataFrame, city: str, season, current: DataFrame) -> dict[str, DataFrame]:
    """Summary of a city, of one season there, and its current reading against the city's norm."""
    rows = readings.where(F.col(CITY) == city)
    return {
        "city": profiles.city_summary(rows),
        "season": profiles.season_summary(rows, season),
        "current": compare_current(current.where(F.col(CITY) == city), rows, "city"),
    }


def graphs(readings: DataFrame, city: str) -> dict[str, DataFrame]:
    """Series, seasonal profile, anomalies, histogram, density and daily means of a city."""
    rows = readings.where(F.col(CITY) == city)
    return {
        "series": charts.chart_series(rows),
        "seasons": profiles.seasonal_profile(rows),
        "anomalies": rolling.rolling_anomalies(rows, 30, 30),
        "histogram": charts.histogram(rows),
        "density": charts.density(rows),
        "daily": profiles.daily_mean(rows),
    }


def comparison(readings: DataFrame, cities=None) -> dict[str, DataFrame]:
    """Series, means and anomalies of chosen cities, by default the first two."""
    return {
        "series": compare.compare_series(readings, cities),
        "means": compare.compare_means(readings, cities),
        "anomalies": compare.compare_anomalies(readings, cities),
    }


def trip(
    readings: DataFrame, current: DataFrame, season, low: float = 20, high: float = 30
) -> DataFrame:
    """The city that suits the season and range best, with its current reading."""
    return recommend.recommend_with_current(readings, current, season, low, high)
