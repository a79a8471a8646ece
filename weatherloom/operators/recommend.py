"""Recommendation of a city for a season and a range of temperatures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import in_season
from ..schema import CITY, TEMPERATURE, TIMESTAMP
from .profiles import most_frequent_city


def suitable_rows(readings: DataFrame, season, low: float = 20, high: float = 30) -> DataFrame:
    """Rows of the season (number, name or label) with a temperature in the closed range."""
    return readings.where(
        in_season(TIMESTAMP, season) & F.col(TEMPERATURE).between(low, high)
    )


def recommend_city(readings: DataFrame, season, low: float = 20, high: float = 30) -> DataFrame:
    """The city with the most suitable rows; no row if nothing is suitable."""
    return most_frequent_city(suitable_rows(readings, season, low, high))


def recommend_with_current(
    readings: DataFrame, current: DataFrame, season, low: float = 20, high: float = 30
) -> DataFrame:
    """The recommended city with its current readings, or without if there are none."""
    winner = recommend_city(readings, season, low, high)
    # One row by the limit, so the broadcast is safe and leaves only the winner's readings to join.
    its_readings = current.join(F.broadcast(winner), CITY, "left_semi")
    return winner.join(its_readings, CITY, "left")
