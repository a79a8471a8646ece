"""Season analysis of all cities: summary, rolling statistics, anomalies, trend, last rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import current_season
from ..functions.rows import present
from ..operators.compare import choose_cities
from ..operators.profiles import rows_from_end, summary_columns
from ..operators.rolling import flag_anomalies, rolling_anomalies, with_rolling_columns
from ..operators.trend import group_trends
from ..schema import CITY, SEASON, SERIES_ORDER, TEMPERATURE
from .sizing import LONG_SERIES


def season_rows(readings: DataFrame, as_of=None, cities=None) -> DataFrame:
    """Rows whose stored season is the one of `as_of` (today if missing), for some or all cities.

    `cities` are names, or a DataFrame with a `city` column.
    """
    rows = present(readings, CITY).where(F.col(SEASON) == current_season(as_of))
    return rows if cities is None else choose_cities(rows, cities)


def season_statistics(readings: DataFrame, as_of=None, cities=None) -> DataFrame:
    """Min, max, mean, slope and trend of the season, one row per city, from one pass."""
    return group_trends(season_rows(readings, as_of, cities), [CITY, SEASON], *summary_columns())


def season_analysis(
    readings: DataFrame,
    as_of=None,
    cities=None,
    tail: int = 5,
    mean_rows: int = 30,
    std_rows: int = 7,
    k: float = 2,
) -> DataFrame:
    """The last `tail` rows of every city's season with rolling statistics, flag and season figures.

    Windows run over the season's rows only, across years. The last rows need no more than the
    rows their windows reach back to, so each task keeps just those before the shuffle.
    """
    rows = season_rows(readings, as_of, cities)
    reach = tail + max(mean_rows, std_rows) - 1
    recent = rows_from_end(rows, reach)
    rolled = with_rolling_columns(
        recent, [CITY], SERIES_ORDER, TEMPERATURE, mean_rows, std_rows
    )
    ending = flag_anomalies(rolled, k).where(F.col("from_end") <= tail).drop("from_end")
    return ending.join(season_statistics(readings, as_of, cities), [CITY, SEASON])


def season_anomalies(
    readings: DataFrame,
    as_of=None,
    cities=None,
    mean_rows: int = 30,
    std_rows: int = 7,
    k: float = 2,
    series_rows: int = LONG_SERIES,
) -> DataFrame:
    """All rows of the season with rolling statistics within the season and anomaly flags."""
    rows = season_rows(readings, as_of, cities)
    return rolling_anomalies(rows, mean_rows, std_rows, k, series_rows=series_rows)
