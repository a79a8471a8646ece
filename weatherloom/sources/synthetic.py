"""Generated daily readings: a seasonal mean per city plus normal noise."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import SEASONS, date_range, season_name, season_number
from ..functions.measures import normal_noise
from ..schema import CITY, SEASON, SEQ, TEMPERATURE, TIMESTAMP

# Days of a generated year, leap or not.
DAYS = 365
# Rows that a task unfolds: some ten megabytes.
TASK_ROWS = 200_000

# Usual mean temperatures in winter, spring, summer and autumn.
SEASONAL_MEANS = {
    "New York": (0, 10, 25, 15),
    "London": (5, 11, 18, 12),
    "Paris": (4, 12, 20, 13),
    "Tokyo": (6, 15, 27, 18),
    "Moscow": (-10, 5, 18, 8),
    "Sydney": (12, 18, 25, 20),
    "Berlin": (0, 10, 20, 11),
    "Beijing": (-2, 13, 27, 16),
    "Rio de Janeiro": (20, 25, 30, 25),
    "Dubai": (20, 30, 40, 30),
    "Los Angeles": (15, 18, 25, 20),
    "Singapore": (27, 28, 28, 27),
    "Mumbai": (25, 30, 35, 30),
    "Cairo": (15, 25, 35, 25),
    "Mexico City": (12, 18, 20, 15),
}


def seasonal_means(spark: SparkSession) -> DataFrame:
    """The built-in dimension: one row per city and season, with the number of the city."""
    rows = [
        (city, number, season, float(mean))
        for number, (city, means) in enumerate(SEASONAL_MEANS.items())
        for season, mean in zip(SEASONS, means)
    ]
    schema = "city string, city_number bigint, season string, mean_temp double"
    return spark.createDataFrame(rows, schema)


def synthetic_calendar(
    means: DataFrame, start: str = "2010-01-01", years: int = 10, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Each city on 365 * years consecutive days, with its season and seasonal mean.

    The dimension is folded to one row per city with its four means and unfolded in two steps: to
    city and year, which are dealt out to a task for about `task_rows` rows each, then to days,
    which look their mean up in place. So the large side takes no join and no shuffle. `seq` is the
    place in the city's series, or in the whole table if the dimension has a `city_number`. Runs a
    job that counts the cities.
    """
    by_season = [
        F.max(F.when(F.col(SEASON) == season, F.col("mean_temp"))) for season in SEASONS
    ]
    number = F.max("city_number") if "city_number" in means.columns else F.lit(0)
    cities = means.groupBy(CITY).agg(F.array(*by_season).alias("means"), number.alias("number"))
    rows = means.select(CITY).distinct().count() * years * DAYS
    tasks = max(math.ceil(rows / task_rows), 1)
    by_year = cities.withColumn("year", F.explode(F.sequence(F.lit(0), F.lit(years - 1))))
    dealt = by_year.repartition(tasks, CITY, "year")
    first_day = F.lit(start).cast("date")
    first_of_year = F.date_add(first_day, F.col("year") * DAYS)
    return (
        dealt.withColumn("day", F.explode(date_range(first_of_year, DAYS)))
        .select(
            CITY,
            F.col("day").cast("timestamp_ntz").alias(TIMESTAMP),
            season_name("day").alias(SEASON),
            F.element_at("means", season_number("day")).alias("mean_temp"),
            (F.col("number") * (DAYS * years) + F.datediff("day", first_day))
            .cast("bigint")
            .alias(SEQ),
        )
    )


def synthetic_readings(
    means: DataFrame,
    start: str = "2010-01-01",
    years: int = 10,
    sigma: float = 5.0,
    seed: int = 0,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Daily readings around the seasonal means. The same seed gives the same readings."""
    noise = F.lit(sigma) * normal_noise(seed, CITY, TIMESTAMP)
    return synthetic_calendar(means, start, years, task_rows).select(
        CITY, TIMESTAMP, (F.col("mean_temp") + noise).alias(TEMPERATURE), SEASON, SEQ
    )
