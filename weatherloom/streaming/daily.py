"""Daily means per city on a stream.

A mean is kept as sums: each micro-batch writes the sum and the number of its readings per city and
day, and readers add them up. No day is ever closed, so a reading counts however late it comes, and
no state is held. The sums of old micro-batches are merged, so readers open few folders.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import calendar_date
from ..functions.rows import present
from ..schema import CITY, TEMPERATURE, TIMESTAMP
from .compaction import CompactedFolder

DAILY = "city string, day date, total double, n bigint"


def daily_mean_stream(readings: DataFrame) -> DataFrame:
    """City, calendar day and temperature of every reading that belongs to a city and a day."""
    return present(readings, CITY, TIMESTAMP).select(
        CITY, calendar_date(TIMESTAMP).alias("day"), TEMPERATURE
    )


def _merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy(CITY, "day").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def add_daily(arrived: DataFrame, batch_id: int, folder: str) -> None:
    """Add the sums of one micro-batch; a repeated one replaces its own."""
    sums = arrived.groupBy(CITY, "day").agg(
        F.sum(TEMPERATURE).alias("total"), F.count(TEMPERATURE).alias("n")
    )
    CompactedFolder(arrived.sparkSession, f"{folder}/daily").add(batch_id, sums, _merged)


def start_daily_mean(daily: DataFrame, folder: str, **trigger):
    """Write the sums of each micro-batch by city and day under `folder`; returns the running query."""
    return (
        daily.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(lambda arrived, batch_id: add_daily(arrived, batch_id, folder))
        .trigger(**trigger)
        .start()
    )


def read_daily_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of every city and day over all readings so far; null where none has a temperature."""
    paths = CompactedFolder(spark, f"{folder}/daily").paths()
    sums = spark.read.schema(DAILY).parquet(*paths) if paths else spark.createDataFrame([], DAILY)
    n = F.sum("n")
    mean = F.when(n > 0, F.sum("total") / n)
    return sums.groupBy(CITY, "day").agg(mean.alias("mean"))
