"""Loading, cleaning and writing readings."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import season_name
from ..schema import CITY, READINGS, SEASON, SEQ, SERIES_ORDER, TEMPERATURE, TIMESTAMP
from . import csv_files

# Spellings of a missing value in text files.
MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def _present(raw: DataFrame, name: str) -> Column:
    """The column, with missing-value spellings of text turned to NULL."""
    if raw.schema[name].dataType.typeName() != "string":
        return F.col(name)
    return F.when(~F.col(name).isin(*MISSING), F.col(name))


def clean_readings(raw: DataFrame) -> DataFrame:
    """Readings in the common schema from text or typed columns.

    Bad temperatures, NaN and bad timestamps become NULL; a date is midnight of that day. Seasons are
    lower case, and derived from the timestamp if there is no such column. Without a `seq` column,
    rows are numbered in the order in which Spark reads them.
    """
    temperature = _present(raw, TEMPERATURE).try_cast("double")
    timestamp = _present(raw, TIMESTAMP).try_cast("timestamp_ntz")
    if SEASON in raw.columns:
        season = F.lower(_present(raw, SEASON))
    else:
        season = season_name(timestamp)
    if SEQ in raw.columns:
        seq = _present(raw, SEQ).try_cast("bigint")
    else:
        seq = F.monotonically_increasing_id()
    return raw.select(
        _present(raw, CITY).alias(CITY),
        timestamp.alias(TIMESTAMP),
        F.nanvl(temperature, F.lit(None).cast("double")).alias(TEMPERATURE),
        season.alias(SEASON),
        seq.alias(SEQ),
    )


def read_csv(spark: SparkSession, path, cities=None) -> DataFrame:
    """Readings from CSV files, each with a header of its own. `path` is one path or a list.

    Columns are found by name in each file and read as text, then cleaned. Unless all files have a
    `seq` column, rows are numbered from 0 as they stand in the files, which follow each other by
    path. Runs a job that reads the headers and, for the numbers, one that counts rows.

    `cities` leaves the rows of these cities. Where numbers are stored the choice reaches the files;
    where they are not, every row counts towards them, so it follows behind. (A filter on the result
    cannot reach the files, as Catalyst does not look through the spellings of a missing value.)
    """
    tables = csv_files.read_tables(spark, path, (CITY, TIMESTAMP, TEMPERATURE))
    if not tables:
        return spark.createDataFrame([], READINGS)
    if not all(SEQ in table.columns for table in tables):
        tables = [table.withColumnRenamed(SEQ, f"own_{SEQ}") for table in tables]
        tables = csv_files.with_positions(tables, SEQ)
    if cities is not None:
        chosen = [city for city in cities if city not in MISSING]
        tables = [table.where(F.col(CITY).isin(chosen)) for table in tables]
    readings = [clean_readings(table) for table in tables]
    return reduce(DataFrame.unionByName, readings)


def write_csv(readings: DataFrame, path: str, with_seq: bool = False) -> None:
    """Readings as CSV with a header and no row number, unless asked for."""
    columns = [CITY, F.col(TIMESTAMP).cast("string").alias(TIMESTAMP), TEMPERATURE, SEASON]
    if with_seq:
        columns.append(SEQ)
    readings.select(*columns).write.option("header", True).csv(path)


def _without_nan(readings: DataFrame) -> DataFrame:
    """A stored NaN is a missing temperature."""
    known = F.nanvl(F.col(TEMPERATURE), F.lit(None).cast("double"))
    return readings.withColumn(TEMPERATURE, known)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    """Readings written by `write_parquet`. Filters and column choices reach the files."""
    return _without_nan(spark.read.schema(READINGS).parquet(path))


def write_parquet(readings: DataFrame, path: str) -> None:
    """Readings as parquet, clustered by city and time so that filters on them skip row groups.

    Range partitions divide a city that holds most rows, unlike one folder or task per city.
    """
    order = [CITY, *SERIES_ORDER]
    _without_nan(readings).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
