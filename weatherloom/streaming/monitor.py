"""Readings of a stream against historical norms."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.current import NORMS, classify
from ..plans.sizing import paths_in, written
from ..schema import CITY, SEQ, TEMPERATURE, TIMESTAMP


def as_current(readings: DataFrame) -> DataFrame:
    """Readings in the columns of current readings."""
    return readings.select(
        F.col(CITY),
        F.col(TIMESTAMP).alias("observed_at"),
        F.col(TEMPERATURE).alias("temp_c"),
        F.col(SEQ),
    )


def monitor_stream(
    current: DataFrame, readings: DataFrame, norm: str = "city", k: float | None = None, **options
) -> DataFrame:
    """A stream of current readings with band and status, for any append sink.

    Norms are computed once and written; every micro-batch joins the small written table instead of
    the history. `start_versioned_monitor` takes norms that are renewed while the stream runs.
    """
    build, width = NORMS[norm]
    norms = written(build(readings, k=width if k is None else k, **options), "norms")
    return classify(current, norms, norm)


def start_monitor(monitored: DataFrame, folder: str, **trigger):
    """Append the monitored readings to parquet under `folder`; returns the running query."""
    return (
        monitored.writeStream.outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .format("parquet")
        .trigger(**trigger)
        .start(f"{folder}/monitored")
    )


def read_monitored(monitored: DataFrame, folder: str) -> DataFrame:
    """What a monitor has written so far."""
    spark = monitored.sparkSession
    return spark.read.schema(monitored.schema).parquet(f"{folder}/monitored")


# --- norms in versions -------------------------------------------------------------------------


def newest_version(spark: SparkSession, store: str) -> int | None:
    """The number of the newest version that is wholly written, or None."""
    done = paths_in(spark, f"{store}/version=*/_SUCCESS")
    return max((int(path.split("/")[-2].removeprefix("version=")) for path in done), default=None)


def publish_norms(
    readings: DataFrame, store: str, norm: str = "city", k: float | None = None, **options
) -> int:
    """Compute the norms of `readings` and make them the newest version in `store`.

    Running monitors take them up with their next micro-batch. One publisher at a time.
    """
    build, width = NORMS[norm]
    version = (newest_version(readings.sparkSession, store) or 0) + 1
    norms = build(readings, k=width if k is None else k, **options)
    norms.write.mode("overwrite").parquet(f"{store}/version={version}")
    return version


def classify_newest(current: DataFrame, store: str, norm: str = "city") -> DataFrame:
    """Current readings against the newest norms, with the number of their version."""
    spark = current.sparkSession
    version = newest_version(spark, store)
    if version is None:
        raise ValueError(f"{store}: no norms published")
    norms = spark.read.parquet(f"{store}/version={version}")
    monitored = classify(current, norms, norm)
    return monitored.withColumn("norm_version", F.lit(version).cast("bigint"))


def start_versioned_monitor(current: DataFrame, store: str, folder: str, norm: str = "city", **trigger):
    """Write each micro-batch of `current`, held against the newest norms, under `folder`.

    A repeated micro-batch overwrites its own output, and may find a newer version.
    """

    def write(arrived: DataFrame, batch_id: int) -> None:
        monitored = classify_newest(arrived, store, norm)
        monitored.write.mode("overwrite").parquet(f"{folder}/monitored/batch={batch_id}")

    return (
        current.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(write)
        .trigger(**trigger)
        .start()
    )


def read_versioned(spark: SparkSession, folder: str) -> DataFrame:
    """What a versioned monitor has written so far."""
    return spark.read.parquet(f"{folder}/monitored").drop("batch")
