"""Current readings from landed JSON payloads, as a batch or a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import date_text, epoch_to_utc
from ..functions.measures import kelvin_to_celsius, payload_status, two_decimals
from ..schema import CITY, PAYLOAD


def parse_payloads(raw: DataFrame, body: str = "value") -> DataFrame:
    """Payload text as columns; nothing raises on errors or unreadable text.

    A `city` column, the city that was asked for, goes before the name in the payload.
    """
    parsed = raw.withColumn("_payload", F.from_json(body, PAYLOAD))
    name = F.col("_payload.name")
    city = F.coalesce(F.col(CITY), name) if CITY in raw.columns else name
    kept = [c for c in raw.columns if c not in (CITY, body)]
    kelvin = F.col("_payload.main.temp")
    return parsed.select(
        *kept,
        city.alias(CITY),
        epoch_to_utc(F.col("_payload.dt")).alias("observed_at"),
        kelvin.alias("temp_k"),
        kelvin_to_celsius(kelvin).alias("temp_c"),
        F.col("_payload.cod").alias("cod"),
        F.col("_payload.message").alias("message"),
        payload_status(F.col("_payload.cod")).alias("payload_status"),
    )


def good_readings(payloads: DataFrame) -> DataFrame:
    """Payloads that carry a reading, without the columns about errors."""
    return payloads.where(F.col("payload_status") == "ok").drop("cod", "message", "payload_status")


def with_texts(payloads: DataFrame) -> DataFrame:
    """Add the date and the temperature as shown to people."""
    return payloads.withColumns(
        {
            "observed_date": date_text("observed_at"),
            "temp_c_text": two_decimals(F.col("temp_c")),
        }
    )


def read_payloads(spark: SparkSession, path, whole: bool = False) -> DataFrame:
    """Landed payload files, one JSON object per line, or with `whole` one document per file."""
    return parse_payloads(spark.read.text(path, wholetext=whole))


def stream_payloads(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The same files as a stream: new files are new readings."""
    return parse_payloads(spark.readStream.text(path, wholetext=whole))
