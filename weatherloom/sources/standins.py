"""Readings, payloads and events derived from the benchmark tables, which hold no temperatures."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import season_name, utc_to_epoch
from ..schema import CITY, SEASON, SEQ, TEMPERATURE, TIMESTAMP

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def _temperature():
    return F.floor(F.col("o_totalprice") / 100) / F.lit(100.0) - F.lit(10.0)


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per order: nation as city, price as temperature between -10 and 40 degrees."""
    return _orders_by_city(spark, sf_dir).select(
        F.col("n_name").alias(CITY),
        F.col("o_orderdate").alias(TIMESTAMP),
        _temperature().alias(TEMPERATURE),
        season_name("o_orderdate").alias(SEASON),
        F.col("o_orderkey").alias(SEQ),
    )


def shipment_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per order line: supplier as city, quantity as temperature."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias(CITY),
        F.col("l_shipdate").alias(TIMESTAMP),
        F.col("l_quantity").alias(TEMPERATURE),
        season_name("l_shipdate").alias(SEASON),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias(SEQ),
    )


def _payload_body(city, timestamp, temperature):
    """A good payload; the spread of temperatures is doubled so that some leave their band."""
    return F.to_json(
        F.struct(
            F.lit(200).alias("cod"),
            utc_to_epoch(timestamp).alias("dt"),
            city.alias("name"),
            F.struct((2 * temperature + F.lit(273.15)).alias("temp")).alias("main"),
        )
    )


def last_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One good payload per city, from its last order, as JSON text."""
    last = (
        order_readings(spark, sf_dir)
        .groupBy(CITY)
        .agg(F.max(F.struct(TIMESTAMP, SEQ, TEMPERATURE)).alias("last"))
    )
    body = _payload_body(F.col(CITY), F.col("last.timestamp"), F.col("last.temperature"))
    return last.select(body.alias("value"))


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per order, good or not: the order's status and priority decide which kind."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    city, seq = F.col("n_name"), F.col("o_orderkey")
    refused = F.to_json(F.struct(F.lit(401).alias("cod"), F.lit("Invalid key").alias("message")))
    unknown = F.to_json(F.struct(F.lit("404").alias("cod"), F.lit("city not found").alias("message")))
    garbage = F.concat(F.lit("<html>"), seq.cast("string"))
    body = (
        F.when(status == "F", _payload_body(city, F.col("o_orderdate"), _temperature()))
        .when(status == "P", refused)
        .when(priority == "5-LOW", garbage)
        .otherwise(unknown)
    )
    return _orders_by_city(spark, sf_dir).select(
        seq.alias(SEQ), city.alias(CITY), body.alias("value")
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text with the flaws of real files, decided by the order's status and priority."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    temperature = (
        F.when(status == "P", F.lit("NaN"))
        .when(priority == "5-LOW", F.lit("broken"))
        .when(priority == "1-URGENT", F.lit(""))
        .otherwise(_temperature().cast("string"))
    )
    date_time = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    timestamp = (
        F.when(priority == "2-HIGH", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(priority == "3-MEDIUM", F.lit("2001-02-30"))
        .otherwise(date_time)
    )
    nameless = (status == "P") & (priority == "1-URGENT")
    city = F.when(nameless, F.lit("NA")).otherwise(F.col("n_name"))
    return _orders_by_city(spark, sf_dir).select(
        city.alias(CITY),
        timestamp.alias(TIMESTAMP),
        temperature.alias(TEMPERATURE),
        F.initcap(season_name("o_orderdate")).alias(SEASON),
        F.col("o_orderkey").alias(SEQ),
    )


def _as_readings(events: DataFrame, city: str) -> DataFrame:
    return events.select(
        F.col(city).cast("string").alias(CITY),
        F.col("ts").alias(TIMESTAMP),
        F.col("value").alias(TEMPERATURE),
        season_name("ts").alias(SEASON),
        F.col("event_id").alias(SEQ),
    )


def event_readings(spark: SparkSession, sf_dir: str, city: str = "event_type") -> DataFrame:
    """One reading per event, with the event type or the user as city."""
    return _as_readings(table(spark, sf_dir, "events"), city)


def event_stream(spark: SparkSession, sf_dir: str, city: str = "event_type") -> DataFrame:
    """The same readings as a stream."""
    events = (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return _as_readings(events, city)
