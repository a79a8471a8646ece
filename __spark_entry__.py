"""Registered queries: each operator on the benchmark tables, with the SQL that must agree.

`queries()` holds the Spark side, `oracle_sql()` the SQL side. Orders stand in for readings: the
nation of the customer is the city and the price gives a temperature (see sources/standins.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weatherloom.functions import calendar, measures
from weatherloom.operators import (
    charts,
    compare,
    current,
    norms,
    profiles,
    recommend,
    rolling,
    trend,
)
from weatherloom.plans import analysis
from weatherloom.plans.sizing import scratch_path
from weatherloom.sources import payloads, readings, standins, synthetic
from weatherloom.streaming import daily, monitor
from weatherloom.streaming.rolling import RollingStream

DIGITS = 8
AS_OF = "1998-07-15"
MIDDLE = "2024-01-16"
CITY = "NATION_3"
CITIES = ["NATION_3", "NATION_11", "NATION_17"]
SERIES = ["city", "timestamp", "temperature", "seq"]
ROLLED = [*SERIES, "rolling_mean", "rolling_std"]
FLAGGED = [*ROLLED, "is_anomaly"]


def rounded(df: DataFrame) -> DataFrame:
    """Computed doubles to 8 decimals, so that two engines can be compared."""
    doubles = {c: F.round(c, DIGITS) for c, kind in df.dtypes if kind == "double"}
    return df.withColumns(doubles)


def orders(spark, sf_dir):
    return standins.order_readings(spark, sf_dir)


def latest(spark, sf_dir):
    parsed = payloads.parse_payloads(standins.last_payloads(spark, sf_dir))
    return payloads.good_readings(parsed)


# --- profiles and rankings ---------------------------------------------------------------------


def season_profile(spark, sf_dir):
    return profiles.season_profile(orders(spark, sf_dir))


def warmest_winter_top3(spark, sf_dir):
    return profiles.warmest_in_season(orders(spark, sf_dir), "winter", 3)


def season_spread(spark, sf_dir):
    return profiles.season_spread(orders(spark, sf_dir))


def most_stable_city(spark, sf_dir):
    return profiles.most_stable_city(orders(spark, sf_dir))


def table_summary(spark, sf_dir):
    return profiles.temperature_summary(orders(spark, sf_dir))


def city_summary(spark, sf_dir):
    return profiles.city_summary(orders(spark, sf_dir))


def season_summary(spark, sf_dir):
    return profiles.season_summary(orders(spark, sf_dir))


def one_season_summary(spark, sf_dir):
    return profiles.season_summary(orders(spark, sf_dir), "Summer")


def seasonal_profile(spark, sf_dir):
    return profiles.seasonal_profile(orders(spark, sf_dir))


def seasonal_profile_one_city(spark, sf_dir):
    return profiles.seasonal_profile(orders(spark, sf_dir), CITY)


def daily_mean(spark, sf_dir):
    return profiles.daily_mean(orders(spark, sf_dir))


def daily_mean_by_city(spark, sf_dir):
    return profiles.daily_mean(orders(spark, sf_dir), "city")


def city_list(spark, sf_dir):
    return profiles.city_list(orders(spark, sf_dir))


def city_count(spark, sf_dir):
    return profiles.city_count(orders(spark, sf_dir))


def first_two_cities(spark, sf_dir):
    return profiles.first_cities(orders(spark, sf_dir), 2)


def city_frequency(spark, sf_dir):
    return profiles.city_frequency(orders(spark, sf_dir))


def tail5_by_city(spark, sf_dir):
    return profiles.last_rows(orders(spark, sf_dir), 5)


def slice_40_50(spark, sf_dir):
    return profiles.rows_between(orders(spark, sf_dir), 40, 50)


def slice_deep(spark, sf_dir):
    """Far down the table; beyond the end of the smallest one."""
    return profiles.rows_between(orders(spark, sf_dir), 9_000, 9_010)


# --- rolling statistics and anomalies ----------------------------------------------------------


def rolling_30_7(spark, sf_dir):
    return rolling.rolling_stats(orders(spark, sf_dir), 30, 7).select(*ROLLED)


def rolling_30_30(spark, sf_dir):
    return rolling.rolling_stats(orders(spark, sf_dir), 30, 30).select(*ROLLED)


def rolling_within_season(spark, sf_dir):
    rolled = rolling.rolling_stats(orders(spark, sf_dir), 30, 7, keys=("city", "season"))
    return rolled.select(*ROLLED, "season")


def rolling_long_series(spark, sf_dir):
    """The same as rolling_30_7, with series of more than 500 rows cut into blocks."""
    rows = orders(spark, sf_dir)
    return rolling.rolling_stats(rows, 30, 7, series_rows=500).select(*ROLLED)


def anomaly_flags_30_7(spark, sf_dir):
    return rolling.rolling_anomalies(orders(spark, sf_dir), 30, 7).select(*FLAGGED)


def anomalies_30_7(spark, sf_dir):
    flagged = rolling.rolling_anomalies(orders(spark, sf_dir), 30, 7)
    return rolling.anomalies_only(flagged).select(*FLAGGED)


def anomalies_30_30(spark, sf_dir):
    flagged = rolling.rolling_anomalies(orders(spark, sf_dir), 30, 30)
    return rolling.anomalies_only(flagged).select(*FLAGGED)


def anomaly_counts(spark, sf_dir):
    return profiles.anomaly_counts(rolling.rolling_anomalies(orders(spark, sf_dir)))


def anomaly_extremes(spark, sf_dir):
    return profiles.anomaly_extremes(rolling.rolling_anomalies(orders(spark, sf_dir)))


# --- trend and season analysis -----------------------------------------------------------------


def first_timestamps(spark, sf_dir):
    rows = trend.with_first_timestamp(orders(spark, sf_dir))
    days = calendar.whole_days_since(F.col("timestamp"), F.col("first_timestamp"))
    return rows.select("city", "timestamp", "seq", "first_timestamp", days.alias("days"))


def trend_by_city(spark, sf_dir):
    return trend.linear_trend(orders(spark, sf_dir), ("city",))


def trend_by_city_season(spark, sf_dir):
    return trend.linear_trend(orders(spark, sf_dir), ("city", "season"))


def season_statistics(spark, sf_dir):
    return analysis.season_statistics(orders(spark, sf_dir), AS_OF)


def season_analysis(spark, sf_dir):
    return analysis.season_analysis(orders(spark, sf_dir), AS_OF)


def season_analysis_one_city(spark, sf_dir):
    return analysis.season_analysis(orders(spark, sf_dir), AS_OF, [CITY])


def season_analysis_of_region(spark, sf_dir):
    """The cities come from a table: the nations of one region."""
    nation = standins.table(spark, sf_dir, "nation")
    chosen = nation.where("n_regionkey = 2").select(F.col("n_name").alias("city"))
    return analysis.season_analysis(orders(spark, sf_dir), AS_OF, chosen)


def season_anomalies(spark, sf_dir):
    return analysis.season_anomalies(orders(spark, sf_dir), AS_OF).select(*FLAGGED)


# --- charts ------------------------------------------------------------------------------------


def histogram_30(spark, sf_dir):
    return charts.histogram(orders(spark, sf_dir), 30)


def histogram_one_city(spark, sf_dir):
    return charts.city_histogram(orders(spark, sf_dir), CITY, 30)


def histogram_by_city(spark, sf_dir):
    return charts.histogram(orders(spark, sf_dir), 30, ("city",))


def density_month(spark, sf_dir):
    return charts.density(orders(spark, sf_dir), 30)


def density_one_city(spark, sf_dir):
    return charts.city_density(orders(spark, sf_dir), CITY, 30)


def density_by_city(spark, sf_dir):
    return charts.density(orders(spark, sf_dir), 30, ("city",))


def chart_series(spark, sf_dir):
    return charts.chart_series(orders(spark, sf_dir).where(F.col("city") == CITY))


# --- norms and current readings ----------------------------------------------------------------


def city_norm(spark, sf_dir):
    return norms.city_norm(orders(spark, sf_dir))


def season_norm(spark, sf_dir):
    return norms.season_norm(orders(spark, sf_dir))


def day_month_norm(spark, sf_dir):
    return norms.day_month_norm(orders(spark, sf_dir))


def day_month_norm_without_anomalies(spark, sf_dir):
    return norms.day_month_norm(orders(spark, sf_dir), exclude_anomalies=True)


def _compare_current(norm):
    def query(spark, sf_dir):
        compared = current.compare_current(latest(spark, sf_dir), orders(spark, sf_dir), norm)
        return compared.select(
            "city", "observed_at", "temp_c", "mean", "std", "n", "lower", "upper", "status"
        )

    return query


def payload_status(spark, sf_dir):
    parsed = payloads.parse_payloads(standins.order_payloads(spark, sf_dir))
    return payloads.with_texts(parsed)


def payload_status_counts(spark, sf_dir):
    parsed = payloads.parse_payloads(standins.order_payloads(spark, sf_dir))
    return parsed.groupBy("payload_status").agg(F.count(F.lit(1)).alias("n"))


# --- comparison and recommendation -------------------------------------------------------------


def compare_cities_series(spark, sf_dir):
    return compare.compare_series(orders(spark, sf_dir), CITIES)


def compare_cities_means(spark, sf_dir):
    return compare.compare_means(orders(spark, sf_dir), CITIES)


def compare_cities_anomalies(spark, sf_dir):
    return compare.compare_anomalies(orders(spark, sf_dir), CITIES).select(*FLAGGED)


def compare_first_cities(spark, sf_dir):
    return compare.compare_means(orders(spark, sf_dir))


def compare_cities_of_region(spark, sf_dir):
    """The chosen cities come from a table: the nations of one region."""
    nation = standins.table(spark, sf_dir, "nation")
    chosen = nation.where("n_regionkey = 2").select(F.col("n_name").alias("city"))
    return compare.compare_means(orders(spark, sf_dir), chosen)


def suitable_rows(spark, sf_dir):
    return recommend.suitable_rows(orders(spark, sf_dir), "Summer", 20, 30)


def recommend_city(spark, sf_dir):
    return recommend.recommend_city(orders(spark, sf_dir), "Summer", 20, 30)


def recommend_nothing(spark, sf_dir):
    """No city is that hot: an empty result with the usual columns."""
    return recommend.recommend_city(orders(spark, sf_dir), "Summer", 900, 901)


def recommend_with_current(spark, sf_dir):
    return recommend.recommend_with_current(
        orders(spark, sf_dir), latest(spark, sf_dir), "Summer", 20, 30
    )


# --- expressions and sources -------------------------------------------------------------------


def calendar_columns(spark, sf_dir):
    ts = F.col("timestamp")
    name = calendar.season_name(ts)
    label = calendar.season_label(name)
    return orders(spark, sf_dir).select(
        "seq",
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day_of_month"),
        calendar.calendar_date(ts).alias("day"),
        calendar.month_start(ts).alias("month_start"),
        calendar.season_number(ts).alias("season_number"),
        name.alias("season_name"),
        label.alias("season_label"),
        calendar.season_number_of(label).alias("number_of_label"),
        calendar.date_text(ts).alias("day_text"),
        calendar.utc_to_epoch(ts).alias("epoch"),
        calendar.epoch_to_utc(calendar.utc_to_epoch(ts)).alias("from_epoch"),
        measures.kelvin_to_celsius(F.col("temperature") + 273.15).alias("celsius"),
        measures.two_decimals(F.col("temperature") / 8).alias("text"),
    )


def same_day_and_month(spark, sf_dir):
    return orders(spark, sf_dir).where(
        calendar.on_day_and_month("timestamp", 15, 7) & (F.col("city") == CITY)
    )


def season_rows(spark, sf_dir):
    return analysis.season_rows(orders(spark, sf_dir), AS_OF)


def clean_text_readings(spark, sf_dir):
    return readings.clean_readings(standins.raw_readings(spark, sf_dir))


def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "readings-csv")
    readings.write_csv(orders(spark, sf_dir), path, with_seq=True)
    return readings.read_csv(spark, path)


def _two_headers(spark, sf_dir):
    """Readings in two sets of files without numbers, whose columns stand in another order."""
    path = scratch_path(spark, "readings-two-headers")
    rows = orders(spark, sf_dir).withColumn("text", F.col("timestamp").cast("string"))
    in_second = F.col("seq") % 3 == 2
    for name, part, columns in (
        ("first", rows.where(~in_second), ["city", "text", "temperature", "season"]),
        ("second", rows.where(in_second), ["temperature", "season", "seq", "text", "city"]),
    ):
        ordered = part.repartitionByRange("seq").sortWithinPartitions("seq")
        columns = [F.lit("x").alias("note") if c == "seq" else F.col(c) for c in columns]
        named = ordered.select(*columns).withColumnRenamed("text", "timestamp")
        named.write.option("header", True).csv(f"{path}/{name}")
    return readings.read_csv(spark, [f"{path}/first", f"{path}/second"])


def csv_two_headers(spark, sf_dir):
    return _two_headers(spark, sf_dir)


def csv_first_seen_cities(spark, sf_dir):
    return profiles.city_list(_two_headers(spark, sf_dir))


def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "readings-parquet")
    readings.write_parquet(orders(spark, sf_dir), path)
    return readings.read_parquet(spark, path)


def _means(spark, sf_dir):
    """Suppliers as cities; the mean quantity shipped in a season is its mean temperature."""
    profile = profiles.season_profile(standins.shipment_readings(spark, sf_dir))
    return profile.select("city", "season", F.round("mean", DIGITS).alias("mean_temp"))


def synthetic_calendar(spark, sf_dir):
    return synthetic.synthetic_calendar(_means(spark, sf_dir))


def synthetic_readings(spark, sf_dir):
    return synthetic.synthetic_readings(_means(spark, sf_dir), seed=42)


# --- streams -----------------------------------------------------------------------------------


def stream_monitor(spark, sf_dir):
    folder = scratch_path(spark, "monitor")
    stream = monitor.as_current(standins.event_stream(spark, sf_dir))
    monitored = monitor.monitor_stream(stream, standins.event_readings(spark, sf_dir), "city")
    monitor.start_monitor(monitored, folder, availableNow=True).awaitTermination()
    return monitor.read_monitored(monitored, folder)


def stream_payload_monitor(spark, sf_dir):
    """Payload files land in a folder; the stream parses them and compares them with season norms."""
    landing, folder = scratch_path(spark, "landing"), scratch_path(spark, "monitor")
    bodies = standins.order_payloads(spark, sf_dir).select("value")
    bodies.write.text(landing)
    stream = payloads.good_readings(payloads.stream_payloads(spark, landing))
    monitored = monitor.monitor_stream(stream, orders(spark, sf_dir), "season")
    monitor.start_monitor(monitored, folder, availableNow=True).awaitTermination()
    return monitor.read_monitored(monitored, folder)


def stream_daily_mean(spark, sf_dir):
    folder = scratch_path(spark, "daily")
    means = daily.daily_mean_stream(standins.event_stream(spark, sf_dir))
    daily.start_daily_mean(means, folder, availableNow=True).awaitTermination()
    return daily.read_daily_mean(spark, folder)


def stream_rolling(spark, sf_dir):
    rolled = RollingStream(scratch_path(spark, "rolling"))
    rolled.start(standins.event_stream(spark, sf_dir), availableNow=True).awaitTermination()
    rolled.finish(spark)
    return rolled.rolled(spark).select(*FLAGGED)


def _halves(spark, sf_dir):
    """The readings of events up to the middle of the month, and all of them."""
    events = standins.event_readings(spark, sf_dir)
    return events.where(F.col("timestamp") < F.lit(MIDDLE).cast("timestamp_ntz")), events


def _land(spark, landing: str, events):
    """Add files of readings to a folder, and read the folder as a stream."""
    events.write.mode("append").parquet(landing)
    return spark.readStream.schema(events.schema).parquet(landing)


def stream_rolling_two_runs(spark, sf_dir):
    """A stream that is finished at the middle of the month goes on with the rest."""
    early, events = _halves(spark, sf_dir)
    landing, folder = scratch_path(spark, "landing"), scratch_path(spark, "rolling")
    for arrived in (early, events.join(early.select("seq"), "seq", "left_anti")):
        rolled = RollingStream(folder)
        stream = _land(spark, landing, arrived.select(*early.columns))
        rolled.start(stream, availableNow=True).awaitTermination()
        rolled.finish(spark)
    return rolled.rolled(spark).select(*FLAGGED)


def stream_monitor_versions(spark, sf_dir):
    """The first half of the readings against their own norms, the rest against the norms of all."""
    early, events = _halves(spark, sf_dir)
    landing, folder = scratch_path(spark, "landing"), scratch_path(spark, "monitor")
    store = scratch_path(spark, "norm-versions")
    late = events.join(early.select("seq"), "seq", "left_anti").select(*early.columns)
    for arrived, history in ((early, early), (late, events)):
        monitor.publish_norms(history, store, "city")
        stream = monitor.as_current(_land(spark, landing, arrived))
        query = monitor.start_versioned_monitor(stream, store, folder, "city", availableNow=True)
        query.awaitTermination()
    return monitor.read_versioned(spark, folder)


def stream_daily_mean_compacted(spark, sf_dir):
    """Daily means of a stream that arrives in eight micro-batches, whose sums are merged."""
    landing, folder = scratch_path(spark, "landing"), scratch_path(spark, "daily")
    events = standins.event_readings(spark, sf_dir)
    events.repartition(8, "seq").write.parquet(landing)
    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    )
    means = daily.daily_mean_stream(stream)
    daily.start_daily_mean(means, folder, availableNow=True).awaitTermination()
    return daily.read_daily_mean(spark, folder)


def stored_nan_readings(spark, sf_dir):
    """Readings that were stored with NaN come back without a temperature there."""
    path = scratch_path(spark, "readings-nan")
    broken = F.when(F.col("seq") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("temperature"))
    orders(spark, sf_dir).withColumn("temperature", broken).write.parquet(path)
    return profiles.city_summary(readings.read_parquet(spark, path))


QUERIES = {
    "season_profile": season_profile,
    "warmest_winter_top3": warmest_winter_top3,
    "season_spread": season_spread,
    "most_stable_city": most_stable_city,
    "table_summary": table_summary,
    "city_summary": city_summary,
    "season_summary": season_summary,
    "one_season_summary": one_season_summary,
    "seasonal_profile": seasonal_profile,
    "seasonal_profile_one_city": seasonal_profile_one_city,
    "daily_mean": daily_mean,
    "daily_mean_by_city": daily_mean_by_city,
    "city_list": city_list,
    "city_count": city_count,
    "first_two_cities": first_two_cities,
    "city_frequency": city_frequency,
    "tail5_by_city": tail5_by_city,
    "slice_40_50": slice_40_50,
    "slice_deep": slice_deep,
    "rolling_30_7": rolling_30_7,
    "rolling_30_30": rolling_30_30,
    "rolling_within_season": rolling_within_season,
    "rolling_long_series": rolling_long_series,
    "anomaly_flags_30_7": anomaly_flags_30_7,
    "anomalies_30_7": anomalies_30_7,
    "anomalies_30_30": anomalies_30_30,
    "anomaly_counts": anomaly_counts,
    "anomaly_extremes": anomaly_extremes,
    "first_timestamps": first_timestamps,
    "trend_by_city": trend_by_city,
    "trend_by_city_season": trend_by_city_season,
    "season_statistics": season_statistics,
    "season_analysis": season_analysis,
    "season_analysis_one_city": season_analysis_one_city,
    "season_analysis_of_region": season_analysis_of_region,
    "season_anomalies": season_anomalies,
    "histogram_30": histogram_30,
    "histogram_one_city": histogram_one_city,
    "histogram_by_city": histogram_by_city,
    "density_month": density_month,
    "density_one_city": density_one_city,
    "density_by_city": density_by_city,
    "chart_series": chart_series,
    "city_norm": city_norm,
    "season_norm": season_norm,
    "day_month_norm": day_month_norm,
    "day_month_norm_without_anomalies": day_month_norm_without_anomalies,
    "compare_current_day_month": _compare_current("day_month"),
    "compare_current_city": _compare_current("city"),
    "compare_current_season": _compare_current("season"),
    "payload_status": payload_status,
    "payload_status_counts": payload_status_counts,
    "compare_cities_series": compare_cities_series,
    "compare_cities_means": compare_cities_means,
    "compare_cities_anomalies": compare_cities_anomalies,
    "compare_first_cities": compare_first_cities,
    "compare_cities_of_region": compare_cities_of_region,
    "suitable_rows": suitable_rows,
    "recommend_city": recommend_city,
    "recommend_nothing": recommend_nothing,
    "recommend_with_current": recommend_with_current,
    "calendar_columns": calendar_columns,
    "same_day_and_month": same_day_and_month,
    "season_rows": season_rows,
    "clean_text_readings": clean_text_readings,
    "csv_roundtrip": csv_roundtrip,
    "csv_two_headers": csv_two_headers,
    "csv_first_seen_cities": csv_first_seen_cities,
    "parquet_roundtrip": parquet_roundtrip,
    "synthetic_calendar": synthetic_calendar,
    "synthetic_readings": synthetic_readings,
    "stream_monitor": stream_monitor,
    "stream_payload_monitor": stream_payload_monitor,
    "stream_daily_mean": stream_daily_mean,
    "stream_rolling": stream_rolling,
    "stream_rolling_two_runs": stream_rolling_two_runs,
    "stream_monitor_versions": stream_monitor_versions,
    "stream_daily_mean_compacted": stream_daily_mean_compacted,
    "stored_nan_readings": stored_nan_readings,
}


# The operators for training text, and the pipeline of them, are added where they are there.
try:
    import corpus_pipeline
    from weatherloom.llm import queries as text_queries
except ImportError:
    TEXT_QUERIES, TEXT_ORACLE = {}, {}
else:
    TEXT_QUERIES = {"pipeline": corpus_pipeline.run, **text_queries.QUERIES}
    TEXT_ORACLE = dict(text_queries.ORACLE)
    if corpus_pipeline.ORACLE_SQL:
        TEXT_ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


def _registered(query):
    return lambda spark, sf_dir: rounded(query(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    return rounded(anomaly_flags_30_7(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of (spark, folder of the tables)."""
    return {name: _registered(query) for name, query in QUERIES.items()} | TEXT_QUERIES


# --- the same in SQL ---------------------------------------------------------------------------


def _season(ts: str) -> str:
    return (
        f"CASE WHEN month({ts}) IN (12, 1, 2) THEN 'winter'"
        f" WHEN month({ts}) IN (3, 4, 5) THEN 'spring'"
        f" WHEN month({ts}) IN (6, 7, 8) THEN 'summer'"
        f" WHEN month({ts}) IN (9, 10, 11) THEN 'autumn' END"
    )


def _label(ts: str) -> str:
    return _season(ts).replace("'w", "'W").replace("'s", "'S").replace("'a", "'A")


def _number(ts: str) -> str:
    return (
        f"CASE WHEN month({ts}) IN (12, 1, 2) THEN 1 WHEN month({ts}) IN (3, 4, 5) THEN 2"
        f" WHEN month({ts}) IN (6, 7, 8) THEN 3 WHEN month({ts}) IN (9, 10, 11) THEN 4 END"
    )


TEMPERATURE_SQL = "(floor(o_totalprice / 100) / 100.0::DOUBLE - 10)"

READINGS_SQL = f"""
readings AS (
  SELECT n_name AS city, o_orderdate AS timestamp, {TEMPERATURE_SQL} AS temperature,
         {_season('o_orderdate')} AS season, o_orderkey AS seq
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

LATEST_SQL = """
latest AS (
  SELECT city, timestamp AS observed_at, 2 * temperature + 273.15::DOUBLE AS temp_k,
         (2 * temperature + 273.15::DOUBLE) - 273.15::DOUBLE AS temp_c
  FROM readings
  QUALIFY row_number() OVER (PARTITION BY city ORDER BY timestamp DESC, seq DESC) = 1
)"""

EVENTS_SQL = """
readings AS (
  SELECT event_type AS city, ts AS timestamp, value AS temperature, event_id AS seq FROM events
)"""


def _r(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) AS {name}"


def _rolled(mean_rows: int, std_rows: int, keys: str = "city", source: str = "readings") -> str:
    window = f"PARTITION BY {keys} ORDER BY timestamp, seq ROWS BETWEEN"
    m = f"({window} {mean_rows - 1} PRECEDING AND CURRENT ROW)"
    s = f"({window} {std_rows - 1} PRECEDING AND CURRENT ROW)"
    return f"""
rolled AS (
  SELECT *,
    CASE WHEN count(temperature) OVER {m} = {mean_rows}
         THEN avg(temperature) OVER {m} END AS rolling_mean,
    CASE WHEN count(temperature) OVER {s} = {std_rows}
         THEN stddev_samp(temperature) OVER {s} END AS rolling_std
  FROM {source}
),
flagged AS (
  SELECT *, coalesce(temperature > rolling_mean + 2 * rolling_std
                     OR temperature < rolling_mean - 2 * rolling_std, false) AS is_anomaly
  FROM rolled
)"""


_SERIES = f"city, timestamp, {_r('temperature', 'temperature')}, seq"
_ROLLED = f"{_SERIES}, {_r('rolling_mean', 'rolling_mean')}, {_r('rolling_std', 'rolling_std')}"
_FLAGGED = f"{_ROLLED}, is_anomaly"
_READING = f"{_SERIES}, season"
_SUMMARY = (
    f"{_r('min(temperature)', 'min')}, {_r('max(temperature)', 'max')},"
    f" {_r('avg(temperature)', 'mean')}"
)
_MEAN = _r("avg(temperature)", "mean")
_STD = _r("stddev_samp(temperature)", "std")


def _with(*parts: str) -> str:
    return "WITH " + ",".join((READINGS_SQL, *parts))


def _trend_sql(keys: str) -> str:
    return f"""
started AS (
  SELECT *, min(timestamp) OVER (PARTITION BY {keys}) AS first_timestamp FROM season_rows
),
slopes AS (
  SELECT {keys}, coalesce(regr_slope(temperature,
           date_diff('day', first_timestamp, timestamp)::DOUBLE), 0.0) AS slope
  FROM started GROUP BY {keys}
),
trends AS (
  SELECT *, CASE WHEN slope > 0 THEN 'positive' WHEN slope < 0 THEN 'negative'
                 ELSE 'none' END AS trend
  FROM slopes
)"""


_ALL_ROWS = "season_rows AS (SELECT * FROM readings)"
_SUMMER_ROWS = "season_rows AS (SELECT * FROM readings WHERE season = 'summer')"


def _season_analysis_sql(condition: str) -> str:
    return f"""{_with(_SUMMER_ROWS, _rolled(30, 7, source='season_rows'), _trend_sql('city'))},
figures AS (
  SELECT city, min(temperature) AS min, max(temperature) AS max, avg(temperature) AS mean
  FROM season_rows GROUP BY city
),
ending AS (
  SELECT * FROM flagged
  QUALIFY row_number() OVER (PARTITION BY city ORDER BY timestamp DESC, seq DESC) <= 5
)
SELECT {_FLAGGED}, season, {_r('min', 'min')}, {_r('max', 'max')}, {_r('mean', 'mean')},
       {_r('slope', 'slope')}, trend
FROM ending JOIN figures USING (city) JOIN trends USING (city) WHERE {condition}"""


def _binned(keys: str = "", condition: str = "true", bins: int = 30) -> str:
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    return f"""
ranged AS (
  SELECT *, min(temperature) {over} AS low, max(temperature) {over} AS high
  FROM readings WHERE {condition}
),
binned AS (
  SELECT *, CASE WHEN low = high THEN 0
    ELSE least(floor((temperature - low) / ((high - low) / {bins}.0::DOUBLE)), {bins - 1}) END::BIGINT
    AS bin
  FROM ranged
)"""


_EDGES = (
    f"bin, {_r('low + bin * ((high - low) / 30.0::DOUBLE)', 'bin_start')},"
    f" {_r('low + (bin + 1) * ((high - low) / 30.0::DOUBLE)', 'bin_end')}"
)


def _histogram_sql(keys: str = "", condition: str = "true") -> str:
    key = f"{keys}, " if keys else ""
    return f"""{_with(_binned(keys, condition))}
SELECT {key}{_EDGES}, count(*) AS n FROM binned GROUP BY {key}bin, low, high"""


def _density_sql(keys: str = "", condition: str = "true") -> str:
    key = f"{keys}, " if keys else ""
    return f"""{_with(_binned(keys, condition))}
SELECT {key}date_trunc('month', timestamp)::DATE AS month, {_EDGES}, count(*) AS n
FROM binned GROUP BY {key}date_trunc('month', timestamp), bin, low, high"""


def _norm_part(keys: str, value: str, source: str, k: int) -> str:
    return f"""
norms AS (
  SELECT *, mean - {k} * std AS lower, mean + {k} * std AS upper
  FROM (SELECT {keys}, avg({value}) AS mean, stddev_samp({value}) AS std, count({value}) AS n
        FROM {source} GROUP BY ALL)
)"""


_DAY_MONTH = "city, day(timestamp)::INTEGER AS day, month(timestamp)::INTEGER AS month"
_CITY_NORM = _norm_part("city", "temperature", "readings", 2)
_SEASON_NORM = _norm_part("city, season", "temperature", "readings", 2)
_DAY_MONTH_NORM = (
    f"{_rolled(30, 7)},{_norm_part(_DAY_MONTH, 'rolling_mean', 'flagged', 3)}"
)
_CALM_DAY_MONTH_NORM = (
    f"{_rolled(30, 7)},"
    + _norm_part(_DAY_MONTH, "rolling_mean", "(SELECT * FROM flagged WHERE NOT is_anomaly)", 3)
)
_BAND = (
    f"{_r('mean', 'mean')}, {_r('std', 'std')}, n,"
    f" {_r('lower', 'lower')}, {_r('upper', 'upper')}"
)
_STATUS = (
    "CASE WHEN temp_c > upper THEN 'above' WHEN temp_c < lower THEN 'below'"
    " ELSE 'normal' END AS status"
)


def _compare_sql(norm: str, match: str) -> str:
    return f"""{_with(LATEST_SQL, norm)}
SELECT latest.city, observed_at, {_r('temp_c', 'temp_c')}, {_BAND}, {_STATUS}
FROM latest LEFT JOIN norms ON latest.city = norms.city AND {match}"""


_CHOSEN = "city IN ('NATION_3', 'NATION_11', 'NATION_17')"
_SUITABLE = "month(timestamp) IN (6, 7, 8) AND temperature BETWEEN 20 AND 30"
_WINNER = f"""
winner AS (
  SELECT city, count(*) AS n FROM readings WHERE {_SUITABLE}
  GROUP BY city ORDER BY n DESC, city LIMIT 1
)"""

PAYLOADS_SQL = f"""
payloads AS (
  SELECT o_orderkey AS seq, n_name AS city,
    CASE WHEN o_orderstatus = 'F' THEN '200' WHEN o_orderstatus = 'P' THEN '401'
         WHEN o_orderpriority <> '5-LOW' THEN '404' END AS cod,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS observed_at,
    CASE WHEN o_orderstatus = 'F' THEN 2 * {TEMPERATURE_SQL} + 273.15::DOUBLE END AS temp_k
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
parsed AS (
  SELECT *, temp_k - 273.15::DOUBLE AS temp_c,
    CASE cod WHEN '401' THEN 'Invalid key' WHEN '404' THEN 'city not found' END AS message,
    CASE WHEN cod = '200' THEN 'ok' WHEN cod = '401' THEN 'invalid_key'
         WHEN cod IS NULL THEN 'unreadable' ELSE 'error' END AS payload_status
  FROM payloads
)"""

_GENERATED = f"""WITH readings AS (
  SELECT l_suppkey::VARCHAR AS city, {_season('l_shipdate')} AS season, l_quantity AS temperature
  FROM lineitem
),
means AS (
  SELECT city, season, {_r('avg(temperature)', 'mean_temp')} FROM readings GROUP BY city, season
),
days AS (SELECT unnest(range(0, 3650)) AS seq),
dated AS (SELECT seq, (DATE '2010-01-01' + seq::INTEGER)::TIMESTAMP AS timestamp FROM days),
cities AS (SELECT DISTINCT city FROM readings),
product AS (SELECT city, timestamp, {_season('timestamp')} AS season, seq FROM cities, dated),
generated AS (
  SELECT product.city, timestamp, product.season, mean_temp, seq
  FROM product LEFT JOIN means ON product.city = means.city AND product.season = means.season
)"""


def _uniform(salt: int) -> str:
    text = f"'42|{salt}|' || coalesce(city, '') || '|' || coalesce(timestamp::VARCHAR, '')"
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / {2**52}::DOUBLE)"


ORACLE = {
    "season_profile": f"{_with()} SELECT city, season, {_MEAN}, {_STD} FROM readings GROUP BY city, season",
    "warmest_winter_top3": f"""{_with()}
SELECT city, {_MEAN} FROM readings WHERE season = 'winter'
GROUP BY city ORDER BY avg(temperature) DESC, city LIMIT 3""",
    "season_spread": f"""{_with()}
SELECT city, {_r('stddev_samp(mean)', 'spread')}
FROM (SELECT city, season, avg(temperature) AS mean FROM readings GROUP BY city, season)
GROUP BY city""",
    "most_stable_city": f"""{_with()}
SELECT city, {_r('stddev_samp(mean)', 'spread')}
FROM (SELECT city, season, avg(temperature) AS mean FROM readings GROUP BY city, season)
GROUP BY city ORDER BY stddev_samp(mean) NULLS LAST, city LIMIT 1""",
    "table_summary": f"{_with()} SELECT {_SUMMARY} FROM readings",
    "city_summary": f"{_with()} SELECT city, {_SUMMARY} FROM readings GROUP BY city",
    "season_summary": f"{_with()} SELECT city, season, {_SUMMARY} FROM readings GROUP BY city, season",
    "one_season_summary": f"""{_with()}
SELECT city, season, {_SUMMARY} FROM readings WHERE season = 'summer' GROUP BY city, season""",
    "seasonal_profile": f"""{_with()}
SELECT city, ({_number('timestamp')})::INTEGER AS season_number, {_label('timestamp')} AS season,
       {_SUMMARY}, {_STD}
FROM readings GROUP BY ALL""",
    "seasonal_profile_one_city": f"""{_with()}
SELECT city, ({_number('timestamp')})::INTEGER AS season_number, {_label('timestamp')} AS season,
       {_SUMMARY}, {_STD}
FROM readings WHERE city = '{CITY}' GROUP BY ALL""",
    "daily_mean": f"{_with()} SELECT timestamp::DATE AS day, {_MEAN} FROM readings GROUP BY 1",
    "daily_mean_by_city": f"{_with()} SELECT city, timestamp::DATE AS day, {_MEAN} FROM readings GROUP BY 1, 2",
    "city_list": f"{_with()} SELECT city, min(seq) AS first_seq FROM readings GROUP BY city",
    "city_count": f"{_with()} SELECT count(DISTINCT city) AS cities FROM readings",
    "first_two_cities": f"""{_with()}
SELECT city, min(seq) AS first_seq FROM readings GROUP BY city ORDER BY first_seq LIMIT 2""",
    "city_frequency": f"{_with()} SELECT city, count(*) AS n FROM readings GROUP BY city",
    "tail5_by_city": f"""{_with()}
SELECT {_READING} FROM readings
QUALIFY row_number() OVER (PARTITION BY city ORDER BY timestamp DESC, seq DESC) <= 5""",
    "slice_40_50": f"{_with()} SELECT {_READING} FROM readings ORDER BY readings.seq LIMIT 10 OFFSET 40",
    "rolling_30_7": f"{_with(_rolled(30, 7))} SELECT {_ROLLED} FROM rolled",
    "rolling_30_30": f"{_with(_rolled(30, 30))} SELECT {_ROLLED} FROM rolled",
    "rolling_within_season": f"{_with(_rolled(30, 7, 'city, season'))} SELECT {_ROLLED}, season FROM rolled",
    "slice_deep": f"{_with()} SELECT {_READING} FROM readings ORDER BY readings.seq LIMIT 10 OFFSET 9000",
    "rolling_long_series": f"{_with(_rolled(30, 7))} SELECT {_ROLLED} FROM rolled",
    "anomaly_flags_30_7": f"{_with(_rolled(30, 7))} SELECT {_FLAGGED} FROM flagged",
    "anomalies_30_7": f"{_with(_rolled(30, 7))} SELECT {_FLAGGED} FROM flagged WHERE is_anomaly",
    "anomalies_30_30": f"{_with(_rolled(30, 30))} SELECT {_FLAGGED} FROM flagged WHERE is_anomaly",
    "anomaly_counts": f"""{_with(_rolled(30, 7))}
SELECT city, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM flagged GROUP BY city""",
    "anomaly_extremes": f"""{_with(_rolled(30, 7))},
counts AS (SELECT city, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM flagged GROUP BY city)
(SELECT 'most' AS extreme, city, anomalies FROM counts ORDER BY anomalies DESC, city LIMIT 1)
UNION ALL
(SELECT 'fewest' AS extreme, city, anomalies FROM counts ORDER BY anomalies, city LIMIT 1)""",
    "first_timestamps": f"""{_with(_ALL_ROWS, _trend_sql('city'))}
SELECT city, timestamp, seq, first_timestamp, date_diff('day', first_timestamp, timestamp) AS days
FROM started""",
    "trend_by_city": f"{_with(_ALL_ROWS, _trend_sql('city'))} SELECT city, {_r('slope', 'slope')}, trend FROM trends",
    "trend_by_city_season": f"""{_with(_ALL_ROWS, _trend_sql('city, season'))}
SELECT city, season, {_r('slope', 'slope')}, trend FROM trends""",
    "season_statistics": f"""{_with(_SUMMER_ROWS, _trend_sql('city'))}
SELECT city, season, {_SUMMARY}, {_r('any_value(slope)', 'slope')}, any_value(trend) AS trend
FROM season_rows JOIN trends USING (city) GROUP BY city, season""",
    "season_analysis": _season_analysis_sql("true"),
    "season_analysis_one_city": _season_analysis_sql(f"city = '{CITY}'"),
    "season_analysis_of_region": _season_analysis_sql(
        "city IN (SELECT n_name FROM nation WHERE n_regionkey = 2)"
    ),
    "season_anomalies": f"{_with(_SUMMER_ROWS, _rolled(30, 7, source='season_rows'))} SELECT {_FLAGGED} FROM flagged",
    "histogram_30": _histogram_sql(),
    "histogram_one_city": _histogram_sql("", f"city = '{CITY}'"),
    "histogram_by_city": _histogram_sql("city"),
    "density_month": _density_sql(),
    "density_one_city": _density_sql("", f"city = '{CITY}'"),
    "density_by_city": _density_sql("city"),
    "chart_series": f"""{_with()}
SELECT timestamp, {_r('temperature', 'temperature')} FROM readings WHERE city = '{CITY}'""",
    "city_norm": f"{_with(_CITY_NORM)} SELECT city, {_BAND} FROM norms",
    "season_norm": f"{_with(_SEASON_NORM)} SELECT city, season, {_BAND} FROM norms",
    "day_month_norm": f"{_with(_DAY_MONTH_NORM)} SELECT city, day, month, {_BAND} FROM norms",
    "day_month_norm_without_anomalies": f"{_with(_CALM_DAY_MONTH_NORM)} SELECT city, day, month, {_BAND} FROM norms",
    "compare_current_day_month": _compare_sql(
        _DAY_MONTH_NORM, "day(observed_at) = norms.day AND month(observed_at) = norms.month"
    ),
    "compare_current_city": _compare_sql(_CITY_NORM, "true"),
    "compare_current_season": _compare_sql(
        _SEASON_NORM, f"norms.season = {_season('observed_at')}"
    ),
    "payload_status": f"""WITH {PAYLOADS_SQL}
SELECT seq, city, observed_at, {_r('temp_k', 'temp_k')}, {_r('temp_c', 'temp_c')}, cod, message,
       payload_status, strftime(observed_at, '%Y-%m-%d') AS observed_date,
       printf('%.2f', temp_c) AS temp_c_text
FROM parsed""",
    "payload_status_counts": f"""WITH {PAYLOADS_SQL}
SELECT payload_status, count(*) AS n FROM parsed GROUP BY payload_status""",
    "compare_cities_series": f"""{_with()}
SELECT timestamp, {_r('temperature', 'temperature')}, city FROM readings WHERE {_CHOSEN}""",
    "compare_cities_means": f"{_with()} SELECT city, {_MEAN} FROM readings WHERE {_CHOSEN} GROUP BY city",
    "compare_cities_anomalies": f"{_with(_rolled(30, 30))} SELECT {_FLAGGED} FROM flagged WHERE {_CHOSEN}",
    "compare_first_cities": f"""{_with()},
firsts AS (SELECT city FROM readings GROUP BY city ORDER BY min(seq) LIMIT 2)
SELECT city, {_MEAN} FROM readings WHERE city IN (SELECT city FROM firsts) GROUP BY city""",
    "compare_cities_of_region": f"""{_with()}
SELECT city, {_MEAN} FROM readings
WHERE city IN (SELECT n_name FROM nation WHERE n_regionkey = 2) GROUP BY city""",
    "suitable_rows": f"{_with()} SELECT {_READING} FROM readings WHERE {_SUITABLE}",
    "recommend_city": f"{_with(_WINNER)} SELECT * FROM winner",
    "recommend_nothing": f"{_with(_WINNER)} SELECT * FROM winner WHERE false",
    "recommend_with_current": f"""{_with(LATEST_SQL, _WINNER)}
SELECT winner.city, n, observed_at, {_r('temp_k', 'temp_k')}, {_r('temp_c', 'temp_c')}
FROM winner LEFT JOIN latest ON winner.city = latest.city""",
    "calendar_columns": f"""{_with()}
SELECT seq, month(timestamp)::INTEGER AS month, day(timestamp)::INTEGER AS day_of_month,
       timestamp::DATE AS day, date_trunc('month', timestamp)::DATE AS month_start,
       ({_number('timestamp')})::INTEGER AS season_number, season AS season_name,
       {_label('timestamp')} AS season_label, ({_number('timestamp')})::INTEGER AS number_of_label,
       strftime(timestamp, '%Y-%m-%d') AS day_text, epoch(timestamp)::BIGINT AS epoch,
       timestamp AS from_epoch,
       {_r('(temperature + 273.15::DOUBLE) - 273.15::DOUBLE', 'celsius')},
       printf('%.2f', temperature / 8) AS text
FROM readings""",
    "same_day_and_month": f"""{_with()}
SELECT {_READING} FROM readings
WHERE day(timestamp) = 15 AND month(timestamp) = 7 AND city = '{CITY}'""",
    "season_rows": f"{_with()} SELECT {_READING} FROM readings WHERE season = 'summer'",
    "clean_text_readings": f"""
SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL ELSE n_name END AS city,
       CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderdate END AS timestamp,
       CASE WHEN o_orderstatus <> 'P' AND o_orderpriority NOT IN ('5-LOW', '1-URGENT')
            THEN {_r(TEMPERATURE_SQL, 'x').removesuffix(' AS x')} END AS temperature,
       {_season('o_orderdate')} AS season, o_orderkey AS seq
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "csv_roundtrip": f"{_with()} SELECT {_READING} FROM readings",
    "parquet_roundtrip": f"{_with()} SELECT {_READING} FROM readings",
    "csv_two_headers": f"""{_with()}
SELECT city, timestamp, {_r('temperature', 'temperature')}, season,
       row_number() OVER (ORDER BY seq % 3 = 2, seq) - 1 AS seq
FROM readings""",
    "csv_first_seen_cities": f"""{_with()}
SELECT city, min(place) AS first_seq
FROM (SELECT city, row_number() OVER (ORDER BY seq % 3 = 2, seq) - 1 AS place FROM readings)
GROUP BY city""",
    "synthetic_calendar": f"{_GENERATED} SELECT city, timestamp, season, mean_temp, seq FROM generated",
    "synthetic_readings": f"""{_GENERATED}
SELECT city, timestamp, season, seq,
       {_r(f"mean_temp + 5 * sqrt(-2 * ln({_uniform(1)})) * cos(2 * pi() * {_uniform(2)})", 'temperature')}
FROM generated""",
    "stream_monitor": f"""WITH {EVENTS_SQL},{_CITY_NORM}
SELECT readings.city, timestamp AS observed_at, {_r('temperature', 'temp_c')}, seq, {_BAND},
       {_STATUS.replace('temp_c', 'temperature')}
FROM readings LEFT JOIN norms ON readings.city = norms.city""",
    "stream_payload_monitor": f"""{_with(PAYLOADS_SQL, _SEASON_NORM)}
SELECT parsed.city, observed_at, {_r('temp_k', 'temp_k')}, {_r('temp_c', 'temp_c')},
       {_season('observed_at')} AS season, {_BAND}, {_STATUS}
FROM parsed LEFT JOIN norms
  ON parsed.city = norms.city AND norms.season = {_season('observed_at')}
WHERE payload_status = 'ok'""",
    "stream_daily_mean": f"""WITH {EVENTS_SQL}
SELECT city, timestamp::DATE AS day, {_MEAN} FROM readings GROUP BY 1, 2""",
    "stream_rolling": f"WITH {EVENTS_SQL},{_rolled(30, 7)} SELECT {_FLAGGED} FROM flagged",
    "stream_rolling_two_runs": f"WITH {EVENTS_SQL},{_rolled(30, 7)} SELECT {_FLAGGED} FROM flagged",
    "stream_monitor_versions": f"""WITH {EVENTS_SQL},
parts AS (SELECT *, CASE WHEN timestamp < TIMESTAMP '{MIDDLE}' THEN 1 ELSE 2 END AS half FROM readings),
history AS (SELECT city, temperature, 1 AS version FROM parts WHERE half = 1
            UNION ALL SELECT city, temperature, 2 FROM parts),{_norm_part('city, version', 'temperature', 'history', 2)}
SELECT parts.city, timestamp AS observed_at, {_r('temperature', 'temp_c')}, seq, {_BAND},
       {_STATUS.replace('temp_c', 'temperature')}, half::BIGINT AS norm_version
FROM parts LEFT JOIN norms ON parts.city = norms.city AND half = version""",
    "stream_daily_mean_compacted": f"""WITH {EVENTS_SQL}
SELECT city, timestamp::DATE AS day, {_MEAN} FROM readings GROUP BY 1, 2""",
    "stored_nan_readings": f"""{_with()}
SELECT city, {_SUMMARY}
FROM (SELECT city, CASE WHEN seq % 7 <> 0 THEN temperature END AS temperature FROM readings)
GROUP BY city""",
}


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL with the same result, for the queries that SQL can express."""
    return ORACLE | TEXT_ORACLE
