import datetime as dt
import json

import pandas as pd
import pytest
from conftest import SMALL, to_pandas
from pyspark.sql import functions as F

from weatherloom.functions.calendar import season_name
from weatherloom.sources import csv_files, payloads, readings, standins, synthetic

MESSY = """city,timestamp,temperature,season
Oslo,2023-01-01,-3.5,Winter
Oslo,2023-01-02 06:30:00,NaN,winter
Oslo,not a date,1.5,Winter
Oslo,2023-02-30,2.5,Winter
Oslo,2023-01-05,,Winter
Oslo,2023-01-06,N/A,NA
Oslo,2023-01-07,warm,Winter
NA,2023-01-08,4.5,Winter
,2023-01-09,5.5,null
"Rio, old",2023-01-10,6.5,SUMMER
"""


def test_messy_csv(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text(MESSY)
    got = to_pandas(readings.read_csv(spark, str(path)), "seq")
    assert len(got) == 10
    temperatures = [-3.5, None, 1.5, 2.5, None, None, None, 4.5, 5.5, 6.5]
    assert got["temperature"].astype(object).where(got["temperature"].notna(), None).tolist() == (
        temperatures
    )
    assert got["timestamp"].isna().tolist() == [False, False, True, True] + [False] * 6
    assert got["timestamp"][1] == pd.Timestamp("2023-01-02 06:30:00")
    assert got["city"].isna().tolist() == [False] * 7 + [True, True, False]
    assert got["city"][9] == "Rio, old"
    assert got["season"].tolist() == ["winter"] * 5 + [None, "winter", "winter", None, "summer"]


def test_columns_are_found_by_name_and_season_is_derived(spark, tmp_path):
    path = tmp_path / "other.csv"
    path.write_text("temperature,extra,timestamp,city\n1.5,x,2020-07-01,Oslo\n2.5,y,broken,Oslo\n")
    rows = readings.read_csv(spark, str(path)).orderBy("seq").collect()
    assert [r.season for r in rows] == ["summer", None]
    assert rows[0].temperature == 1.5 and rows[0].timestamp == dt.datetime(2020, 7, 1)


def write_lines(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))


def test_files_with_columns_in_another_order(spark, tmp_path):
    write_lines(tmp_path / "in" / "b 1%20[x].csv", "season,temperature,city,timestamp", "Winter,1.5,Oslo,2023-01-01")
    write_lines(tmp_path / "in" / "a.csv", "city,timestamp,temperature", "Rome,2023-07-02,30", '"Rio, old",2023-07-03,31')
    write_lines(tmp_path / "in" / "c.csv", "\ufeffcity,timestamp,temperature", "Rome,2023-07-04,32")
    write_lines(tmp_path / "in" / "d.csv", "city,timestamp,temperature,season")
    (tmp_path / "in" / "e.csv").write_text("")
    (tmp_path / "in" / "f.csv").write_text("timestamp,city,temperature\r\n2023-01-05,Oslo,2\r\n")
    by_driver, by_job = (
        [(columns, [f.split("/")[-1] for f in files]) for columns, files in found]
        for found in (csv_files.headers(spark, str(tmp_path / "in"), n) for n in (200, 0))
    )
    assert by_driver == by_job and len(by_driver) == 4
    rows = readings.read_csv(spark, str(tmp_path / "in")).orderBy("seq").collect()
    assert [(r.seq, r.city, r.timestamp.day, r.temperature, r.season) for r in rows] == [
        (0, "Rome", 2, 30.0, "summer"),
        (1, "Rio, old", 3, 31.0, "summer"),
        (2, "Oslo", 1, 1.5, "winter"),
        (3, "Rome", 4, 32.0, "summer"),
        (4, "Oslo", 5, 2.0, "winter"),
    ]


def test_a_header_without_a_needed_column_is_an_error(spark, tmp_path):
    write_lines(tmp_path / "in" / "a.csv", "city,timestamp,temperature", "Rome,2023-07-02,30")
    write_lines(tmp_path / "in" / "b.csv", "city,when,temperature", "Rome,2023-07-02,30")
    with pytest.raises(ValueError, match="b.csv: no column timestamp"):
        readings.read_csv(spark, str(tmp_path / "in"))


def test_rows_are_numbered_across_blocks_and_files(spark, tmp_path):
    n = 0
    for name, size in (("a", 700), ("b", 1), ("c", 0), ("d", 400)):
        lines = [f"C{i},2023-01-01,{i}" for i in range(n, n + size)]
        write_lines(tmp_path / "in" / f"{name}.csv", "city,timestamp,temperature", *lines)
        n += size
    settings = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "100"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = readings.read_csv(spark, str(tmp_path / "in"))
        assert rows.rdd.getNumPartitions() > 5
        assert [int(r.city[1:]) for r in rows.orderBy("seq").collect()] == list(range(n))
        assert sorted(r.seq for r in rows.where("temperature >= 600").collect()) == list(range(600, n))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    # Cut anew, the files have other blocks than those that were counted.
    with pytest.raises(Exception, match="other blocks"):
        rows.sparkSession.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        try:
            rows.where("seq >= 0").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before["spark.sql.files.maxPartitionBytes"])


def test_chosen_cities_reach_the_csv_files(spark, tmp_path):
    write_lines(tmp_path / "a" / "1.csv", "city,timestamp,temperature", "Oslo,2023-07-02,1", "Rome,2023-07-02,30")
    write_lines(tmp_path / "a" / "2.csv", "temperature,city,timestamp", "31,Rome,2023-07-02", "32,NA,2023-07-02")
    write_lines(tmp_path / "b" / "1.csv", "seq,city,timestamp,temperature", "5,Rome,2023-07-02,30", "6,Oslo,2023-07-02,1")
    write_lines(tmp_path / "b" / "2.csv", "city,timestamp,temperature,seq", "Rome,2023-07-02,30,7")
    stored = readings.read_csv(spark, str(tmp_path / "b"), cities=["Rome", "Lima", "NA"])
    assert stored._jdf.queryExecution().toString().count("PushedFilters: [In(city, [Lima,Rome])]") == 2
    assert sorted(r.seq for r in stored.collect()) == [5, 7]
    numbered = readings.read_csv(spark, str(tmp_path / "a"), cities=["Rome", "NA"])
    assert sorted((r.city, r.seq) for r in numbered.collect()) == [("Rome", 1), ("Rome", 2)]


def test_csv_sink_has_a_header_and_keeps_microseconds(spark, tmp_path, make):
    frame = pd.DataFrame(
        {
            "city": ["A", None],
            "timestamp": [pd.Timestamp("2020-01-01"), pd.Timestamp("2020-07-01 01:02:03.000004")],
            "temperature": [1.25, None],
        }
    )
    path = str(tmp_path / "out")
    readings.write_csv(make(frame), path)
    header = spark.read.text(path).where("value LIKE 'city%'").first()[0]
    assert header == "city,timestamp,temperature,season"
    back = readings.read_csv(spark, path).orderBy("timestamp").collect()
    assert (back[0].city, back[0].temperature, back[0].season) == ("A", 1.25, "winter")
    assert back[1].timestamp == dt.datetime(2020, 7, 1, 1, 2, 3, 4)
    assert back[1].city is None and back[1].temperature is None


def test_nan_in_typed_columns_becomes_missing(spark):
    raw = spark.sql("SELECT 'A' AS city, timestamp_ntz'2020-01-01' AS timestamp, double('NaN') AS temperature")
    row = readings.clean_readings(raw).first()
    assert row.temperature is None and row.season == "winter"


def test_filters_and_columns_reach_the_parquet_files(spark, tmp_path, make, history):
    path = str(tmp_path / "store")
    readings.write_parquet(make(history), path)
    stored = readings.read_parquet(spark, path)
    assert stored.count() == len(history)
    plan = stored.where("city = 'Long'").select("temperature")._jdf.queryExecution().toString()
    assert "EqualTo(city,Long)" in plan
    assert "ReadSchema: struct<city:string,temperature:double>" in plan


PAYLOADS = [
    '{"cod":200,"dt":1700000000,"name":"Oslo","main":{"temp":271.4}}',
    '{"cod":401,"message":"Invalid key"}',
    '{"cod":"404","message":"city not found"}',
    "<html>busy</html>",
    "",
]


def test_indented_payload_documents(spark, tmp_path):
    body = {"cod": 200, "dt": 1700000000, "name": "Oslo", "main": {"temp": 280.15}}
    (tmp_path / "a.json").write_text(json.dumps(body, indent=2) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"cod": 401, "message": "no key"}, indent=2))
    (tmp_path / "c.json").write_text("{ broken\n")
    rows = payloads.read_payloads(spark, str(tmp_path), whole=True).collect()
    assert len(rows) == 3
    good = [r for r in rows if r.payload_status == "ok"]
    assert [(r.city, round(r.temp_c, 6)) for r in good] == [("Oslo", 7.0)]
    assert [r.message for r in rows if r.cod and r.payload_status != "ok"] == ["no key"]
    assert "unreadable" in {r.payload_status for r in rows}


def test_payload_kinds(spark, tmp_path):
    path = tmp_path / "payloads.txt"
    path.write_text("\n".join(PAYLOADS[:4]) + "\n")
    rows = payloads.with_texts(payloads.read_payloads(spark, str(path))).collect()
    by_status = {r.payload_status: r for r in rows}
    assert set(by_status) == {"ok", "invalid_key", "error", "unreadable"}
    good = by_status["ok"]
    assert good.city == "Oslo" and good.observed_at == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert good.temp_c == 271.4 - 273.15 and good.temp_c_text == f"{271.4 - 273.15:.2f}"
    assert good.observed_date == "2023-11-14"
    assert by_status["invalid_key"].message == "Invalid key"
    assert by_status["error"].cod == "404" and by_status["error"].temp_c is None


def test_the_asked_city_goes_before_the_name(spark):
    raw = spark.createDataFrame([("Asked", PAYLOADS[0]), (None, PAYLOADS[0])], "city string, body string")
    parsed = payloads.parse_payloads(raw, "body")
    assert {r.city for r in parsed.collect()} == {"Asked", "Oslo"}
    assert payloads.good_readings(parsed).columns == ["city", "observed_at", "temp_k", "temp_c"]


def test_synthetic_readings_have_the_usual_size_and_seasons(spark):
    rows = synthetic.synthetic_readings(synthetic.seasonal_means(spark), seed=3).cache()
    assert rows.count() == 15 * 3650
    span = rows.agg(F.min("timestamp"), F.max("timestamp"), F.count_distinct("seq")).first()
    assert tuple(span) == (dt.datetime(2010, 1, 1), dt.datetime(2019, 12, 29), 15 * 3650)
    assert rows.where(F.col("season") != season_name("timestamp")).isEmpty()
    first = rows.orderBy("seq").first()
    assert first.city == "New York" and first.timestamp == dt.datetime(2010, 1, 1)
    means = synthetic.seasonal_means(spark)
    noise = rows.join(means, ["city", "season"]).select(
        (F.col("temperature") - F.col("mean_temp")).alias("x")
    )
    mean, std = noise.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(mean) < 0.15 and abs(std - 5) < 0.1
    again = synthetic.synthetic_readings(means.repartition(7), seed=3, task_rows=10_000)
    assert again.rdd.getNumPartitions() > 4
    assert again.exceptAll(rows).isEmpty()
    rows.unpersist()


def test_many_cities_are_generated_by_many_tasks(spark):
    means = spark.range(500).selectExpr("concat('C', id) AS city", "'winter' AS season", "1.0D AS mean_temp")
    rows = synthetic.synthetic_calendar(means)
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 500 * 3650 and len(sizes) >= 8 and max(sizes) < 400_000


def test_standin_readings_match_their_schema(spark):
    rows = standins.order_readings(spark, SMALL)
    assert rows.count() == 1500
    assert dict(rows.dtypes) == {
        "city": "string",
        "timestamp": "timestamp_ntz",
        "temperature": "double",
        "season": "string",
        "seq": "bigint",
    }
