import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weatherloom.functions import calendar, measures


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def test_every_month_has_its_season(spark):
    dates = spark.sql("SELECT make_date(2021, id, 15) AS d FROM range(1, 13)")
    rows = dates.select(
        F.month("d").alias("m"),
        calendar.season_number("d").alias("n"),
        calendar.season_name("d").alias("s"),
    ).collect()
    for row in rows:
        assert row.n == row.m % 12 // 3 + 1
        assert row.s == ["winter", "spring", "summer", "autumn"][row.n - 1]


def test_season_labels_and_numbers(spark):
    row = one(
        spark,
        label=calendar.season_label(F.lit("winter")),
        number=calendar.season_number_of(F.lit("Autumn")),
        unknown=calendar.season_number_of(F.lit("monsoon")),
        missing=calendar.season_name(F.lit(None).cast("timestamp_ntz")),
    )
    assert (row.label, row.number, row.unknown, row.missing) == ("Winter", 4, None, None)


def test_current_season(spark):
    row = one(
        spark,
        july=calendar.current_season("1998-07-15"),
        december=calendar.current_season(dt.date(2020, 12, 1)),
        today=calendar.current_season(),
        expected=calendar.season_name(F.current_date()),
    )
    assert (row.july, row.december) == ("summer", "winter") and row.today == row.expected


def test_whole_days(spark):
    row = one(
        spark,
        almost=calendar.whole_days_since(ntz("2020-03-01 11:59:59"), ntz("2020-02-28 12:00:00")),
        two=calendar.whole_days_since(ntz("2020-03-01 12:00:00"), ntz("2020-02-28 12:00:00")),
        same=calendar.whole_days_since(ntz("2020-03-01"), ntz("2020-03-01")),
    )
    assert (row.almost, row.two, row.same) == (1, 2, 0)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_epochs_are_utc_in_every_session_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for text in ("2023-11-14 22:13:20", "2021-03-14 02:30:00", "1969-12-31 23:59:58"):
            seconds = int(pd.Timestamp(text).timestamp())
            row = one(
                spark,
                time=calendar.epoch_to_utc(F.lit(seconds)).cast("string"),
                back=calendar.utc_to_epoch(ntz(text)),
                wall=calendar.utc_wall_clock(calendar.utc_instant(ntz(text))).cast("string"),
                micros=F.unix_micros(calendar.utc_instant(ntz(text + ".25"))),
            )
            assert (row.time, row.back, row.wall) == (text, seconds, text)
            assert row.micros == seconds * 10**6 + 250000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_absurd_epoch_is_missing(spark):
    assert one(spark, t=calendar.epoch_to_utc(F.lit(10**18))).t is None


def test_day_and_month_and_range(spark):
    row = one(
        spark,
        leap=calendar.on_day_and_month(ntz("2020-02-29"), 29, 2),
        other=calendar.on_day_and_month(ntz("2021-02-28"), 29, 2),
        text=calendar.date_text(ntz("2021-02-28 10:00:00")),
        days=F.size(calendar.date_range(F.lit("2010-01-01").cast("date"), 3650)),
        last=F.element_at(calendar.date_range(F.lit("2010-01-01").cast("date"), 3650), -1),
        by_number=calendar.in_season(ntz("2021-02-28"), 1),
        by_label=calendar.in_season(ntz("2021-02-28"), "Winter"),
    )
    assert row.leap and not row.other and row.text == "2021-02-28"
    assert row.days == 3650 and row.last == dt.date(2019, 12, 29)
    assert row.by_number and row.by_label
    for unknown in ("Wintre", 0, 5, None):
        with pytest.raises(ValueError, match="unknown season"):
            calendar.in_season(ntz("2021-02-28"), unknown)


def test_verdicts_are_strict_and_missing_bounds_are_normal(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (3D, 1D, 3D), (3.1D, 1D, 3D), (0.9D, 1D, 3D), (9D, NULL, NULL),"
        " (NULL, 1D, 3D) AS t(v, lower, upper)"
    )
    status = measures.band_status(F.col("v"), F.col("lower"), F.col("upper"))
    got = [r.s for r in rows.select(status.alias("s")).collect()]
    assert got == ["normal", "above", "below", "normal", "normal"]
    outside = measures.outside_band(F.col("v"), F.lit(2.0), F.lit(None).cast("double"), 2)
    assert [r.s for r in rows.select(outside.alias("s")).collect()] == [False] * 5


def test_labels(spark):
    row = one(
        spark,
        up=measures.trend_label(F.lit(0.1)),
        down=measures.trend_label(F.lit(-0.1)),
        flat=measures.trend_label(F.lit(0.0)),
        missing=measures.trend_label(F.lit(None).cast("double")),
        ok=measures.payload_status(F.lit("200")),
        key=measures.payload_status(F.lit("401")),
        other=measures.payload_status(F.lit("404")),
        garbage=measures.payload_status(F.lit(None).cast("string")),
    )
    assert tuple(row) == (
        "positive", "negative", "none", "none", "ok", "invalid_key", "error", "unreadable",
    )


@pytest.mark.parametrize("value", [0.125, 1.005, 2.675, -0.001, 12345.678, 0.0, -3.5, 1e7 / 3])
def test_two_decimals_as_python_writes_them(spark, value):
    assert one(spark, t=measures.two_decimals(F.lit(value))).t == f"{value:.2f}"


def test_kelvin(spark):
    assert one(spark, c=measures.kelvin_to_celsius(F.lit(300.0))).c == 300.0 - 273.15


def test_noise_is_standard_normal_and_repeatable(spark):
    rows = spark.range(200_000)
    noise = measures.normal_noise(7, "id").alias("x")
    first = rows.select("id", noise).agg(F.avg("x"), F.stddev("x"), F.sum("x")).first()
    again = rows.repartition(13).select("id", noise).agg(F.sum("x")).first()
    assert abs(first[0]) < 0.01 and abs(first[1] - 1) < 0.01
    assert abs(first[2] - again[0]) < 1e-6
    other = rows.select(measures.normal_noise(8, "id").alias("x")).agg(F.sum("x")).first()
    assert other[0] != first[2]
