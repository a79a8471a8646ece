import numpy as np
import pandas as pd
import pytest
from conftest import same, series, to_pandas
from pyspark.sql import functions as F

from weatherloom.operators import profiles

SEASONS = ["winter", "spring", "summer", "autumn"]


def with_season(frame):
    frame = frame.copy()
    frame["season"] = (frame["timestamp"].dt.month % 12 // 3).map(dict(enumerate(SEASONS)))
    return frame


def test_season_profile(make, history):
    got = to_pandas(profiles.season_profile(make(history)), "city", "season")
    grouped = with_season(history).groupby(["city", "season"])["temperature"]
    want = grouped.agg(["mean", "std"]).reset_index()
    assert got["season"].tolist() == want["season"].tolist()
    same(got["mean"], want["mean"])
    same(got["std"], want["std"])


def test_seasonal_profile_of_one_city(make, history):
    got = to_pandas(profiles.seasonal_profile(make(history), "Long"), "season_number")
    assert got["season"].tolist() == ["Winter", "Spring", "Summer", "Autumn"]
    long = history[history["city"] == "Long"]
    numbers = long["timestamp"].dt.month % 12 // 3 + 1
    want = long.groupby(numbers)["temperature"].agg(["mean", "std", "max", "min"])
    for name in want:
        same(got[name], want[name])


def test_derived_season_ignores_the_stored_one(make):
    frame = series("A", 3, "2020-07-01")
    frame["season"] = "winter"
    rows = make(frame)
    assert profiles.season_summary(rows, "Summer").count() == 1
    assert profiles.season_summary(rows, "winter").count() == 0
    assert profiles.season_profile(rows).first().season == "winter"


def test_summaries(make, history):
    rows = make(history)
    got = to_pandas(profiles.city_summary(rows), "city")
    want = history.groupby("city")["temperature"].agg(["min", "max", "mean"])
    for name in want:
        same(got[name], want[name])
    total = profiles.temperature_summary(rows).first()
    assert total["max"] == history["temperature"].max()


def test_daily_mean_joins_the_readings_of_a_day(make, history):
    got = to_pandas(profiles.daily_mean(make(history)), "day")
    want = history.groupby(history["timestamp"].dt.date)["temperature"].mean()
    assert got["day"].tolist() == want.index.tolist()
    same(got["mean"], want)


def test_most_stable_city_puts_missing_last(make, history):
    means = with_season(history).groupby(["city", "season"])["temperature"].mean()
    want = means.groupby("city").std().sort_values()
    got = profiles.most_stable_city(make(history)).first()
    assert got["city"] == want.index[0] and abs(got["spread"] - want.iloc[0]) < 1e-9
    assert profiles.season_spread(make(history)).where("city = 'One'").first()["spread"] is None


def test_warmest_and_ties_by_name(make):
    frame = pd.DataFrame(
        {
            "city": ["D", "B", "C", "A", "A"],
            "timestamp": pd.to_datetime(["2020-01-01"] * 4 + ["2020-07-01"]),
            "temperature": [1.0, 7.0, 7.0, 3.0, 90.0],
        }
    )
    got = [r.city for r in profiles.warmest_in_season(make(frame), "winter", 3).collect()]
    assert got == ["B", "C", "A"]


def test_lists_of_cities(make, history):
    rows = make(history).repartition(3)
    order = history["city"].unique().tolist()
    assert [r.city for r in profiles.city_list(rows).collect()] == order
    assert [r.city for r in profiles.first_cities(rows).collect()] == order[:2]
    assert profiles.city_count(rows).first()["cities"] == len(order)
    top = profiles.most_frequent_city(rows).first()
    assert (top["city"], top["n"]) == ("Long", 900)


def test_last_rows(make, history):
    got = to_pandas(profiles.last_rows(make(history), 5), "seq")
    want = history.groupby("city").tail(5).sort_values("seq")
    assert got["seq"].tolist() == want["seq"].tolist()


@pytest.mark.parametrize("start, stop", [(40, 50), (1600, 1700), (0, 1), (5, 5), (9000, 9010)])
def test_slices(make, history, start, stop):
    # Gaps in seq, and rows out of order.
    rows = make(history.assign(seq=history["seq"] * 977)).repartition(4)
    got = [r.seq for r in profiles.rows_between(rows, start, stop).collect()]
    assert got == [977 * i for i in range(start, min(stop, len(history)))]


def test_grouped_results_come_in_order(make, history):
    rows = make(history).repartition(5)
    days = [r.day for r in profiles.daily_mean(rows).collect()]
    assert days == sorted(days)
    for df, keys in (
        (profiles.seasonal_profile(rows), ("city", "season_number")),
        (profiles.season_profile(rows), ("city", "season")),
        (profiles.city_means(rows), ("city",)),
    ):
        found = [tuple(r[k] for k in keys) for r in df.collect()]
        assert found == sorted(found)


def test_stored_nan_is_missing(spark, make, tmp_path):
    from weatherloom.operators.rolling import rolling_anomalies
    from weatherloom.sources import readings

    frame = series("A", 80)
    clean = make(frame.drop(index=40))
    broken = make(frame).withColumn(
        "temperature", F.when(F.col("seq") == 40, F.lit(float("nan"))).otherwise(F.col("temperature"))
    )
    broken.write.parquet(str(tmp_path / "raw"))
    readings.write_parquet(broken, str(tmp_path / "stored"))
    for name in ("raw", "stored"):
        stored = readings.read_parquet(spark, str(tmp_path / name))
        (found,), (expected,) = (profiles.city_summary(x).collect() for x in (stored, clean))
        assert found["max"] == expected["max"]
        assert found["mean"] == pytest.approx(expected["mean"])
        assert rolling_anomalies(stored).where("seq between 40 and 69 and is_anomaly").count() == 0


def test_missing_cities_and_seasons_form_no_group(make):
    frame = series("A", 4)
    frame.loc[1, "city"] = None
    frame.loc[2, "timestamp"] = pd.NaT
    rows = make(frame)
    assert profiles.season_profile(rows).count() == 1
    assert [r.city for r in profiles.city_summary(rows).collect()] == ["A"]
    assert profiles.daily_mean(rows).count() == 3
    assert np.isclose(
        profiles.city_means(rows).first()["mean"], frame["temperature"].iloc[[0, 2, 3]].mean()
    )
