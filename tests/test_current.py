import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import same, series, to_pandas

from weatherloom.operators import norms
from weatherloom.operators.current import compare_current
from weatherloom.plans import pages

CURRENT = "city string, observed_at timestamp_ntz, temp_c double"


def rolling_means(frame, exclude=False):
    frame = frame.sort_values(["timestamp", "seq"]).copy()
    grouped = frame.groupby("city")["temperature"]
    frame["rolling_mean"] = grouped.transform(lambda x: x.rolling(30).mean())
    if exclude:
        std = grouped.transform(lambda x: x.rolling(7).std())
        band = 2 * std
        outside = (frame["temperature"] - frame["rolling_mean"]).abs() > band
        frame = frame[~outside]
    return frame


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("series_rows", [10**6, 150])
def test_day_month_norm(make, history, exclude, series_rows):
    got = to_pandas(
        norms.day_month_norm(make(history), exclude_anomalies=exclude, series_rows=series_rows),
        "city", "month", "day",
    )
    frame = rolling_means(history, exclude)
    keys = ["city", frame["timestamp"].dt.month.rename("month"), frame["timestamp"].dt.day.rename("day")]
    want = frame.groupby(keys)["rolling_mean"].agg(["mean", "std", "count"]).reset_index()
    assert got["day"].tolist() == want["day"].tolist()
    same(got["mean"], want["mean"])
    same(got["std"], want["std"])
    assert got["n"].tolist() == want["count"].tolist()
    same(got["upper"], want["mean"] + 3 * want["std"])
    same(got["lower"], want["mean"] - 3 * want["std"])


def test_city_and_season_norms(make, history):
    got = to_pandas(norms.city_norm(make(history)), "city")
    want = history.groupby("city")["temperature"].agg(["mean", "std"])
    same(got["lower"], want["mean"] - 2 * want["std"])
    winter = history[history["timestamp"].dt.month.isin([12, 1, 2])]
    want = winter.groupby("city")["temperature"].agg(["mean", "std"])
    got = to_pandas(norms.season_norm(make(history)).where("season = 'winter'"), "city")
    same(got["upper"], want["mean"] + 2 * want["std"])


def test_verdicts(spark, make, history):
    long = history[history["city"] == "Long"]["temperature"]
    high, low = long.mean() + 2.1 * long.std(), long.mean() - 2.1 * long.std()
    day = dt.datetime(2024, 7, 1, 12)
    rows = [("Long", day, high), ("Long", day, low), ("Long", day, long.mean()), ("Mars", day, 99.0)]
    current = spark.createDataFrame([(c, t, float(v)) for c, t, v in rows], CURRENT)
    got = compare_current(current, make(history), "city").toPandas()
    assert len(got) == 4
    assert sorted(got["status"]) == ["above", "below", "normal", "normal"]
    assert got[got["city"] == "Mars"]["lower"].isna().all()
    wide = compare_current(current, make(history), "city", k=3)
    assert {r.status for r in wide.collect()} == {"normal"}


def test_leap_day_with_one_year_of_history_is_normal(spark, make):
    frame = series("Leap", 120, "2020-01-15")
    current = spark.createDataFrame([("Leap", dt.datetime(2024, 2, 29), 500.0)], CURRENT)
    row = compare_current(current, make(frame), "day_month").first()
    assert row["n"] == 1 and row["std"] is None and row["status"] == "normal"
    other = spark.createDataFrame([("Leap", dt.datetime(2023, 12, 24), 500.0)], CURRENT)
    assert compare_current(other, make(frame), "day_month").first()["status"] == "normal"


def test_day_month_verdict_uses_the_spread_of_rolling_means(spark, make):
    frame = series("A", 1200, "2016-01-01")
    rows = rolling_means(frame.assign(seq=np.arange(len(frame))))
    day = rows[(rows["timestamp"].dt.day == 10) & (rows["timestamp"].dt.month == 6)]["rolling_mean"]
    edge = day.mean() + 3 * day.std()
    current = spark.createDataFrame(
        [("A", dt.datetime(2024, 6, 10), float(edge + d)) for d in (0.01, -0.01)],
        CURRENT,
    )
    got = compare_current(current, make(frame), "day_month").orderBy("temp_c").collect()
    assert [r.status for r in got] == ["normal", "above"]


def test_unknown_norm(spark, make, history):
    with pytest.raises(ValueError):
        compare_current(spark.createDataFrame([], CURRENT), make(history), "month")


def test_pages_hold_the_tables_of_each_view(spark, make, history):
    rows = make(history)
    current = spark.createDataFrame(
        [("Long", dt.datetime(2024, 7, 1), 10.0), ("Gaps", dt.datetime(2024, 7, 1), 11.0)], CURRENT
    )
    overview = pages.overview(rows, "Long", "Winter", current)
    assert overview["city"].first()["city"] == "Long"
    assert overview["season"].first()["season"] == "winter"
    assert overview["current"].first()["temp_c"] == 10.0
    graphs = pages.graphs(rows, "Long")
    assert graphs["series"].count() == 900 and graphs["seasons"].count() == 4
    present = int(history[history["city"] == "Long"]["temperature"].notna().sum())
    for name in ("histogram", "density"):
        assert graphs[name].toPandas()["n"].sum() == present
    assert graphs["anomalies"].count() == 900 and graphs["daily"].count() == 900
    compared = pages.comparison(rows)
    assert {r.city for r in compared["means"].collect()} == {"Long", "Gaps"}
    assert compared["anomalies"].count() == compared["series"].count()
    trip = pages.trip(rows, current, "Summer", -50, 50).collect()
    assert [(r.city, r.temp_c) for r in trip] == [("Long", 10.0)]
    assert pages.trip(rows, current, "Summer", 900, 901).count() == 0


def test_recommended_city_without_a_current_reading(spark, make, history):
    nothing = spark.createDataFrame([], CURRENT)
    row = pages.trip(make(history), nothing, "Winter", -50, 50).first()
    assert row["city"] == "Long" and row["temp_c"] is None


def test_recommendation_counts_a_closed_range(make):
    frame = pd.DataFrame(
        {
            "city": ["B", "B", "A", "A", "C", "C"],
            "timestamp": pd.to_datetime(["2020-07-01"] * 5 + ["2020-01-01"]),
            "temperature": [20.0, 30.0, 25.0, 26.0, 30.01, 25.0],
        }
    )
    from weatherloom.operators.recommend import recommend_city, suitable_rows

    rows = make(frame)
    assert suitable_rows(rows, 3, 20, 30).count() == 4
    assert tuple(recommend_city(rows, "summer").first()) == ("A", 2)


def test_only_the_norms_asked_for_are_computed(spark, make, history):
    asked = spark.createDataFrame(
        [("Long", dt.datetime(2020, 3, 4), 11.0), ("Long", None, 1.0), (None, dt.datetime(2020, 3, 4), 1.0)],
        CURRENT,
    )
    compared = compare_current(asked, make(history))
    plan = compared._jdf.queryExecution().optimizedPlan().toString()
    # The choice of cities is below the windows, that of days above them and below the aggregate.
    aggregate, window = plan.index("Aggregate [city"), plan.index("Window")
    joins = [i for i in range(len(plan)) if plan.startswith("Join LeftSemi", i)]
    assert len(joins) == 2 and aggregate < joins[0] < window < joins[1]
    assert {r.city: r.n for r in compared.where("observed_at IS NOT NULL").collect()} == {"Long": 3, None: None}
    norm = norms.day_month_norm(make(history)).where("city = 'Long' AND month = 3 AND day = 4").first()
    (row,) = compared.where("city = 'Long' AND observed_at IS NOT NULL").collect()
    assert (row.mean, row.std) == pytest.approx((norm["mean"], norm["std"]))
