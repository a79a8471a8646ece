import numpy as np
import pandas as pd
from conftest import series, to_pandas

from weatherloom.operators import charts, compare


def test_histogram_equals_numpy(make, history):
    # Without rounding, so that no value lies on an inner edge.
    frame = history.assign(temperature=np.random.default_rng(5).normal(10, 6, len(history)))
    frame.loc[::50, "temperature"] = np.nan
    counts, edges = np.histogram(frame["temperature"].dropna(), bins=30)
    got = to_pandas(charts.histogram(make(frame), 30), "bin").set_index("bin")
    assert got["n"].reindex(range(30), fill_value=0).tolist() == counts.tolist()
    assert np.allclose(got["bin_start"], edges[got.index])
    assert np.allclose(got["bin_end"], edges[got.index + 1])


def test_histogram_per_city_counts_every_present_value(make, history):
    got = charts.histogram(make(history), 30, ("city",)).toPandas()
    want = history.groupby("city")["temperature"].count()
    assert got.groupby("city")["n"].sum().to_dict() == want.to_dict()
    assert got["bin"].between(0, 29).all()
    alone = charts.city_histogram(make(history), "Gaps", 30).toPandas()
    part = got[got["city"] == "Gaps"]
    assert sorted(alone["n"]) == sorted(part["n"])


def test_equal_values_fall_into_bin_zero(make):
    flat = series("Flat", 12)
    flat["temperature"] = 3.25
    assert [tuple(r) for r in charts.histogram(make(flat)).collect()] == [(0, 3.25, 3.25, 12)]
    assert charts.histogram(make(flat.iloc[:0])).count() == 0


def test_density_counts_every_present_value(make, history):
    got = charts.density(make(history), 30).toPandas()
    assert got["n"].sum() == history["temperature"].notna().sum()
    months = pd.to_datetime(got["month"])
    assert (months.dt.day == 1).all()
    by_month = got.groupby(months)["n"].sum()
    present = history.dropna(subset=["temperature"])
    want = present.groupby(present["timestamp"].dt.to_period("M").dt.to_timestamp()).size()
    assert by_month.tolist() == want.tolist()


def test_series_are_in_time_order(make, history):
    got = [r.timestamp for r in charts.chart_series(make(history), "city").collect()]
    assert got == sorted(got) and len(got) == len(history)


def test_chosen_cities(spark, make, history):
    rows = make(history)
    assert {r.city for r in compare.compare_means(rows).collect()} == {"Long", "Gaps"}
    names = ["L30", "One", "Nowhere"]
    assert compare.compare_series(rows, names).count() == 31
    table = spark.createDataFrame([(n,) for n in names], "city string")
    assert compare.compare_series(rows, table).count() == 31
    flagged = compare.compare_anomalies(rows, ["Long"])
    assert flagged.count() == 900 and flagged.where("rolling_std IS NOT NULL").count() > 700
