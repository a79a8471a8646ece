import numpy as np
import pandas as pd
import pytest
from conftest import same, series, to_pandas
from pyspark.sql import functions as F

from weatherloom.operators.norms import city_norm
from weatherloom.operators.profiles import anomaly_counts, anomaly_extremes
from weatherloom.operators.rolling import anomalies_only, rolling_anomalies, rolling_stats


def windows(values, rows, measure):
    """The measure of the last `rows` values at each place, missing where one of them is."""
    out = np.full(len(values), np.nan)
    if len(values) >= rows:
        out[rows - 1 :] = measure(np.lib.stride_tricks.sliding_window_view(values, rows))
    return out


def expected(frame, mean_rows, std_rows, keys=("city",), k=2):
    frame = frame.sort_values(["timestamp", "seq"]).reset_index(drop=True)
    mean, std = np.full(len(frame), np.nan), np.full(len(frame), np.nan)
    for places in frame.groupby(list(keys)).indices.values():
        values = frame["temperature"].to_numpy(float)[places]
        mean[places] = windows(values, mean_rows, lambda w: w.mean(axis=1))
        if std_rows > 1:
            std[places] = windows(values, std_rows, lambda w: w.std(axis=1, ddof=1))
    distance = np.abs(frame["temperature"].to_numpy(float) - mean)
    flags = np.greater(distance, k * std)
    frame = frame.assign(rolling_mean=mean, rolling_std=std, is_anomaly=flags)
    return frame.sort_values("seq").reset_index(drop=True)


def check(df, frame, mean_rows, std_rows, keys=("city",)):
    got = to_pandas(df, "seq")
    want = expected(frame, mean_rows, std_rows, keys)
    assert got["seq"].tolist() == want["seq"].tolist()
    same(got["rolling_mean"], want["rolling_mean"])
    same(got["rolling_std"], want["rolling_std"])
    assert got["is_anomaly"].tolist() == want["is_anomaly"].tolist()
    assert want["is_anomaly"].any()


@pytest.mark.parametrize("mean_rows, std_rows", [(30, 7), (30, 30), (11, 23)])
@pytest.mark.parametrize("series_rows", [10**6, 300, 40])
def test_rolling_equals_pandas_whole_and_in_blocks(make, history, mean_rows, std_rows, series_rows):
    flagged = rolling_anomalies(make(history), mean_rows, std_rows, series_rows=series_rows)
    check(flagged, history, mean_rows, std_rows)


@pytest.mark.parametrize("series_rows", [10**6, 50])
def test_rolling_within_a_season_runs_across_years(make, history, series_rows):
    frame = history.copy()
    frame["season"] = (frame["timestamp"].dt.month % 12 // 3).map(
        dict(enumerate(["winter", "spring", "summer", "autumn"]))
    )
    keys = ("city", "season")
    flagged = rolling_anomalies(make(frame), 30, 7, keys=keys, series_rows=series_rows)
    check(flagged, frame, 30, 7, keys)


def test_frames_stay_missing_until_they_are_full(make, history):
    rolled = to_pandas(rolling_stats(make(history)), "seq")
    filled = rolled.dropna(subset=["rolling_mean"]).groupby("city").size()
    assert "L29" not in filled and filled["L30"] == 1 and filled["L31"] == 2


def test_rows_out_of_order_and_partitions_do_not_matter(make, history):
    shuffled = history.sample(frac=1, random_state=3)
    for parts in (1, 5):
        check(rolling_anomalies(make(shuffled).repartition(parts)), history, 30, 7)


@pytest.mark.parametrize("series_rows", [10**6, 100])
def test_one_city_and_one_instant_with_most_rows(make, series_rows):
    """A city with most rows, most of which are at one instant, told apart by seq only."""
    hot = series("Hot", 1200, seed=9)
    hot.loc[100:1000, "timestamp"] = pd.Timestamp("2019-06-01")
    hot = hot.sort_values("timestamp", kind="stable")
    frame = pd.concat([hot, series("Cold", 150, seed=10)], ignore_index=True)
    frame["seq"] = np.arange(len(frame))
    check(rolling_anomalies(make(frame), series_rows=series_rows), frame, 30, 7)


@pytest.mark.parametrize("series_rows", [10**6, 100])
def test_rows_without_city_stay_without_statistics(make, history, series_rows):
    nameless = series(None, 400, seed=11)
    frame = pd.concat([history, nameless], ignore_index=True)
    frame["seq"] = np.arange(len(frame))
    rolled = to_pandas(rolling_anomalies(make(frame), series_rows=series_rows), "seq")
    assert len(rolled) == len(frame)
    without = rolled[rolled["city"].isna()]
    assert len(without) == 400
    assert without["rolling_mean"].isna().all() and not without["is_anomaly"].any()
    one_row = rolling_stats(make(frame), 1, 7, series_rows=series_rows).where("city IS NULL")
    assert one_row.where("rolling_mean IS NOT NULL").isEmpty()


@pytest.mark.parametrize("value", [5.0, 0.1, -7.3])
def test_band_is_strict_and_exact_on_constant_values(make, value):
    frame = series("Flat", 60)
    frame["temperature"] = value
    flat = rolling_anomalies(make(frame))
    assert anomalies_only(flat).isEmpty()
    assert flat.where("rolling_std = 0").count() == 54


@pytest.mark.parametrize("rows", [1, 2, 8, 31, 60, 61, 90, 127])
def test_windows_of_any_size(make, history, rows):
    got = to_pandas(rolling_stats(make(history), rows, rows), "seq")
    want = expected(history, rows, rows)
    same(got["rolling_mean"], want["rolling_mean"])
    same(got["rolling_std"], want["rolling_std"])


@pytest.mark.parametrize("mean_rows", [30, 70])
def test_nan_is_a_missing_value(make, history, mean_rows):
    frame = make(history)
    nan = frame.withColumn("temperature", F.coalesce("temperature", F.lit(float("nan"))))
    want = to_pandas(rolling_anomalies(frame, mean_rows), "seq")
    got = to_pandas(rolling_anomalies(nan, mean_rows), "seq")
    same(got["rolling_mean"], want["rolling_mean"])
    same(got["rolling_std"], want["rolling_std"])
    assert got["is_anomaly"].tolist() == want["is_anomaly"].tolist()
    bands = [{tuple(r) for r in city_norm(df).collect()} for df in (frame, nan)]
    assert bands[0] == bands[1]


def test_only_one_of_both_statistics(make, history):
    assert "rolling_std" not in rolling_stats(make(history), 30, None).columns
    assert "rolling_mean" not in rolling_stats(make(history), None, 7).columns


def test_counts_and_extremes_of_anomalies(make, history):
    flagged = rolling_anomalies(make(history))
    want = expected(history, 30, 7).groupby("city")["is_anomaly"].sum()
    got = to_pandas(anomaly_counts(flagged), "city")
    assert got["city"].tolist() == sorted(want.index)
    assert got["anomalies"].tolist() == want.sort_index().tolist()
    extremes = {r.extreme: (r.city, r.anomalies) for r in anomaly_extremes(flagged).collect()}
    assert extremes["most"] == (want.idxmax(), want.max())
    assert extremes["fewest"] == (want.idxmin(), want.min())


def test_extremes_of_nothing(make, history):
    nothing = rolling_anomalies(make(history.iloc[:0]))
    assert anomaly_extremes(nothing).count() == 0
