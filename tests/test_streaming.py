import datetime as dt

import pandas as pd
import pytest
from conftest import same, series, to_pandas

from weatherloom.operators.profiles import daily_mean
from weatherloom.operators.rolling import rolling_anomalies
from weatherloom.schema import READINGS
from weatherloom.sources import payloads
from weatherloom.plans.sizing import paths_in
from weatherloom.streaming import compaction, daily, monitor
from weatherloom.streaming.rolling import RollingStream


@pytest.fixture
def arrivals():
    """Two cities' readings in order of time."""
    frame = pd.concat([series("A", 140, seed=1), series("B", 90, "2019-02-01", 2)])
    frame = frame.sort_values(["timestamp", "city"]).reset_index(drop=True)
    frame["seq"] = range(len(frame))
    return frame


class Landing:
    """A folder in which files of readings land, read as a stream of one file per micro-batch."""

    def __init__(self, spark, make, folder):
        self.spark, self.make, self.folder = spark, make, str(folder)

    def land(self, frame):
        self.make(frame).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        reader = self.spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1)
        return reader.parquet(self.folder)


@pytest.fixture
def landing(spark, make, tmp_path):
    return Landing(spark, make, tmp_path / "landing")


def run(start, *arguments):
    query = start(*arguments, availableNow=True)
    query.awaitTermination()
    return query


def same_rolled(got, want):
    got, want = to_pandas(got, "seq"), to_pandas(want, "seq")
    assert got["seq"].tolist() == want["seq"].tolist()
    same(got["rolling_mean"], want["rolling_mean"])
    same(got["rolling_std"], want["rolling_std"])
    assert got["is_anomaly"].tolist() == want["is_anomaly"].tolist()


@pytest.mark.parametrize("series_rows", [10**6, 40])
def test_rolling_stream_equals_batch(spark, make, tmp_path, landing, arrivals, series_rows):
    for start in range(0, len(arrivals), 50):
        landing.land(arrivals.iloc[start : start + 50])
    rolled = RollingStream(str(tmp_path / "rolled"), series_rows=series_rows)
    run(rolled.start, landing.stream())
    newest = arrivals["timestamp"].max()
    before = rolled.rolled(spark)
    assert before.count() == (arrivals["timestamp"] < newest).sum()
    rolled.finish(spark)
    same_rolled(rolled.rolled(spark), rolling_anomalies(make(arrivals)))
    assert rolled.late(spark).isEmpty()


def test_rolling_stream_orders_rows_that_are_late_within_the_delay(
    spark, make, tmp_path, landing, arrivals
):
    mixed = arrivals.copy()
    # Neighbouring batches exchange some rows.
    order = list(range(len(mixed)))
    for i in (45, 46, 99, 148):
        order[i], order[i + 6] = order[i + 6], order[i]
    mixed = mixed.iloc[order]
    for start in range(0, len(mixed), 50):
        landing.land(mixed.iloc[start : start + 50])
    rolled = RollingStream(str(tmp_path / "rolled"), delay=dt.timedelta(days=10))
    run(rolled.start, landing.stream())
    rolled.finish(spark)
    assert rolled.late(spark).isEmpty()
    same_rolled(rolled.rolled(spark), rolling_anomalies(make(arrivals)))


def test_rolling_stream_keeps_rows_that_are_too_late_apart(
    spark, make, tmp_path, landing, arrivals
):
    late = arrivals.iloc[[10, 11]]
    undated = pd.DataFrame(
        {"city": ["A"], "timestamp": [pd.NaT], "temperature": [1.0], "seq": [900]}
    )
    in_time = arrivals.drop(index=[10, 11])
    landing.land(in_time.iloc[:100])
    landing.land(pd.concat([late, undated, in_time.iloc[100:]]))
    rolled = RollingStream(str(tmp_path / "rolled"))
    run(rolled.start, landing.stream())
    rolled.finish(spark)
    same_rolled(rolled.rolled(spark), rolling_anomalies(make(in_time)))
    assert {r.seq for r in rolled.late(spark).collect()} == {10, 11, 900}


def test_rolling_stream_goes_on_after_a_restart(spark, make, tmp_path, landing, arrivals):
    folder = str(tmp_path / "rolled")
    landing.land(arrivals.iloc[:120])
    run(RollingStream(folder).start, landing.stream())
    landing.land(arrivals.iloc[120:])
    again = RollingStream(folder)
    run(again.start, landing.stream())
    again.finish(spark)
    same_rolled(again.rolled(spark), rolling_anomalies(make(arrivals)))


def test_a_repeated_micro_batch_changes_nothing(spark, make, tmp_path, arrivals):
    rolled = RollingStream(str(tmp_path / "rolled"))
    parts = [make(arrivals.iloc[:80]), make(arrivals.iloc[80:160]), make(arrivals.iloc[160:])]
    for batch_id in (0, 0, 1, 1, 2, 2):
        rolled._step(parts[batch_id], batch_id)
    rolled.finish(spark)
    rolled.finish(spark)
    same_rolled(rolled.rolled(spark), rolling_anomalies(make(arrivals)))


def test_monitor_stream_equals_batch(spark, make, tmp_path, landing, arrivals):
    for start in range(0, len(arrivals), 100):
        landing.land(arrivals.iloc[start : start + 100])
    history = make(arrivals)
    stream = monitor.as_current(landing.stream())
    monitored = monitor.monitor_stream(stream, history, "city", k=1)
    folder = str(tmp_path / "monitored")
    run(lambda **trigger: monitor.start_monitor(monitored, folder, **trigger))
    got = to_pandas(monitor.read_monitored(monitored, folder), "seq")
    band = arrivals.groupby("city")["temperature"].agg(["mean", "std"])
    values = arrivals["temperature"]
    mean, std = arrivals["city"].map(band["mean"]), arrivals["city"].map(band["std"])
    want = ["above" if v > m + s else "below" if v < m - s else "normal"
            for v, m, s in zip(values, mean, std)]
    assert got["status"].tolist() == want and set(want) == {"above", "below", "normal"}


def test_payload_files_are_monitored(spark, make, tmp_path, arrivals):
    landed = tmp_path / "payloads"
    landed.mkdir()
    (landed / "1.txt").write_text(
        '{"cod":200,"dt":1700000000,"name":"A","main":{"temp":999.0}}\n{"cod":401}\n<html>\n'
    )
    stream = payloads.good_readings(payloads.stream_payloads(spark, str(landed)))
    monitored = monitor.monitor_stream(stream, make(arrivals), "day_month")
    folder = str(tmp_path / "monitored")
    run(lambda **trigger: monitor.start_monitor(monitored, folder, **trigger))
    (landed / "2.txt").write_text('{"cod":200,"dt":1550000000,"name":"Mars","main":{"temp":1.0}}\n')
    run(lambda **trigger: monitor.start_monitor(monitored, folder, **trigger))
    rows = monitor.read_monitored(monitored, folder).collect()
    assert {r.city: r.status for r in rows} == {"A": "normal", "Mars": "normal"}


def test_daily_means_of_a_stream(spark, make, tmp_path, landing, arrivals):
    twice = pd.concat([arrivals, arrivals.assign(
        timestamp=arrivals["timestamp"] + pd.Timedelta(hours=23, minutes=59),
        temperature=arrivals["temperature"] + 3,
        seq=arrivals["seq"] + 1000,
    )]).sort_values("timestamp")
    for start in range(0, len(twice), 120):
        landing.land(twice.iloc[start : start + 120])
    folder = str(tmp_path / "daily")
    means = daily.daily_mean_stream(landing.stream())
    run(lambda **trigger: daily.start_daily_mean(means, folder, **trigger))
    got = to_pandas(daily.read_daily_mean(spark, folder), "city", "day")
    want = to_pandas(daily_mean(make(twice), "city"), "city", "day")
    assert got["day"].tolist() == want["day"].tolist()
    same(got["mean"], want["mean"])


def test_daily_means_of_files_out_of_order(spark, make, tmp_path, landing, arrivals):
    undated = pd.DataFrame(
        {"city": ["A", None], "timestamp": [pd.NaT, "2019-03-01"], "temperature": [1.0, 2.0], "seq": [900, 901]}
    )
    twice = pd.concat([arrivals, arrivals.assign(
        timestamp=arrivals["timestamp"] + pd.Timedelta(hours=5), temperature=arrivals["temperature"] + 3
    ), undated])
    twice.loc[twice["seq"] == 7, "temperature"] = float("nan")
    # The newest readings come first, and those of one day in different files.
    for part in (twice.iloc[150:], twice.iloc[:50], twice.iloc[50:150]):
        landing.land(part)
        folder = str(tmp_path / "daily")
        means = daily.daily_mean_stream(landing.stream())
        run(lambda **trigger: daily.start_daily_mean(means, folder, **trigger))
    got = to_pandas(daily.read_daily_mean(spark, folder), "city", "day")
    want = to_pandas(daily_mean(make(twice), "city"), "city", "day")
    assert got[["city", "day"]].values.tolist() == want[["city", "day"]].values.tolist()
    same(got["mean"], want["mean"])


def test_folders_are_carried_like_digits():
    folders, rewritten = [], 0
    for n in range(200):
        before = [name for _, name in folders]
        folders, merged = compaction.carried(folders, str(n))
        assert len(folders) == (n + 1).bit_count()
        assert [name for _, name in folders] == [x for x in before if x not in merged] + [str(n)]
        assert [level for level, _ in folders] == sorted({level for level, _ in folders}, reverse=True)
        rewritten += len(merged)
    assert rewritten < 200


def test_sums_of_many_micro_batches_are_merged(spark, make, tmp_path, arrivals):
    folder = str(tmp_path / "daily")
    step = 10
    for n, start in enumerate(range(0, len(arrivals), step)):
        part = daily.daily_mean_stream(make(arrivals.iloc[start : start + step]))
        daily.add_daily(part, n, folder)
        if n in (2, 5, 6):
            daily.add_daily(part, n, folder)
    store = compaction.CompactedFolder(spark, f"{folder}/daily")
    assert len(store.paths()) == (n + 1).bit_count() <= 5
    assert len(paths_in(spark, f"{folder}/daily/rows/*")) <= 2 * (n + 1).bit_length()
    assert len(paths_in(spark, f"{folder}/daily/manifest/*")) == 2
    got = to_pandas(daily.read_daily_mean(spark, folder), "city", "day")
    want = to_pandas(daily_mean(make(arrivals), "city"), "city", "day")
    assert got[["city", "day"]].values.tolist() == want[["city", "day"]].values.tolist()
    same(got["mean"], want["mean"])


def test_no_daily_means_before_the_first_micro_batch(spark, tmp_path):
    assert daily.read_daily_mean(spark, str(tmp_path / "none")).count() == 0


def test_a_new_version_of_norms_counts_from_the_next_micro_batch(
    spark, make, tmp_path, landing, arrivals
):
    store, folder = str(tmp_path / "norms"), str(tmp_path / "monitored")
    with pytest.raises(ValueError, match="no norms"):
        monitor.classify_newest(monitor.as_current(make(arrivals)), store)
    for n, part in enumerate((arrivals.iloc[:100], arrivals.iloc[100:])):
        history = arrivals.iloc[: 60 + 90 * n]
        assert monitor.publish_norms(make(history), store, k=1) == n + 1
        landing.land(part)
        stream = monitor.as_current(landing.stream())
        run(lambda **trigger: monitor.start_versioned_monitor(stream, store, folder, **trigger))
        band = history.groupby("city")["temperature"].agg(["mean", "std"])
        rows = [r for r in monitor.read_versioned(spark, folder).collect() if r.norm_version == n + 1]
        assert {r.seq for r in rows} == set(part["seq"])
        for r in rows:
            if r.city in band.index:
                assert r.upper == pytest.approx(band["mean"][r.city] + band["std"][r.city])
    # A version that is not wholly written does not count.
    (tmp_path / "norms" / "version=9").mkdir()
    assert monitor.newest_version(spark, store) == 2


def test_only_buckets_with_news_are_rewritten(spark, make, tmp_path):
    frame = pd.concat([series(f"C{i}", 40, seed=i) for i in range(12)])
    frame = frame.sort_values(["timestamp", "city"]).reset_index(drop=True)
    frame["seq"] = range(len(frame))
    early = frame[frame["timestamp"] < "2019-01-31"]
    rest = frame[frame["timestamp"] >= "2019-01-31"]
    rolled = RollingStream(str(tmp_path / "rolled"), buckets=8)
    rolled._step(make(early), 0)
    before = rolled._manifest(spark, 0)["buckets"]
    assert len(before) > 3 and {own["batch"] for own in before.values()} == {0}
    # The newest readings of all cities wait; the next micro-batch finishes them all.
    one_city = rest[rest["city"] == "C3"]
    rolled._step(make(one_city.iloc[:4]), 1)
    rolled._step(make(one_city.iloc[4:]), 2)
    after = rolled._manifest(spark, 2)["buckets"]
    assert after.keys() == before.keys()
    assert sorted(own["batch"] for own in after.values()) == [1] * (len(after) - 1) + [2]
    rolled.finish(spark)
    same_rolled(
        rolled.rolled(spark),
        rolling_anomalies(make(frame[(frame["timestamp"] < "2019-01-31") | (frame["city"] == "C3")])),
    )


def test_rows_of_quiet_cities_are_finished_by_the_news_of_others(spark, make, tmp_path, arrivals):
    rolled = RollingStream(str(tmp_path / "rolled"), delay=dt.timedelta(days=3), buckets=16)
    city_a, city_b = (arrivals[arrivals["city"] == c] for c in "AB")
    rolled._step(make(arrivals[arrivals["timestamp"] <= "2019-03-01"]), 0)
    later = city_a[city_a["timestamp"] > "2019-03-01"]
    rolled._step(make(later), 1)
    known = pd.concat([arrivals[arrivals["timestamp"] <= "2019-03-01"], later])
    done = known[known["timestamp"] < known["timestamp"].max() - pd.Timedelta(days=3)]
    assert {r.seq for r in rolled.rolled(spark).collect()} == set(done["seq"])
    assert set(done["city"]) == {"A", "B"} and len(city_b) > 0
