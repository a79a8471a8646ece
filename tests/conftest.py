import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weatherloom.functions.calendar import season_name  # noqa: E402
from weatherloom.schema import READINGS  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Readings from a pandas frame with city, timestamp, temperature and maybe season, seq."""

    def build(frame: pd.DataFrame):
        frame = frame.copy()
        if "seq" not in frame:
            frame["seq"] = np.arange(len(frame))
        derived = "season" not in frame
        if derived:
            frame["season"] = None
        rows = [
            (
                None if pd.isna(city) else city,
                None if pd.isna(ts) else pd.Timestamp(ts).to_pydatetime(),
                None if pd.isna(t) else float(t),
                season,
                int(seq),
            )
            for city, ts, t, season, seq in frame[
                ["city", "timestamp", "temperature", "season", "seq"]
            ].itertuples(index=False)
        ]
        readings = spark.createDataFrame(rows, READINGS)
        return readings.withColumn("season", season_name("timestamp")) if derived else readings

    return build


def series(city, n, start="2019-01-01", seed=0, freq="D"):
    """A generated city with n readings."""
    noise = np.random.default_rng(seed).normal(10, 6, n).round(2)
    return pd.DataFrame(
        {
            "city": city,
            "timestamp": pd.date_range(start, periods=n, freq=freq),
            "temperature": noise,
        }
    )


@pytest.fixture(scope="session")
def history():
    """Cities of many lengths, with gaps in values and days, and several readings on a day."""
    long = series("Long", 900, "2017-02-03", 1)
    long.loc[[100, 101, 350], "temperature"] = np.nan
    parts = [
        long,
        series("Gaps", 500, "2017-02-03", 2).drop(index=range(200, 260)),
        series("Hourly", 200, "2020-02-20 05:30", 3, "7h"),
        series("L29", 29, seed=4),
        series("L30", 30, seed=5),
        series("L31", 31, seed=6),
        series("One", 1, seed=7),
    ]
    frame = pd.concat(parts, ignore_index=True)
    frame["seq"] = np.arange(len(frame))
    return frame


def to_pandas(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def same(left, right, tolerance=1e-9):
    """Equal values with missing ones in the same places."""
    left, right = pd.Series(left).reset_index(drop=True), pd.Series(right).reset_index(drop=True)
    assert len(left) == len(right)
    left, right = left.astype(float), right.astype(float)
    assert (left.isna() == right.isna()).all()
    assert np.allclose(left.dropna(), right.dropna(), atol=tolerance, rtol=0)
