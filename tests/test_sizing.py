import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from conftest import same, series
from pyspark.sql import functions as F

from weatherloom.operators import blocks
from weatherloom.operators.rolling import rolling_stats
from weatherloom.plans import sizing


def session(setting, master):
    conf = SimpleNamespace(get=lambda name, default=None: setting)
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_scratch_is_below_the_shared_folder():
    root = sizing.scratch_root(session("hdfs://shared/checkpoints/", "yarn"))
    assert root == "hdfs://shared/checkpoints/weatherloom/app-1"


def test_every_scratch_path_is_new_and_can_be_discarded(spark):
    path = sizing.scratch_path(spark, "x")
    assert path.startswith(sizing.scratch_root(spark)) and path != sizing.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path)
    sizing.discard(spark, path)
    assert not os.path.exists(path)


@pytest.mark.parametrize("master", ["yarn", "local-cluster[3,2,2000]", "spark://host:7077"])
def test_a_cluster_without_shared_folder_is_refused(master):
    with pytest.raises(ValueError):
        sizing.scratch_root(session(None, master))
    assert sizing.scratch_root(session(None, "local[2]"))


def test_only_long_series_are_found(make, history):
    nameless = series(None, 1000).assign(seq=range(10_000, 11_000))
    rows = make(pd.concat([history, nameless], ignore_index=True))
    keys, total = sizing.long_series(rows, ["city"], 300)
    assert sorted(r.city for r in keys.collect()) == ["Gaps", "Long"]
    assert total == history["city"].isin(["Gaps", "Long"]).sum()
    assert sizing.long_series(rows, ["city"], 900) == (None, 0)


@pytest.mark.parametrize("partition_rows", [10_000, 100, 7])
def test_positions_are_exact(make, history, partition_rows):
    rows = make(history).repartition(6)
    numbered = blocks.number_rows(
        rows, ["city"], ["timestamp", "seq"], len(history), partition_rows
    ).toPandas()
    numbered = numbered.sort_values(["city", "timestamp", "seq"])
    assert len(numbered) == len(history)
    assert (numbered["_position"] == numbered.groupby("city").cumcount()).all()


def test_blocks_are_full_and_led_by_the_rows_before(make, history):
    frame = history[history["city"] == "Long"]
    split = blocks.split_series(make(frame), ["city"], ["timestamp", "seq"], 900, 400, 29)
    own = split.where(F.col("_block") == F.col("_own_block")).groupBy("_block").count()
    assert sorted(r["count"] for r in own.collect()) == [100] * 9
    lead = split.where(F.col("_block") > F.col("_own_block")).groupBy("_block").count()
    assert {r["_block"]: r["count"] for r in lead.collect()} == {b: 29 for b in range(1, 10)}
    assert split.where(F.col("_block") < F.col("_own_block")).isEmpty()


@pytest.mark.parametrize("series_rows, lead", [(400, 29), (160, 29), (120, 40)])
def test_blocks_between_time_bounds(spark, make, history, series_rows, lead):
    rows = make(history)
    keys, _ = sizing.long_series(rows, ["city"], series_rows)
    cut, crowded = blocks.time_blocks(rows, ["city"], keys, series_rows, lead)
    assert crowded is None
    frame = cut.toPandas().sort_values(["city", "timestamp", "seq"])
    own = frame[frame["_block"] == frame["_own_block"]]
    wanted = history[history["city"].isin(set(own["city"]))].sort_values(["city", "timestamp", "seq"])
    assert own["seq"].tolist() == wanted["seq"].tolist()
    for _, rows_of_city in own.groupby("city"):
        # Blocks follow each other without gaps, and each but the first has enough rows before it.
        numbers = rows_of_city["_block"].tolist()
        assert numbers == sorted(numbers) and set(numbers) == set(range(numbers[0], numbers[-1] + 1))
        sizes = rows_of_city["_block"].value_counts()
        assert sizes.max() < series_rows
        for block in sorted(set(numbers))[1:]:
            before = rows_of_city[rows_of_city["_block"] < block].tail(lead)
            lent = frame[(frame["city"] == before["city"].iloc[0]) & (frame["_block"] == block)]
            lent = lent[lent["_own_block"] < block]
            assert lent["seq"].tolist()[-lead:] == before["seq"].tolist()
            assert len(lent) <= lead + 5


def test_series_with_one_crowded_instant_are_numbered(spark, make):
    crowd = series("Crowd", 900, seed=3)
    crowd.loc[100:800, "timestamp"] = pd.Timestamp("2019-04-11")
    undated = series("Undated", 500, seed=4)
    undated.loc[:400, "timestamp"] = pd.NaT
    frame = pd.concat([crowd, undated, series("Even", 700, seed=5)], ignore_index=True)
    frame["seq"] = np.random.default_rng(6).permutation(len(frame))
    rows = make(frame)
    got = rolling_stats(rows, series_rows=300).toPandas().sort_values("seq")
    want = rolling_stats(rows).toPandas().sort_values("seq")
    assert got["seq"].tolist() == want["seq"].tolist()
    same(got["rolling_mean"], want["rolling_mean"])
    same(got["rolling_std"], want["rolling_std"])
