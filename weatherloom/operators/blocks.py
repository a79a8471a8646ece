"""Cutting very long series into blocks, so that no task holds a whole one."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import written
from ..schema import TIMESTAMP

BLOCK = "_block"
OWN_BLOCK = "_own_block"
POSITION = "_position"
_DAY = "_day"
# Stands before any day.
_NO_DAY = -(1 << 31)
# Rows of a range partition of the sorted table: some 200 MB, whatever the length of a block.
PARTITION_ROWS = 4_000_000


def number_rows(
    df: DataFrame, keys, order, rows: int, partition_rows: int, folder: str | None = None
) -> DataFrame:
    """Add `_position`, the exact 0-based place of each row in its series, without one task per series.

    The `rows` rows are sorted over the whole table by range partitions of about `partition_rows`
    each. A unique last order column keeps the partitions balanced even when a key, or a single
    instant of a key, holds most rows. The sorted table is written once, so partition and row ids
    stay fixed.
    """
    partitions = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / partition_rows))
    sorted_rows = written(
        df.repartitionByRange(partitions, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "sorted-series",
        folder,
    )
    # Each partition border cuts one series at most, so there are at most partitions + series
    # segments: small beside the rows.
    segments = sorted_rows.groupBy(*keys, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select(
        *keys,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    return (
        sorted_rows.join(starts, [*keys, "_part"])
        .withColumn(POSITION, F.col("_start") + F.col("_row") - F.col("_first"))
        .drop("_part", "_row", "_first", "_start")
    )


def split_series(
    df: DataFrame, keys, order, rows: int, series_rows: int, lead: int, folder: str | None = None
) -> DataFrame:
    """Long series in blocks of a quarter of `series_rows`, led by the last `lead` rows before them.

    Rows carry `_block` (where they are used) and `_own_block` (where they belong). Positions are
    exact, so every block but a series' last is full and the block before always has the lead.
    """
    size = max(series_rows // 4, lead, 1)
    position = F.col(POSITION)
    own = F.col(OWN_BLOCK)
    used_in = F.when(position % size >= size - lead, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        number_rows(df, keys, order, rows, PARTITION_ROWS, folder)
        .withColumn(OWN_BLOCK, F.floor(position / size))
        .withColumn(BLOCK, F.explode(used_in))
        .drop(POSITION)
    )


def time_blocks(
    df: DataFrame, keys, long_keys: DataFrame, series_rows: int, lead: int, folder: str | None = None
):
    """Long series cut between days into blocks, and the keys of series that cannot be cut so.

    The rows of each day are counted; running sums of the counts join days to blocks of about a quarter
    of `series_rows`. The counts also say which last days of a block hold its last `lead` rows: the
    rows of these days are used in the next block too, in front of its own. So rows are read once
    and neither sorted nor numbered nor written before the windows need them. Blocks with fewer rows
    than `lead` are part of the one before them.

    Rows carry `_block` and `_own_block`, as those of `split_series`, with `lead` rows or some more
    of the block before. A series that has more than `series_rows` rows on one day is left out; its
    key is in the second result, None if there is none.
    """
    size = max(series_rows // 4, lead, 1)
    # Rows without an instant come first, as they do in the order of the series.
    day = F.coalesce(F.unix_date(F.to_date(TIMESTAMP)), F.lit(_NO_DAY))
    long = df.join(long_keys, keys).withColumn(_DAY, day)
    counts = written(
        long.groupBy(*keys, _DAY).agg(F.count(F.lit(1)).alias("_rows")), "series-days", folder
    )
    crowded = counts.where(F.col("_rows") > series_rows).select(*keys).distinct()
    crowded = None if crowded.isEmpty() else written(crowded, "crowded-series", folder)
    if crowded is not None:
        counts = counts.join(crowded, keys, "left_anti")
    series = Window.partitionBy(*keys).orderBy(_DAY)
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = Window.partitionBy(*keys, "_piece")
    counts = counts.withColumn(
        "_piece", F.floor(F.coalesce(F.sum("_rows").over(before), F.lit(0)) / size)
    )
    # The first day of a piece that is large enough opens a block.
    opens = (F.sum("_rows").over(piece) >= lead) & (
        F.row_number().over(piece.orderBy(_DAY)) == 1
    )
    counts = counts.withColumn("_opens", opens.cast("bigint"))
    counts = counts.withColumn(OWN_BLOCK, F.sum("_opens").over(upto))
    block = Window.partitionBy(*keys, OWN_BLOCK).orderBy(F.desc(_DAY))
    later = F.sum("_rows").over(block.rowsBetween(Window.unboundedPreceding, -1))
    lends = F.coalesce(later, F.lit(0)) < lead
    days = written(
        counts.select(*keys, _DAY, OWN_BLOCK, lends.alias("_lends")), "series-blocks", folder
    )
    own = F.col(OWN_BLOCK)
    used_in = F.when(F.col("_lends"), F.array(own, own + 1)).otherwise(F.array(own))
    rows = long.join(days, [*keys, _DAY]).withColumn(BLOCK, F.explode(used_in))
    return rows.drop(_DAY, "_lends"), crowded
