"""Connected components of links, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import discard, scratch_path


def _stars(links: DataFrame) -> DataFrame:
    """One round on links (u, v) with u > v: every node to the least of its neighbours, both ways."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m")
    return (
        small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of its component for every node of links (a, b) but the roots.

    Rounds go on until nothing changes, about the logarithm of the longest path. Each writes its
    links to scratch and drops those before, so a lost executor costs one round at most. Only counts
    reach the driver. A node that most others link to is split by Spark's adaptive skew join, and
    its least neighbour is found by partial aggregates.
    """
    spark = links.sparkSession
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    place, state = None, None
    while True:
        last_place, last_state = place, state
        place = scratch_path(spark, "links")
        (now.distinct() if last_place is None else _stars(now)).write.parquet(place)
        if last_place is not None:
            discard(spark, last_place)
        now = spark.read.schema("u bigint, v bigint").parquet(place)
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state[0] == 0 or state == last_state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
