"""Merkle manifest of a table: a digest per row, a subroot per group, one root, and proofs.

A row's leaf is the SHA-256 of its columns, each with its length before it. The leaves of a group, in
order, are the lowest nodes of a tree; every `fan_out` consecutive nodes have one parent, the digest
of their digests, until one is left: the subroot. The subroots are the leaves of one more such tree.

Each level is computed with window functions. Nodes lie on the row of their first leaf, so at level l
the neighbour by j nodes is exactly j * fan_out ** l rows away: lags and leads with these fixed
offsets, masked by the node's slot among its parent's children and by the length of that run, are its
siblings, and rows of first children hash the parents. A window holds a block of some thousand rows
that no run crosses, so a group that has most rows is spread over its blocks; all levels inside a block
share one shuffle and one sort. The digests on top of the blocks are the rows of the next round.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 2
# A window holds a block of at most this many rows.
BLOCK_ROWS = 1024

_STEP = "struct<left: string, right: string>"


def digest(values) -> Column:
    """SHA-256, as hexadecimal text, of values: each `-` if missing, else UTF-8 bytes, `:`, text."""

    def field(value):
        text = value.cast("string")
        length = F.octet_length(text).cast("string")
        return F.coalesce(F.concat(length, F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(value) for value in values]), 256)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with `at`, the exact place of each from 0. `order` must leave no ties.

    Range partitions are sorted and written, which fixes the place inside a partition; the sizes of
    the partitions, of which there are few, give where each one starts.
    """
    placed = written(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("inside", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "placed",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    )
    return (
        placed.join(written(starts, "part-starts"), "part")
        .withColumn("at", F.col("start") + F.col("inside"))
        .drop("part", "inside", "start")
    )


def _levels_for(nodes: int, fan_out: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fan_out), levels + 1
    return levels


def _climbed(nodes: DataFrame, fan_out: int, levels: int) -> DataFrame:
    """`levels` levels above nodes (g, pos, n, digest) of trees g with n nodes each.

    Adds block, steps (what stands left and right of the own node, level by level) and, on the first
    row of each block, the digest `above` that the block ends in. A tree that has one node left goes
    on unchanged and takes no more steps.
    """
    size = fan_out**levels
    df = nodes.withColumn("block", F.expr(f"pos div {size}")).withColumn("above", F.col("digest"))
    ordered = Window.partitionBy("g", "block").orderBy("pos")
    for level in range(levels):
        span = fan_out**level
        node, count = F.expr(f"pos div {span}"), F.expr(f"(n + {span - 1}) div {span}")
        slot = node % fan_out
        run = F.least(F.lit(fan_out).cast("bigint"), count - (node - slot))
        left = [
            F.when(slot >= j, F.lag("above", j * span).over(ordered))
            for j in range(fan_out - 1, 0, -1)
        ]
        right = [
            F.when(slot + j < run, F.lead("above", j * span).over(ordered))
            for j in range(1, fan_out)
        ]
        has_parent = count > 1
        step = F.struct(F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))
        df = df.withColumn(
            f"step{level}", F.when((F.col("pos") % span == 0) & has_parent, step)
        )
        children = F.concat(F.col("above"), F.col(f"step{level}.right"))
        parent = F.when(has_parent, F.sha2(children, 256)).otherwise(F.col("above"))
        df = df.withColumn("above", F.when(F.col("pos") % (span * fan_out) == 0, parent))
    # The rows below a node get its siblings from the node's row, which comes before them.
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [F.last(f"step{level}", ignorenulls=True).over(so_far) for level in range(levels)]
    df = df.withColumn("steps", F.filter(F.array(*steps), lambda s: s.isNotNull()))
    return df.drop(*[f"step{level}" for level in range(levels)])


def trees(nodes: DataFrame, fan_out: int = FAN_OUT, block_rows: int = BLOCK_ROWS):
    """Trees over nodes (g, pos, n, digest, other columns): (nodes with `steps`, tops (g, top)).

    `pos` runs from 0 to n - 1 in each tree g. Every round writes its rows and hands a row per block
    to the next one, so there are about log n / log block_rows rounds. Returns at once if empty.
    """
    in_block = max(_levels_for(block_rows + 1, fan_out) - 1, 1)
    rounds = []
    while True:
        most = nodes.agg(F.max("n")).first()[0]
        if most is None or most <= 1:
            break
        levels = min(in_block, _levels_for(most, fan_out))
        size = fan_out**levels
        climbed = written(_climbed(nodes, fan_out, levels), "tree-levels")
        rounds.append((climbed, size))
        nodes = climbed.where(F.col("pos") % size == 0).select(
            "g",
            F.col("block").alias("pos"),
            F.expr(f"(n + {size - 1}) div {size}").alias("n"),
            F.col("above").alias("digest"),
        )
    tops = nodes.select("g", F.col("digest").alias("top"))
    if not rounds:
        return nodes.withColumn("steps", F.array().cast(f"array<{_STEP}>")), tops
    upper, _ = rounds[-1]
    for lower, _ in reversed(rounds[:-1]):
        above = upper.select("g", F.col("pos").alias("block"), F.col("steps").alias("more"))
        upper = lower.join(above, ["g", "block"]).withColumn("steps", F.concat("steps", "more"))
        upper = upper.drop("more")
    return upper.drop("block", "above"), tops


def folded(leaf, steps) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(
        steps, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256)
    )


def proof(steps) -> Column:
    """The siblings on a leaf's way, joined, from the lowest level up and from left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(
    documents: DataFrame,
    columns=COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    changed: dict[str, Column] | None = None,
    is_changed: Column | None = None,
    fan_out: int = FAN_OUT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row: `order`, leaf, claimed_leaf, subroot, root, steps (array of left and right siblings).

    `claimed_leaf` is the leaf of the row with the values in `changed` where `is_changed` is true, else
    the leaf: what `verified` holds against the manifest. Groups ascend with a missing one first, and
    rows of a group by `order` with missing ones first, then by leaf; equal rows share a leaf and have
    places of their own. Texts of any length and missing values count as they are, an empty table
    gives no rows, other columns are not looked at. Runs jobs at once; texts are read once and never
    moved.
    """
    claimed = F.lit(None).cast("string")
    if changed:
        values = [changed.get(name, F.col(name)) for name in columns]
        claimed = F.when(F.coalesce(is_changed, F.lit(False)), digest(values))
    leaves = written(
        documents.select(
            F.col(order).alias("key"),
            F.col(group).alias("tree"),
            digest([F.col(name) for name in columns]).alias("digest"),
            claimed.alias("claimed"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    by_tree = F.col("tree").asc_nulls_first()
    placed = numbered(leaves, by_tree, F.col("key").asc_nulls_first(), F.col("digest"), F.col("row"))
    sizes = placed.groupBy("tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = written(numbered(sizes, F.col("first")).withColumnRenamed("at", "g"), "tree-sizes")
    nodes = (
        placed.alias("p")
        .join(sizes.alias("s"), F.col("p.tree").eqNullSafe(F.col("s.tree")))
        .select("key", "claimed", "digest", "g", (F.col("at") - F.col("first")).alias("pos"), "n")
    )
    rows, subroots = trees(nodes, fan_out, block_rows)
    subroots = written(subroots, "subroots")
    top_nodes = subroots.select(
        F.lit(0).cast("bigint").alias("g"),
        F.col("g").alias("pos"),
        F.lit(subroots.count()).cast("bigint").alias("n"),
        F.col("top").alias("digest"),
    )
    top_rows, roots = trees(top_nodes, fan_out, block_rows)
    root = roots.first()
    tops = top_rows.select(
        F.col("pos").alias("g"), F.col("digest").alias("subroot"), F.col("steps").alias("more")
    )
    return rows.join(tops, "g").select(
        F.col("key").alias(order),
        F.col("digest").alias("leaf"),
        F.coalesce("claimed", "digest").alias("claimed_leaf"),
        "subroot",
        F.lit(root["top"] if root else None).cast("string").alias("root"),
        F.concat("steps", "more").alias("steps"),
    )


def verified(rows: DataFrame, leaf: str = "claimed_leaf") -> DataFrame:
    """Manifest rows with folded_root, to which `leaf` and the siblings lead, and whether it is root."""
    with_root = rows.withColumn("folded_root", folded(F.col(leaf), F.col("steps")))
    return with_root.withColumn("verified", F.col("folded_root") == F.col("root"))
