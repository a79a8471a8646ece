"""Hard negatives by inner product, found with a vertical scan over columns of dimensions.

For every anchor the best rows of its own label are its positives; a positive's hard negatives are
the best rows of other labels whose score lies in a window below the positive's own.

Rows are stored in blocks, dimension by dimension. An anchor reads a block's dimensions in descending
order of its own magnitudes, some at a time. After each step a row's score is known up to what the
remaining dimensions can add: the sum over them of the least and the most that the anchor's component
times any value of the column can be. Rows that can no longer be among the best (or in any window) are
cleared in the bitmap of candidates, and only what is left is read on, until the scores are exact.

Anchors go to every block in chunks, as queries do to an index: each task holds one block and one
chunk, and returns a few rows per anchor.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import written

POSITIVES = 5
NEGATIVES = 5
# A negative has from LOW to HIGH percent of its positive's score.
LOW, HIGH = 80, 100
SCALE = 256
BLOCK_ROWS = 8192
CHUNK_ANCHORS = 1024
# Dimensions read between two looks at the bounds.
STEP = 16

_POSITIVES = "anchor bigint, row bigint, id bigint, score bigint"
_NEGATIVES = "anchor bigint, positive_score bigint, row bigint, id bigint, score bigint"


def largest_component(dimensions: int) -> int:
    """Components are held to this, so that 100 times a score of so many dimensions has 64 bits."""
    return 1 << (56 - max(dimensions - 1, 0).bit_length()) // 2


def matrix(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """Columns of dimensions of an array of vectors; a vector is zero beyond its end."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    columns = np.zeros((dimensions, len(lengths)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    columns[np.arange(len(values)) - np.repeat(starts, lengths), row] = values
    return columns


class Block:
    """Rows of a block: columns of dimensions with the least and the largest value of each."""

    def __init__(self, rows: pa.Table, dimensions: int):
        self.row = rows["row"].to_numpy()
        self.id = rows["id"].to_numpy()
        self.label = rows["label"].to_numpy()
        self.columns = matrix(rows["vector"], dimensions)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, needed):
        """(places, exact scores) of the candidates that `needed` leaves of the bitmap `alive`.

        `needed(least, most)` gets the bounds of the candidates' scores and says which may matter.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])
        # What dimensions from a place on can add at least and at most.
        least = np.append(np.cumsum(ends.min(axis=0)[order][::-1])[::-1], 0)
        most = np.append(np.cumsum(ends.max(axis=0)[order][::-1])[::-1], 0)
        places = np.flatnonzero(alive)
        scores = np.zeros(len(places), np.int64)
        for first in range(0, len(order), STEP):
            if not len(places):
                break
            for d in order[first : first + STEP]:
                if anchor[d]:
                    scores += anchor[d] * self.columns[d][places]
            after = min(first + STEP, len(order))
            stay = needed(scores + least[after], scores + most[after])
            if not stay.all():
                alive[places[~stay]] = False
                places, scores = places[stay], scores[stay]
        return places, scores

    def best(self, places, scores, count):
        """The first `count` by score, then id, then row."""
        order = np.lexsort((self.row[places], self.id[places], -scores))[:count]
        return zip(
            self.row[places[order]].tolist(), self.id[places[order]].tolist(), scores[order].tolist()
        )


def _kth(values: np.ndarray, k: int):
    """The k-th largest value, or None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _positives_of(block: Block, anchor: dict, vector: np.ndarray, count: int):
    def needed(least, most):
        bound = _kth(least, count)
        return np.ones(len(least), bool) if bound is None else most >= bound

    alive = (block.label == anchor["label"]) & (block.row != anchor["row"])
    places, scores = block.scan(vector, alive, needed)
    return [(anchor["row"], *found) for found in block.best(places, scores, count)]


def _negatives_of(block: Block, anchor: dict, vector: np.ndarray, count: int, low: int, high: int):
    windows = [
        (score, -(-low * score // 100), high * score // 100) for score in anchor["scores"]
    ]
    windows = [w for w in windows if w[1] <= w[2]]

    def needed(least, most):
        stay = np.zeros(len(least), bool)
        for _, bottom, top in windows:
            bound = _kth(least[(least >= bottom) & (most <= top)], count)
            floor = bottom if bound is None else max(bottom, bound)
            stay |= (most >= floor) & (least <= top)
        return stay

    alive = block.label != anchor["label"]
    places, scores = block.scan(vector, alive & bool(windows), needed)
    result = []
    for score, bottom, top in windows:
        inside = (scores >= bottom) & (scores <= top)
        for found in block.best(places[inside], scores[inside], count):
            result.append((anchor["row"], score, *found))
    return result


def _searched(dimensions: int, search, schema: str):
    """A function of one block and one chunk of anchors that searches it for each of them."""
    names = [field.split()[0] for field in schema.split(", ")]
    types = pa.schema([(name, pa.int64()) for name in names])

    def search_block(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and anchors.num_rows:
            block = Block(rows, dimensions)
            vectors = matrix(anchors["vector"], dimensions).T
            for anchor, vector in zip(anchors.drop_columns(["vector"]).to_pylist(), vectors):
                found += search(block, anchor, vector)
        columns = list(zip(*found)) or [[] for _ in names]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=types)

    return search_block


def _in_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, search, schema):
    """Every chunk of `anchors` searched in every block of `rows`."""

    def dealt(df, own, n, other, m):
        to_all = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return df.select("*", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(own), to_all)

    left = dealt(rows, "block", blocks, "chunk", chunks).groupBy("block", "chunk")
    right = dealt(anchors, "chunk", chunks, "block", blocks).groupBy("block", "chunk")
    return left.cogroup(right).applyInArrow(search, schema)


def _first(found: DataFrame, count: int, *keys: str) -> DataFrame:
    """The first `count` of each key over all blocks, with their place in `rank`, from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_rows: int = BLOCK_ROWS,
    chunk_anchors: int = CHUNK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    `vectors` has vec_id, label, embedding. Components become floor(SCALE * x), held to
    `largest_component`, and scores are their exact inner products; a shorter vector is zero beyond
    its end. Rows without an id or label, or with a missing vector or a missing or non-finite
    component, take no part. Ties go by id. Rows are told apart by themselves, not by id: a repeated
    row is a row of its own, and a repeated anchor has its results again. Empty tables give no rows,
    other columns are not looked at. Runs jobs at once.
    """
    usable = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    present = vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    ).select(
        "vec_id",
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = written(
        present.where(usable).select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("bigint").alias("id"),
            "label",
            "is_anchor",
            "embedding",
        ),
        "usable-vectors",
    )
    n, n_anchors, dimensions = rows.agg(
        F.count(F.lit(1)), F.count_if("is_anchor"), F.max(F.size("embedding"))
    ).first()
    dimensions = max(dimensions or 0, 1)
    largest = float(largest_component(dimensions))

    def component(x):
        return F.greatest(F.least(F.floor(x * SCALE), F.lit(largest)), F.lit(-largest)).cast("int")

    rows = rows.withColumn("vector", F.transform("embedding", component)).drop("embedding")
    blocks, chunks = (max(-(-a // b), 1) for a, b in ((n, block_rows), (n_anchors, chunk_anchors)))
    anchors = written(rows.where("is_anchor").drop("is_anchor", "id"), "anchors")
    searched = rows.drop("is_anchor")

    def positives_of(block, anchor, vector):
        return _positives_of(block, anchor, vector, positives)

    found = _in_blocks(
        searched, anchors, blocks, chunks, _searched(dimensions, positives_of, _POSITIVES), _POSITIVES
    )
    best = written(_first(found, positives, "anchor"), "positives")
    scores = best.groupBy("anchor").agg(F.collect_set("score").alias("scores"))
    asked = anchors.join(scores, F.col("row") == F.col("anchor")).drop("anchor")

    def negatives_of(block, anchor, vector):
        return _negatives_of(block, anchor, vector, negatives, low, high)

    found = _in_blocks(
        searched, asked, blocks, chunks, _searched(dimensions, negatives_of, _NEGATIVES), _NEGATIVES
    )
    worst = _first(found, negatives, "anchor", "positive_score")
    named = rows.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = best.select(
        "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return (
        worst.join(pairs, ["anchor", "positive_score"])
        .join(named, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
