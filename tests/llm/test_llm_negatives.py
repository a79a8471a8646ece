"""Hard negatives against every inner product in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weatherloom.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def plain_negatives(rows, is_anchor, positives=5, count=5):
    """Sorted results; `rows` are (id, label, vector)."""
    usable = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if all(x is not None and math.isfinite(x) for x in vector):
            usable.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    result = []
    for a, (anchor_id, label, anchor) in enumerate(usable):
        if not is_anchor(anchor_id):
            continue
        scores = [(-sum(x * y for x, y in zip(anchor, v)), i) for i, _, v in usable]
        same = sorted(s for r, s in enumerate(scores) if usable[r][1] == label and r != a)
        others = sorted(s for r, s in enumerate(scores) if usable[r][1] != label)
        for positive, positive_id in same[:positives]:
            fit = [s for s in others if 80 * -positive <= 100 * -s[0] <= 100 * -positive]
            for rank, (score, negative_id) in enumerate(fit[:count], 1):
                result.append((anchor_id, positive_id, rank, negative_id, -positive, -score))
    return sorted(result)


def random_rows(n, dimensions, seed, values=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(values)) if values else (lambda: rng.gauss(0.2, 0.4))
    return [(i, rng.randrange(3), [draw() for _ in range(dimensions)]) for i in range(n)]


@pytest.mark.parametrize("block_rows, chunk_anchors", [(40, 7), (8192, 1024)])
@pytest.mark.parametrize("values", [None, [0.0, 0.25, -0.25]])
def test_all_inner_products(spark, block_rows, chunk_anchors, values):
    rows = random_rows(300, 40, 5, values)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = negatives.hard_negatives(
        df, F.col("vec_id") % 10 == 0, block_rows=block_rows, chunk_anchors=chunk_anchors
    )
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_copies_of_one_vector(spark):
    rows = random_rows(60, 20, 6) + [(100 + i, i % 3, [0.5] * 20) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, block_rows=30)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, 1, [0.5, 0.5]),
        (0, 1, [0.5, 0.5]),
        (1, 1, [0.5, 0.25, 3.0]),
        (2, 2, [0.45]),
        (3, 2, []),
        (4, None, [0.5, 0.5]),
        (5, 2, None),
        (6, 2, [0.5, None]),
        (7, 2, [0.5, inf]),
        (8, 2, [nan, 0.5]),
        (9, 2, [0.5, 0.4]),
        (None, 2, [0.5, 0.5]),
        (10, 1, [-0.5, -0.5]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    odd = df.select("*", *[F.lit("x").alias(n) for n in ("row", "id", "vector", "block", "chunk", "score")])
    got = negatives.hard_negatives(odd, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert negatives.hard_negatives(df.where("false"), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_huge_components_are_held(spark):
    rows = [(0, 1, [3e38, 1.0]), (1, 1, [2e38, 1.0]), (2, 2, [1e38, 0.5]), (3, 2, [-1e38, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    (found,) = negatives.hard_negatives(df, F.col("vec_id") == 0).collect()
    limit = negatives.largest_component(2)
    assert found.negative_id == 2 and found.positive_score == limit * limit + 256 * 256
    assert all(100 * d * negatives.largest_component(d) ** 2 < 1 << 63 for d in range(1, 5000))


def test_bounds_clear_candidates_before_the_last_dimension():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-20, 20, (500, 64))
    vectors[:, :8] *= 20
    table = pa.table(
        {
            "row": np.arange(500),
            "id": np.arange(500),
            "label": np.zeros(500, np.int64),
            "vector": pa.array(vectors.tolist(), pa.list_(pa.int32())),
        }
    )
    block, seen = negatives.Block(table, 64), []

    def needed(least, most):
        exact = vectors[np.flatnonzero(alive)] @ vectors[0]
        assert (least <= exact).all() and (exact <= most).all()
        seen.append(len(least))
        return most >= np.partition(least, len(least) - 5)[len(least) - 5]

    alive = np.ones(500, bool)
    places, scores = block.scan(vectors[0], alive, needed)
    exact = vectors @ vectors[0]
    assert set(np.argsort(-exact)[:5]) <= set(places) and (scores == exact[places]).all()
    assert seen[0] == 500 and seen[1] < 100 and alive.sum() == len(places)
