"""Merkle manifests against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from weatherloom.llm import manifest, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha("".join(parts))


def plain_tree(leaves, fan_out):
    """(root, siblings of each leaf from the lowest level up, as (left, right))."""
    steps, nodes, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for leaf, node in enumerate(own):
            first = node - node % fan_out
            run = nodes[first : first + fan_out]
            steps[leaf].append(("".join(run[: node - first]), "".join(run[node - first + 1 :])))
        nodes = [sha("".join(nodes[i : i + fan_out])) for i in range(0, len(nodes), fan_out)]
        own = [node // fan_out for node in own]
    return nodes[0], steps


def plain_manifest(rows, fan_out=2):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    subtrees = {}
    for lang in order:
        own = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        subtrees[lang] = own, *plain_tree([plain_leaf(r) for r in own], fan_out)
    root, top_steps = plain_tree([subtrees[lang][1] for lang in order], fan_out)
    result = []
    for lang, more in zip(order, top_steps):
        own, subroot, steps = subtrees[lang]
        for row, path in zip(own, steps):
            path = path + more
            changed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                changed[3] += 1
            folded = plain_leaf(changed)
            for left, right in path:
                folded = sha(left + folded + right)
            proof = sha("".join(left + right for left, right in path))
            result.append((row[0], plain_leaf(row), subroot, root, proof, folded, folded == root))
    return sorted(result, key=str)


def rows_of(sizes):
    rows = []
    for lang, n in sizes.items():
        rows += [
            (len(rows) * 3 + i, f"s{i % 4}", lang, None if i % 11 == 5 else i, f"text é {i}" * (i % 3))
            for i in range(n)
        ]
    return rows


SIZES = [
    {"en": 1},
    {"en": 2, "de": 1},
    {None: 3, "de": 33, "en": 65, "fr": 64, "": 7, "é": 1},
    {f"l{i}": 1 + i % 3 for i in range(41)},
]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("block_rows", [4, 1024])
def test_manifest_is_that_of_plain_python(spark, sizes, block_rows):
    rows = rows_of(sizes)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = queries.manifest_rows(df, block_rows=block_rows).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert any(r.verified for r in got)


@pytest.mark.parametrize("fan_out", [3, 5])
def test_other_fan_outs(spark, fan_out):
    rows = rows_of({"en": 77, "de": 26, "fr": 5, "es": 4, "it": 1, "pt": 9})
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = queries.manifest_rows(df, fan_out=fan_out, block_rows=30).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows, fan_out)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None),
        (None, "a", "en", 2, "x"),
        (None, "a", "en", 1, "x"),
        (7, "a", "en", 1, ""),
        (7, "a", "en", 1, ""),
        (7, "b", "en", 1, "long é " * 50_000),
        (-3, "", "en", -1, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clashing = ("g", "pos", "n", "digest", "at", "row", "key", "tree", "leaf", "steps", "block")
    odd = df.select("*", *[F.lit("clash").alias(name) for name in clashing])
    got = queries.manifest_rows(odd, block_rows=2).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    empty = queries.manifest_rows(df.where("false"))
    assert empty.count() == 0 and len(empty.columns) == 7


def test_a_proof_holds_no_other_row(spark):
    rows = rows_of({"en": 40, "de": 9})
    own = manifest.manifest(spark.createDataFrame(rows, SCHEMA))
    wrong = own.withColumn("claimed_leaf", F.sha2(F.col("leaf"), 256))
    assert manifest.verified(own).where("NOT verified").count() == 0
    assert manifest.verified(wrong).where("verified").count() == 0


def test_one_shuffle_and_sort_serve_all_levels_of_a_block(spark):
    nodes = spark.range(5000).selectExpr(
        "id % 3 AS g", "id AS pos", "5000L AS n", "sha2(CAST(id AS STRING), 256) AS digest"
    )
    plan = manifest._climbed(nodes, 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(g") == 1 and plan.count("Sort [g") == 1
    assert "Python" not in plan and "Arrow" not in plan
