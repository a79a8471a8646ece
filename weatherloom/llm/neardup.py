"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

A fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 hashes (seed 42) of
the text's 3-word shingles. Two fingerprints are linked if at most 3 bits differ.

Covering hashing: each bit has a code, one of the 15 nonzero vectors of 4 bits. Mask v, for each of
the 15 nonzero v, keeps the bits whose code has an odd number of ones in common with v. Any 3 codes
leave some v that is orthogonal to all of them, so for any 3 differing bits some mask keeps none of
them: every pair within the radius shares its masked value in at least one of the 15 tables. This is
a guarantee, not a probability.

A masked value that many different fingerprints share is not compared in full. As its members agree
on all masked bits, the same construction on the remaining bits splits it into 15 smaller tables,
which again miss no pair; two such rounds leave at most 8 free bits, and so at most 256 members. Small groups are compared with numpy and give a star per cluster, not all pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import free_name
from ..plans.sizing import written
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
# A masked value with more members is split by further masks.
MOST_MEMBERS = 256
# Masks that leave this many bits free cannot have larger groups than 2 ** FREE_BITS: they are final.
FREE_BITS = 8
# Shingles are hashed and counted in blocks.
_HASH_BLOCK = 1 << 15

_A_TO_Z = bytes(range(ord("A"), ord("Z") + 1))
_TO_LOWER = bytes.maketrans(_A_TO_Z, _A_TO_Z.lower())


def shingle_hashes(text: str, shingle: int = SHINGLE):
    """XXH64 of every run of `shingle` words of the lowered text, in blocks of uint64.

    Words are what lies between white space (space, tab to carriage return). A text of fewer words
    is one shingle, a text of none has none.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle + 1, 1)
    spans = list(zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()))
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _HASH_BLOCK):
        block = spans[i : i + _HASH_BLOCK]
        yield np.array([digest(joined[a:b], SEED) for a, b in block], np.uint64)


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, as a signed 64-bit number; 0 without words."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    packed = np.packbits(2 * counts > n, bitorder="little") if n else np.zeros(8, np.uint8)
    return int(packed.view("<i8")[0])


def _simhash_udf(shingle):
    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        found = (simhash(text.as_py() or "", shingle) for text in texts)
        return pa.array(found, pa.int64(), size=len(texts))

    return fingerprints


def covering_masks(kept: int = 0, radius: int = RADIUS) -> list[int]:
    """Masks that keep `kept` and part of the other bits, so that any `radius` bits are free in one.

    Codes of radius + 1 bits are dealt to the other bits in turn.
    """
    vectors = range(1, 1 << (radius + 1))
    free = [b for b in range(BITS) if not kept >> b & 1]
    codes = {b: 1 + i % len(vectors) for i, b in enumerate(free)}
    return [kept | sum(1 << b for b in free if (codes[b] & v).bit_count() % 2) for v in vectors]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _member_links_udf(radius):
    @F.arrow_udf("array<struct<a: bigint, b: bigint>>")
    def links(groups: pa.Array) -> pa.Array:
        """For each group of fingerprints, a link from each to the least of its cluster."""
        result = []
        for group in groups:
            own = np.sort(group.values.to_numpy(zero_copy_only=False))
            near = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
            least = np.arange(len(own))
            while True:
                lower = np.where(near, least[None, :], len(own)).min(axis=1)
                if (lower == least).all():
                    break
                least = lower
            result.append(
                [{"a": int(own[i]), "b": int(own[j])} for i, j in enumerate(least) if i != j]
            )
        return pa.array(result, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return links


def fingerprint_links(
    fingerprints: DataFrame, radius: int = RADIUS, most_members: int = MOST_MEMBERS
) -> DataFrame:
    """Links (a, b) that connect all of `fingerprints` (distinct, `fingerprint`) within `radius`.

    Fewer than all pairs: within a masked value each cluster is a star. Runs jobs at once.
    """
    masks = [covering_masks(0, radius)]
    values = fingerprints.select(
        F.col("fingerprint").alias("f"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(t).alias("t"),
                        F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("value"),
                    )
                    for t, m in enumerate(masks[0])
                ]
            )
        ).alias("key"),
    ).select("f", "key.t", "key.value")
    values = written(values, "masked-values")
    found = []
    while True:
        sizes = values.groupBy("t", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = written(sizes, "group-sizes")
        shared = values.join(sizes, ["t", "value"])
        if max(BITS - m.bit_count() for m in masks[-1]) <= FREE_BITS:
            most_members = 1 << FREE_BITS
        groups = (
            shared.where(F.col("n") <= most_members)
            .groupBy("t", "value")
            .agg(F.collect_list("f").alias("fs"))
        )
        found.append(
            groups.select(F.explode(_member_links_udf(radius)("fs")).alias("l")).select("l.*")
        )
        large = sizes.where(F.col("n") > most_members)
        used = [r.t for r in large.select("t").distinct().orderBy("t").collect()]
        if not used:
            break
        finer = [(t, m) for t in used for m in covering_masks(masks[-1][t], radius)]
        masks.append([m for _, m in finer])
        # As many rows as masks: 15 for each of at most 15 ** rounds tables.
        table = fingerprints.sparkSession.createDataFrame(
            [(t, i, _signed(m)) for i, (t, m) in enumerate(finer)], "t int, i int, mask bigint"
        )
        values = (
            shared.where(F.col("n") > most_members)
            .join(F.broadcast(table), "t")
            .select(
                "f", F.col("i").alias("t"), F.col("f").bitwiseAND(F.col("mask")).alias("value")
            )
        )
        values = written(values, "masked-values")
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links.distinct()


def near_duplicates(
    documents: DataFrame,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    most_members: int = MOST_MEMBERS,
) -> DataFrame:
    """Per document: row, doc_id, digest of the text, fingerprint (bigint), component_id, n_links.

    component_id is the least doc_id that links lead to, the document's own included; n_links counts
    the links kept for its fingerprint. Ids that are missing count as larger than any. A missing
    text has fingerprint 0 and is linked like any other. Copies meet as one fingerprint, so they are
    never paired; every input row gives one row. Runs jobs at once and writes to scratch.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.xxhash64(F.lit("content"), text).alias("digest"),
            _simhash_udf(shingle)(text).alias("fingerprint"),
        ),
        "fingerprints",
    )
    nodes = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "nodes")
    links = written(fingerprint_links(nodes, radius, most_members), "fingerprint-links")
    roots = written(components(links), "roots")
    members = roots.union(roots.select("root", "root").distinct())
    named = nodes.join(members, F.col("fingerprint") == F.col("node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = named.join(least, "root").select("fingerprint", "least_id")
    degrees = (
        links.select(F.explode(F.array("a", "b")).alias("fingerprint"))
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("n_links"))
    )
    classes = (
        nodes.join(linked, "fingerprint", "left")
        .join(degrees, "fingerprint", "left")
        .select(
            "fingerprint",
            F.coalesce("least_id", "first_id").alias("component_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
    return rows.join(written(classes, "classes"), "fingerprint").select(
        "row", "doc_id", "digest", "fingerprint", "component_id", "n_links"
    )


def first_of_each(documents: DataFrame, **options) -> DataFrame:
    """One document of each component: that with the least id, with its own columns only.

    Rows that repeat an id and text are one document. Among rows of one id with different texts, and
    where no row of a component has an id, the least digest of the text stays.
    """
    classes = near_duplicates(documents, **options)
    # Partial aggregates: a component that a third of all rows belong to costs a row per task.
    firsts = classes.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")
    )
    # Components without any id have no component_id: tell them apart by their fingerprint.
    nameless = classes.where("component_id IS NULL").groupBy("fingerprint").agg(
        F.min(F.struct(F.lit(True).alias("no_id"), "doc_id", "digest")).alias("first")
    )
    kept = firsts.where("component_id IS NOT NULL").select("first").union(nameless.select("first"))
    return with_keys(documents, kept)


def with_keys(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose doc_id and digest of the text are in `kept.first`, repeated rows once."""
    name = free_name(documents, "kept_key")
    key = F.struct("doc_id", "digest").alias(name)
    kept = written(kept.select("first.doc_id", "first.digest").select(key), "kept-documents")
    digest = F.xxhash64(F.lit("content"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = documents.withColumn(name, F.struct("doc_id", digest.alias("digest")))
    # One shuffle of the texts, by the key, serves the join and the removal of repeated rows.
    joined = keyed.join(kept.hint("shuffle_hash"), name, "left_semi")
    return joined.dropDuplicates([name]).select(*documents.columns)
