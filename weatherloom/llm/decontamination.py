"""Benchmark decontamination by winnowed fingerprints.

Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. A window is
13 consecutive words of a benchmark item, or the whole item if it has fewer; a document word inside
any occurrence of a window is hit.

Winnowing keeps, of the 7 grams of 7 words inside each span of 13 words, the one with the smallest
hash (the last one of equals). The choice depends on the span alone, so a span that document and
benchmark share has the same gram kept on both sides, and looking at kept grams alone misses no
window. Items of fewer than 13 words are grams of their own length, all of which are kept.

Kept grams of documents are first held against a Bloom filter of the benchmark's, of bounded size
whatever the benchmark's. What passes is extended to the windows around it, and those are joined
with the benchmark's windows by their words, so that no hash decides anything in the end.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import free_name
from ..plans.sizing import written
from .words import find_words, grams, mix, parts

WINDOW = 13
GRAM = 7
# The filter has at most this many bits (16 MB), and 64 for each of its entries below that.
MOST_BITS, LEAST_BITS = 27, 20
_BUCKET = 32768

_WINDOWS = pa.list_(pa.struct([("words", pa.string()), ("probes", pa.list_(pa.int64()))]))
_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        (
            "hits",
            pa.list_(
                pa.struct(
                    [
                        ("words", pa.string()),
                        ("length", pa.int32()),
                        ("starts", pa.list_(pa.int32())),
                    ]
                )
            ),
        ),
    ]
)
_WINDOWS_TYPE = "array<struct<words: string, probes: array<bigint>>>"
_FOUND_TYPE = (
    "struct<n_words: bigint, hits: array<struct<words: string, length: int, starts: array<int>>>>"
)


def winnow(hashes: np.ndarray, valid: np.ndarray, span: int) -> np.ndarray:
    """Index of the kept gram of each run of `span` grams: the smallest hash, the last of equals.

    `valid` tells for each run whether it lies within one text; the others are left out.
    """
    count = max(len(hashes) - span + 1, 0)
    best, at = hashes[:count].copy(), np.arange(count)
    for i in range(1, span):
        candidate = hashes[i : i + count]
        smaller = candidate <= best
        best[smaller] = candidate[smaller]
        at[smaller] = np.flatnonzero(smaller) + i
    return at[valid[:count]]


def _probes(hashes: np.ndarray) -> np.ndarray:
    """Two places in the largest filter for each hash; smaller filters drop their low bits."""
    shift = np.uint64(64 - MOST_BITS)
    again = mix(hashes ^ np.uint64(0x5DEECE66D))
    return np.stack([hashes >> shift, again >> shift], axis=-1).astype(np.int64)


def _window_hash(hashes: np.ndarray) -> np.ndarray:
    """Whole windows are told from grams in the filter."""
    return mix(hashes + np.uint64(1))


def _benchmark_udf(window: int, gram: int):
    @F.arrow_udf(_WINDOWS_TYPE)
    def windows_of(texts: pa.Array) -> pa.Array:
        result = [[] for _ in range(len(texts))]
        for first, data, offsets in parts(texts):
            words = find_words(data, offsets)
            bounds = words.bounds()
            kept, _ = grams(words, gram)
            for row in range(words.rows):
                low, high = int(bounds[row]), int(bounds[row + 1])
                length = min(window, high - low)
                if not length:
                    continue
                whole, _ = grams(words, length)
                found = {}
                for at in range(low, high - length + 1):
                    hashes = [_window_hash(whole[at : at + 1])]
                    if length == window:
                        span = kept[at : at + window - gram + 1]
                        hashes.append(span.min(keepdims=True))
                    else:
                        hashes.append(whole[at : at + 1])
                    found[words.text(at, length)] = _probes(np.concatenate(hashes)).ravel()
                result[first + row] = [{"words": w, "probes": p} for w, p in found.items()]
        return pa.array(result, _WINDOWS)

    return windows_of


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item_id as string, words, length, probes): the distinct windows of each item.

    An item without id counts under the empty id; an item without words has no windows.
    """
    found = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.explode(_benchmark_udf(window, gram)(F.col("text").cast("string"))).alias("found"),
    )
    length = F.size(F.split("found.words", " ")).alias("length")
    return found.select("item_id", "found.words", length, "found.probes")


def _filter_of(windows: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, Bloom filter of the windows' probes); a few rows of 4 kB each reach the driver."""
    n = windows.select(F.sum(F.size("probes"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(64 * n + 1)), LEAST_BITS), MOST_BITS)
    place = windows.select(F.explode("probes").alias("p")).select(
        F.shiftright("p", MOST_BITS - bits).alias("p")
    )
    rows = (
        place.groupBy(F.floor(F.col("p") / _BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("p") % _BUCKET).alias("bitmap"))
        .collect()
    )
    filter_bytes = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows:
        low = row.bucket * _BUCKET // 8
        filter_bytes[low : low + len(row.bitmap)] |= np.frombuffer(bytes(row.bitmap), np.uint8)
    return bits, filter_bytes


def _passes(bits: int, filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = _probes(hashes) >> (MOST_BITS - bits)
    hit = (filter_bytes[places >> 3] >> (places & 7).astype(np.uint8)) & 1
    return hit.all(axis=-1)


def _hits(words, lengths, window, gram, bits, filter_bytes):
    """(length, starts) of the document windows that the filter cannot rule out."""
    for length in lengths:
        whole, valid = grams(words, length)
        if length == window:
            short, _ = grams(words, gram)
            kept = np.unique(winnow(short, valid, window - gram + 1))
            kept = kept[_passes(bits, filter_bytes, short[kept])]
            reach = np.arange(gram - window, 1)
            starts = np.unique((kept[:, None] + reach[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts < len(whole))]
            starts = starts[valid[starts]]
        else:
            starts = np.flatnonzero(valid)
        yield length, starts[_passes(bits, filter_bytes, _window_hash(whole[starts]))]


def _document_udf(filter_variable, bits, lengths, window, gram):
    @F.arrow_udf(_FOUND_TYPE)
    def found_in(texts: pa.Array) -> pa.Array:
        n_words = np.zeros(len(texts), np.int64)
        hits = [[] for _ in range(len(texts))]
        for first, data, offsets in parts(texts):
            words = find_words(data, offsets)
            bounds = words.bounds()
            n_words[first : first + words.rows] = np.diff(bounds)
            for length, starts in _hits(
                words, lengths, window, gram, bits, filter_variable.value
            ):
                by_words: dict = {}
                for at in starts:
                    row = int(words.row[at])
                    key = (row, words.text(at, length))
                    by_words.setdefault(key, []).append(int(at - bounds[row]))
                for (row, text), places in by_words.items():
                    hits[first + row].append({"words": text, "length": length, "starts": places})
        return pa.StructArray.from_arrays(
            [pa.array(n_words), pa.array(hits, _FOUND.field("hits").type)], ["n_words", "hits"]
        )

    return found_in


def content(text) -> F.Column:
    """Hash that tells the texts of one id apart."""
    return F.xxhash64(F.lit("content"), F.coalesce(text, F.lit("")))


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """Per document: doc_id, content (a hash), n_words, n_hit, items (sorted ids), contaminated.

    `documents` needs doc_id and text, `benchmark` item_id and text; other columns are not looked at.
    A missing text has no words. Each input row gives one row, repeated rows included. A document is
    contaminated if at least a twentieth of its words, and one, are hit. Empty tables give an empty
    result or no hits. Reads texts once and writes a small table to scratch, so it runs jobs at once.
    """
    spark = documents.sparkSession
    windows = written(benchmark_windows(benchmark, window, gram), "benchmark-windows")
    bits, filter_bytes = _filter_of(windows)
    lengths = [r.length for r in windows.select("length").distinct().orderBy("length").collect()]
    find = _document_udf(spark.sparkContext.broadcast(filter_bytes), bits, lengths, window, gram)
    text = F.col("text").cast("string")
    found = written(
        documents.select("doc_id", content(text).alias("content"), find(text).alias("found")).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "content",
            "found.n_words",
            "found.hits",
        ),
        "document-windows",
    )
    candidates = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    held = candidates.join(windows.select("words", "item_id"), "words")
    items = held.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    # All places of a window in a document are one row here, however many items share the window.
    covered = F.flatten(
        F.transform("starts", lambda s: F.sequence(s, s + F.col("length") - F.lit(1)))
    )
    hit_words = (
        candidates.join(windows.select("words"), "words", "left_semi")
        .select("row", covered.alias("covered"))
        .groupBy("row")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_hit"))
    )
    n_hit = F.coalesce(F.col("n_hit").cast("bigint"), F.lit(0).cast("bigint"))
    return (
        found.drop("hits")
        .join(hit_words, "row", "left")
        .join(items, "row", "left")
        .select(
            "doc_id",
            "content",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns only.

    Rows are told by id and text, as ids may repeat or be missing. Contaminated documents are few and
    written first, so Spark knows whether they are small enough to be sent to the texts.
    """
    found = contamination(documents, benchmark, **options).where("contaminated")
    key = free_name(documents, "item_key")
    dropped = written(found.select(F.struct("doc_id", "content").alias(key)), "contaminated")
    keyed = documents.withColumn(
        key, F.struct("doc_id", content(F.col("text").cast("string")).alias("content"))
    )
    return keyed.join(dropped, key, "left_anti").select(*documents.columns)
