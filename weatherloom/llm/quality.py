"""Quality classifier by importance resampling.

Two generative models over hashed n-grams of words (runs of letters and digits, or of other visible
characters, in lower case): one of the target, the documents labelled good and harmless, and one of
the raw corpus, all documents. Both are counts over the same buckets, for n = 1 and n = 2.

    ratio(bucket) = log((target count + KAPPA) / (expected target count + KAPPA))

where the expected count is the raw share times the target's size. KAPPA keeps rare buckets near 0,
so that only what the counts can tell weighs. A document's log weight is the sum of its ratios. As
such sums grow with length, acceptance looks at a few shapes of them (means, and what falls below
several bounds, where words that the target never has show), weighed by a logistic regression on
labelled documents that the target model has not seen.

Sampling is by Gumbel top-k, without replacement: of all documents, the k largest of log weight per
word + Gumbel noise are resampled, which draws them by their importance weights. What is kept is drawn
in the same way by the log odds: the k largest of log odds / TEMPERATURE + noise. k is the number of
documents with positive log odds unless given. The noise is a hash of seed, id and text, so a
recomputed task draws the same.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import free_name
from ..plans.sizing import written
from .words import PART_BYTES, WORD_BYTES, find_words, grams, parts

# Buckets per n-gram length. The models have this size whatever the corpus: 2 * 4 MB of ratios.
BUCKET_BITS = 20
# Counts leave a task in blocks of this many buckets.
_BLOCK = 1 << 12
KAPPA = 0.5
# Bounds below which ratios are summed up on their own.
TAILS = (-1.5, -2.5, -4.0)
# At most this many labels are used, drawn by a hash of the id.
LABELLED_ROWS = 200_000
TEMPERATURE = 0.1
NGRAMS = (1, 2)

_N_FEATURES = len(NGRAMS) * (1 + len(TAILS)) + 1
FEATURES = "struct<log_weight: double, features: array<double>>"

# Words here also hold marks such as "%%%": everything that is not white space or a control
# character, cut where letters and marks meet.
_MARK_BYTES = ~WORD_BYTES
_MARK_BYTES[:0x21] = False
_MARK_BYTES[0x7F] = False
_MARK_BYTES[ord("A") : ord("Z") + 1] = False


def _buckets(data, offsets, bits):
    """For n = 1 and 2: (bucket, row) of every n-gram of these texts."""
    letters, marks = find_words(data, offsets), find_words(data, offsets, _MARK_BYTES)
    start = np.concatenate([letters.start, marks.start])
    order = np.argsort(start, kind="stable")
    both = letters._replace(
        hash=np.concatenate([letters.hash, marks.hash])[order],
        row=np.concatenate([letters.row, marks.row])[order],
    )
    shift = np.uint64(64 - bits)
    for n in NGRAMS:
        hashes, valid = grams(both, n)
        yield (hashes[valid] >> shift).astype(np.int64), both.row[: len(hashes)][valid]


def _count(bits):
    size = 1 << bits

    def counted(batches):
        """Counts of this task, as blocks of int64; the target's are those of marked rows."""
        totals = np.zeros((2, len(NGRAMS), size), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in parts(batch.column(0), PART_BYTES):
                for n, (bucket, row) in enumerate(_buckets(data, offsets, bits)):
                    totals[0, n] += np.bincount(bucket, minlength=size)
                    good = target[first + row].astype(bool)
                    totals[1, n] += np.bincount(bucket[good], minlength=size)
        blocks = totals.reshape(-1, min(_BLOCK, size))
        kept = np.flatnonzero(blocks.any(axis=1))
        # Counts of one task fit 32 bits, and compress well.
        small = [blocks[i].astype(np.uint32).tobytes() for i in kept]
        columns = [pa.array(kept, pa.int32()), pa.array(small, pa.binary())]
        yield pa.record_batch(columns, ["block", "counts"])

    return counted


def _add_up(batches):
    """One row per block of a partition: sums of counts. Partitions hold whole blocks."""
    totals: dict = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(counts, np.uint32).astype(np.int64)
            totals[block] = totals.get(block, 0) + counts
    sums = pa.array([v.tobytes() for v in totals.values()], pa.binary())
    yield pa.record_batch([pa.array(list(totals), pa.int32()), sums], ["block", "counts"])


def log_ratios(documents: DataFrame, bits: int = BUCKET_BITS, kappa: float = KAPPA) -> np.ndarray:
    """log ratio of target and raw model for each n-gram length and bucket, as float32.

    `documents` has `text` and the boolean `target`. Each task counts its own rows; blocks of counts
    are shuffled and added. The result has a fixed size, whatever the corpus.
    """
    size = 1 << bits
    counted = documents.select(
        F.col("text").cast("string"), F.coalesce("target", F.lit(False))
    ).mapInArrow(_count(bits), "block int, counts binary")
    sums = counted.repartition("block").mapInArrow(_add_up, "block int, counts binary").collect()
    totals = np.zeros((2, len(NGRAMS), size), np.int64).reshape(-1, min(_BLOCK, size))
    for row in sums:
        totals[row.block] = np.frombuffer(bytes(row.counts), np.int64)
    raw, target = totals.reshape(2, len(NGRAMS), size).astype(np.float64)
    shares = target.sum(axis=1) / np.maximum(raw.sum(axis=1), 1)
    return np.log((target + kappa) / (raw * shares[:, None] + kappa)).astype(np.float32)


def _features_udf(ratios_variable, bits):
    @F.arrow_udf(FEATURES)
    def features(texts: pa.Array) -> pa.Array:
        log_weight = np.zeros(len(texts))
        shapes = np.zeros((len(texts), _N_FEATURES))
        for first, data, offsets in parts(texts):
            rows = len(offsets) - 1
            own = slice(first, first + rows)
            at = 0
            for n, (bucket, row) in enumerate(_buckets(data, offsets, bits)):
                ratio = ratios_variable.value[n][bucket].astype(np.float64)
                total = np.bincount(row, ratio, rows)
                count = np.bincount(row, minlength=rows)
                log_weight[own] += total
                shapes[own, at] = total / np.maximum(count, 1)
                for i, bound in enumerate(TAILS, 1):
                    tail = np.bincount(row, np.minimum(ratio - bound, 0), rows)
                    shapes[own, at + i] = np.log1p(-tail)
                at += 1 + len(TAILS)
                if n == 0:
                    shapes[own, -1] = np.log1p(count)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * _N_FEATURES)
        lists = pa.ListArray.from_arrays(offsets, pa.array(shapes.ravel()))
        return pa.StructArray.from_arrays([pa.array(log_weight), lists], ["log_weight", "features"])

    return features


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on raw features, by Newton steps.

    Without both classes nothing can be told apart: weights are 0 and the intercept accepts.
    """
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 1.0
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(y))
    penalty[-1] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1000) -> float:
    """The k-th largest value of a column, by counts in ever narrower bins; k is at least 1.

    Each round is one partial aggregate over one column; no values are sorted or gathered.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) / bins
        if not width or low + width == low:
            break
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        inside = values.where(F.col(column).between(low, high))
        counts = (
            inside.groupBy(place.alias("bin"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min(column).alias("low"),
                F.max(column).alias("high"),
            )
            .orderBy(F.desc("bin"))
            .collect()
        )
        for row in counts:
            if above + row.n >= k:
                low, high = row.low, row.high
                break
            above += row.n
    return low


def label_sample(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, good) of at most `rows` labelled ids, the smallest by a hash; written to scratch.

    An id labelled twice is good only if all its labels say so. A missing quality is not good, a
    missing toxic mark is harmless, labels without id are left out.
    """
    harmless = F.coalesce(F.col("toxic"), F.lit(0)) == 0
    good = harmless & (F.coalesce(F.col("quality"), F.lit(0)) == 1)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and(good).alias("good"))
    return written(marks.orderBy(F.xxhash64(F.lit("fit"), "doc_id")).limit(rows), "label-sample")


def _odd(key) -> F.Column:
    """Half of the ids: their labels build the target model, the others' fit the regression."""
    return F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)) == 1


class QualityModel:
    """Fitted ratios and regression; `score` adds log_weight and log_odds to any documents."""

    def __init__(self, spark, ratios, weights, intercept, bits):
        self.ratios = spark.sparkContext.broadcast(ratios)
        self.weights, self.intercept, self.bits = weights, intercept, bits

    def columns(self, text="text") -> tuple[F.Column, F.Column, F.Column]:
        """(log_weight, the same per word, log_odds) of a text column."""
        shapes = _features_udf(self.ratios, self.bits)(F.col(text).cast("string"))
        terms = [F.lit(float(w)) * shapes["features"][i] for i, w in enumerate(self.weights)]
        # The last feature tells the number of words.
        words = F.round(F.expm1(shapes["features"][_N_FEATURES - 1]))
        per_word = shapes["log_weight"] / F.greatest(words, F.lit(1.0))
        return shapes["log_weight"], per_word, sum(terms, F.lit(float(self.intercept)))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    bits: int = BUCKET_BITS,
    kappa: float = KAPPA,
    labelled_rows: int = LABELLED_ROWS,
) -> QualityModel:
    """Fit on all texts and on a bounded sample of the labels. Runs two passes over the texts.

    Without any good label the target is empty and nothing can be told apart: all is accepted. Of the
    documents that share a labelled id, the one with the least features takes part in the regression.
    """
    spark = documents.sparkSession
    # At most `labelled_rows` rows of an id and a mark: some 2 MB at the default.
    marks = F.broadcast(label_sample(labels, labelled_rows))
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    target = texts.join(marks, "doc_id", "left").withColumn("target", F.col("good") & _odd("doc_id"))
    ratios = log_ratios(target, bits, kappa)
    features = _features_udf(spark.sparkContext.broadcast(ratios), bits)
    held_out = texts.join(marks, "doc_id").where(~_odd("doc_id"))
    # One row of each labelled id comes to the driver, however often the id repeats.
    shapes = held_out.select("doc_id", "good", features("text")["features"].alias("x"))
    least = shapes.groupBy("doc_id").agg(F.min(F.struct("x", "good")).alias("least"))
    rows = least.select("least.good", "least.x").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, _N_FEATURES)
    y = rows["good"].to_numpy(dtype=float)
    # Rows arrive in any order, and sums of floats depend on it.
    order = np.lexsort(np.column_stack([x, y]).T)
    return QualityModel(spark, ratios, *fit_logistic(x[order], y[order]), bits)


def gumbel(seed: int, *columns) -> F.Column:
    """Standard Gumbel noise, a function of seed and columns alone."""
    high = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    uniform = (high.cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def sample_key(log_odds, seed: int = 0, temperature: float = TEMPERATURE) -> F.Column:
    """What Gumbel top-k compares: log odds at the given temperature plus noise."""
    noise = gumbel(seed, F.col("doc_id"), F.col("text"))
    return F.coalesce(log_odds / temperature, F.lit(0.0)) + noise


def scored(documents: DataFrame, model: QualityModel, seed: int = 0) -> DataFrame:
    """Per row: doc_id, log_weight, log_odds, weight_key, sample_key. Written to scratch."""
    log_weight, per_word, log_odds = model.columns()
    df = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    df = df.select(
        "doc_id",
        "text",
        log_weight.alias("log_weight"),
        log_odds.alias("log_odds"),
        per_word.alias("per_word"),
    )
    df = df.withColumn("weight_key", sample_key(F.col("per_word"), seed, 1.0))
    df = df.withColumn("sample_key", sample_key(F.col("log_odds"), seed))
    return written(df.drop("text", "per_word"), "quality-scores")


def drawn(scores: DataFrame, k: int | None = None) -> int:
    """How many documents are drawn."""
    if k is None:
        return scores.where("log_odds > 0").count()
    return min(k, scores.count())


def threshold(scores: DataFrame, k: int | None = None, key: str = "sample_key") -> float:
    """The sample key of the last document that is drawn; infinite if none is."""
    k = drawn(scores, k)
    return kth_largest(scores, key, k) if k else math.inf


def resample(
    documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, **options
) -> DataFrame:
    """Per document: doc_id, log_weight, log_odds, weight_key, sample_key, resampled, keep.

    `resampled` are the k largest weight keys, `keep` the k largest sample keys. `documents` needs doc_id and text, `labels` doc_id, quality and toxic (0 or 1). Every row is
    scored; a missing text is empty and its ratios are 0. Documents with equal sample keys stand or
    fall together, as repeated rows do. Empty tables give an empty result, no labels accept all.
    """
    scores = scored(documents, fit(documents, labels, **options), seed)
    k = drawn(scores, k)
    return scores.withColumns(
        {
            "resampled": F.col("weight_key") >= F.lit(threshold(scores, k, "weight_key")),
            "keep": F.col("sample_key") >= F.lit(threshold(scores, k)),
        }
    )


def keep_good(
    documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, **options
) -> DataFrame:
    """The documents that `resample` keeps, with their own columns only.

    They are scored again while they are filtered, which moves no text.
    """
    model = fit(documents, labels, **options)
    least = threshold(scored(documents, model, seed), k)
    _, _, log_odds = model.columns()
    key = free_name(documents, "own_key")
    return (
        documents.withColumn(key, log_odds)
        .withColumn(key, sample_key(F.col(key), seed))
        .where(F.col(key) >= F.lit(least))
        .select(*documents.columns)
    )
