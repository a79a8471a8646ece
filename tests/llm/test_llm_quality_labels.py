"""Label tables with one class alone."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherloom.llm import quality
from weatherloom.llm.words import _BASE, hash_word, mix



@pytest.mark.parametrize("label", [0.0, 1.0])
def test_one_class_alone_accepts(label):
    weights, intercept = quality.fit_logistic(np.ones((3, 2)), np.full(3, label))
    assert not weights.any() and intercept > 0


def test_bad_labels_alone_keep_all_documents(spark):
    df = spark.createDataFrame([(i, f"text {i} of some words") for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    assert quality.keep_good(df, labels, bits=10).count() == 20


def test_the_whole_query_against_plain_counts(spark):
    rng = random.Random(21)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    rows = []
    for i in range(240):
        words = rng.choices(good, k=20) if i % 3 else rng.choices(good, k=12) + rng.choices(bad, k=8)
        rows.append((i, " ".join(words), int(i % 3 > 0)))
    rows += [(240, None, 0), (241, "", 1), (242, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").repartition(4)
    labels = df.where("doc_id % 2 = 0").select("doc_id", "quality", F.lit(0).alias("toxic"))
    docs = df.select("doc_id", "text")
    bits, kappa, size = 10, quality.KAPPA, 1 << 10

    # Buckets of a text's n-grams by the hashes of its words, counted in plain Python.
    def grams_of(text):
        words = (text or "").split()
        found = []
        for n in quality.NGRAMS:
            for i in range(len(words) - n + 1):
                total = 0
                for word in words[i : i + n]:
                    total = (total * int(_BASE) + int(hash_word(word))) % 2**64
                found.append((n, int(mix(np.array([total], np.uint64))[0]) >> (64 - bits)))
        return found

    odd = {r.doc_id for r in docs.where(quality._odd("doc_id")).collect()}
    marked = {i: q for i, _, q in rows if i % 2 == 0}
    raw, target = Counter(), Counter()
    for i, text, _ in rows:
        raw.update(grams_of(text))
        if marked.get(i) and i in odd:
            target.update(grams_of(text))

    def ratio(gram):
        n = gram[0]
        share = sum(c for g, c in target.items() if g[0] == n) / sum(c for g, c in raw.items() if g[0] == n)
        return math.log((target[gram] + kappa) / (raw[gram] * share + kappa))

    ratios = {gram: np.float64(np.float32(ratio(gram))) for gram in raw}
    assert size > len(ratios) / 2

    def features(text):
        shapes = []
        for n in quality.NGRAMS:
            own = [ratios[g] for g in grams_of(text) if g[0] == n]
            shapes.append(sum(own) / max(len(own), 1))
            shapes += [math.log1p(-sum(min(r - bound, 0) for r in own)) for bound in quality.TAILS]
        return [*shapes, math.log1p(len((text or "").split()))]

    fitted = [(features(t), q) for i, t, q in rows if i in marked and i not in odd]
    weights, intercept = quality.fit_logistic(
        np.array([x for x, _ in fitted]), np.array([q for _, q in fitted], float)
    )
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(5, F.col("doc_id"), F.col("text")).alias("g")).collect()}
    expected = {}
    for i, text, _ in rows:
        log_weight = sum(ratios[g] for g in grams_of(text))
        log_odds = float(np.dot(weights, features(text)) + intercept)
        per_word = log_weight / max(len((text or "").split()), 1)
        expected[i] = (log_weight, log_odds, per_word + noise[i], log_odds / quality.TEMPERATURE + noise[i])
    for k in (None, 40):
        got = {r.doc_id: r for r in quality.resample(docs, labels, k=k, seed=5, bits=bits).collect()}
        assert got.keys() == expected.keys()
        for i, values in expected.items():
            own = got[i]
            for x, y in zip((own.log_weight, own.log_odds, own.weight_key, own.sample_key), values):
                assert x == pytest.approx(y, rel=1e-4, abs=1e-4)
        n = k or sum(v[1] > 0 for v in expected.values())
        for column, at in (("resampled", 2), ("keep", 3)):
            chosen = sorted(expected, key=lambda i: -expected[i][at])[:n]
            assert {i for i, r in got.items() if r[column]} == set(chosen)
