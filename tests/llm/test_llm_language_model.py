"""The n-gram model against counts in plain Python."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weatherloom.llm import elias_fano, language_model
from weatherloom.llm.words import hash_word

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens_of(text):
    return [*WORD.findall((text or "").translate(A_TO_Z)), None]


def plain_scores(rows, held_out, discount=0.75):
    """Sorted (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    one, two = Counter(), Counter()
    for doc_id, text in rows:
        if not held_out(doc_id):
            tokens = tokens_of(text)
            one.update(tokens)
            two.update(zip([None, *tokens], tokens))
    n, types = sum(one.values()), Counter(v for v, _ in two)

    def alone(w):
        return (one[w] + 1) / (n + len(one) + 1)

    def p(v, w):
        if not one[v]:
            return alone(w)
        seen = max(two[v, w] - discount, 0) / one[v]
        return seen + discount * types[v] / one[v] * alone(w)

    result = []
    for doc_id, text in rows:
        tokens = tokens_of(text)
        result.append(
            (
                doc_id,
                held_out(doc_id),
                len(tokens),
                sum(one[w] > 0 for w in tokens),
                n,
                sum(math.log10(alone(w)) for w in tokens),
                sum(math.log10(p(v, w)) for v, w in zip([None, *tokens], tokens)),
            )
        )
    return sorted(result, key=str)


def close(got, expected):
    got = sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[2]))
    expected = sorted(expected, key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        # A code is off by half a step at most.
        assert a[6] == pytest.approx(b[6], abs=a[2] * 2e-4)


def random_texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "É", "é", "a.b", "x" * 70, *[f"w{i}" for i in range(60)]]
    weights = [40, 10, *[1 + 40 / (1 + i) for i in range(len(words) - 2)]]
    gaps = [" ", "\n", "\t ", "\x0b", "\xa0", "  "]
    return [
        "".join(w + rng.choice(gaps) for w in rng.choices(words, weights, k=rng.choice([0, 1, 5, 80])))
        for _ in range(n)
    ]


def held_out_column():
    return F.col("doc_id") % 3 == 1


@pytest.mark.parametrize("batch_bytes, shard_tokens", [(1 << 24, 1 << 22), (300, 40), (2000, 500)])
def test_scores_are_those_of_plain_counts(spark, batch_bytes, shard_tokens):
    rows = list(enumerate(random_texts(150, 3)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = language_model.score_texts(
        df, held_out_column(), batch_bytes=batch_bytes, shard_tokens=shard_tokens
    )
    close(got.collect(), plain_scores(rows, lambda i: i % 3 == 1))


def test_a_context_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SAMPLE_STEP", 1)
    rng = random.Random(9)
    rows = [
        (i, " ".join(x for _ in range(60) for x in ("hot", f"w{rng.randrange(400)}"))) for i in range(90)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = language_model.score_texts(df, held_out_column(), batch_bytes=4000, shard_tokens=300)
    close(got.collect(), plain_scores(rows, lambda i: i % 3 == 1))


def test_odd_rows(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, " \n "),
        (3, "one two"),
        (3, "one two"),
        (None, "no id here"),
        (4, "long Words " * 30_000 + "end"),
        (5, "y" * 100_000),
        (7, "one unknown two"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    names = ("row", "id", "rows", "batch", "shard", "tokens", "held_out", "score")
    odd = df.select("*", *[F.lit("clash").alias(n) for n in names])
    got = language_model.score_texts(odd, held_out_column(), batch_bytes=20_000).collect()
    close(got, plain_scores(rows, lambda i: i is not None and i % 3 == 1))
    assert language_model.score_texts(df.where("false"), held_out_column()).count() == 0
    (alone,) = language_model.score_texts(df.where("doc_id = 7"), held_out_column()).collect()
    assert (alone.train_tokens, alone.n_known, alone.base_score, alone.score) == (0, 0, 0.0, 0.0)


def test_held_out_texts_score_better_than_shuffled_ones(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    after = {w: rng.sample(words, 3) for w in words}
    rows = []
    for i in range(200):
        text = [rng.choice(words)]
        for _ in range(60):
            text.append(rng.choice(after[text[-1]]))
        rows.append((2 * i, " ".join(text)))
        rows.append((2 * i + 1, " ".join(rng.sample(text, len(text)))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    held_out = (F.col("doc_id") % 2 == 1) | (F.col("doc_id") >= 300)
    scores = {r.doc_id: r for r in language_model.score_texts(df, held_out).collect()}
    for i in range(300, 400, 2):
        assert scores[i].score > scores[i + 1].score
        assert scores[i].score > scores[i].base_score
        assert scores[i].base_score == pytest.approx(scores[i + 1].base_score)


@pytest.mark.parametrize("spread", [0, 1, 50, 10**6, 10**15, 2**64 - 1])
def test_elias_fano(spread):
    rng = random.Random(spread)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        base = 0 if spread == 2**64 - 1 else 77
        values = sorted(rng.randint(base, base + spread) for _ in range(n))
        own = elias_fano.EliasFano(elias_fano.EliasFano.arrays(np.array(values, np.uint64)))
        assert own[np.arange(n)].tolist() == values
        asked = sorted({0, 1, 76, 77, 78, 2**64 - 1, *values, *[min(v + 1, 2**64 - 1) for v in values]})
        place, equal = own.successor(np.array(asked, np.uint64))
        for x, p, e in zip(asked, place.tolist(), equal.tolist()):
            assert p == sum(v < x for v in values) and e == (x in set(values))


def test_mapped_arrays(tmp_path):
    arrays = {
        "a.b": np.arange(5, dtype=np.uint16),
        "c.d": np.array([], np.int64),
        "e.f": np.array([2**63], np.uint64),
    }
    elias_fano.write_arrays(f"file://{tmp_path}/arrays", arrays)
    found = elias_fano.map_arrays(f"file://{tmp_path}/arrays")
    assert {k: v.tolist() for k, v in found.items()} == {k: v.tolist() for k, v in arrays.items()}


def test_trie_is_compact():
    rng = np.random.default_rng(1)
    contexts = np.sort(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    sizes = rng.integers(1, 20, len(contexts))
    words = np.concatenate([rng.choice(contexts, n, replace=False) for n in sizes])
    counts = rng.integers(1, 9, len(words))
    totals = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
    arrays = language_model.Trie.arrays(contexts, sizes, totals, words, counts)
    of_pairs = sum(a.nbytes for k, a in arrays.items() if k.startswith("successors"))
    assert of_pairs < 2.2 * len(words)
    trie = language_model.Trie(arrays)
    at, found, _ = trie.context(contexts)
    assert (found == totals).all()
    p = language_model.probability(trie.discounted(np.repeat(at, sizes), words))
    assert np.allclose(p, (counts - 0.75) / np.repeat(totals, sizes), rtol=5e-4)
    assert (trie.discounted(at, np.full(len(at), 5, np.uint64)) == language_model.MISSING).all()


def test_long_texts_are_cut_behind_white_space():
    texts = ["ab cd ef gh", "", "x" * 30, "y" * 30 + " z", "a b"]
    for limit in (1, 4, 7, 100):
        found = [p for _, group in language_model.pieces(pa.array(texts), limit) for p in group]
        data = "".join(texts)
        for row, text in enumerate(texts):
            own = [p for p in found if p[0] == row]
            assert "".join(data[a:b] for _, a, b, _, _ in own) == text
            assert [p[3] for p in own] == [True] + [False] * (len(own) - 1)
            assert [p[4] for p in own] == [False] * (len(own) - 1) + [True]
            words = [w for _, a, b, _, _ in own for w in data[a:b].split()]
            assert words == text.split()


def rows_of(texts):
    n = range(len(texts))
    columns = [pa.array(n), pa.array(map(str, n)), pa.array([i % 3 == 1 for i in n]), pa.array(texts)]
    return pa.record_batch(columns, names=["row", "id", "held_out", "text"])


def test_a_batch_of_texts_takes_little_memory():
    rng = random.Random(2)
    words = [f"word{i}" for i in range(20_000)]
    many = [" ".join(rng.choices(words, k=300)) for _ in range(2500)]
    for texts in (many, [" ".join(many)]):
        batch, size = rows_of(texts), sum(map(len, texts))
        tokenise = language_model._tokenised(language_model.BATCH_BYTES)
        list(tokenise(iter([batch.slice(0, 1)])))
        tracemalloc.start()
        (found,) = tokenise(iter([batch]))
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert found["n_tokens"][0].as_py() == sum(len(tokens_of(t)) for t in texts)
        assert peak < 4 * size


def test_blocks_of_a_batch_change_nothing(monkeypatch):
    texts = [*random_texts(80, 6), None, "", "z" * 5000, " ", "long Words " * 900 + "end", "\t"]
    limits = (1 << 24, 700)
    whole = [list(language_model._tokenised(limit)(iter([rows_of(texts)]))) for limit in limits]
    assert [len(w) for w in whole][0] == 1 < len(whole[1])
    hashes = np.frombuffer(whole[0][0]["vocabulary"][0].as_py(), np.uint64)
    plain = sorted({t for text in texts for t in tokens_of(text)}, key=str)
    expected = [int(hash_word(w)) if w else int(language_model.END) for w in plain]
    assert hashes.tolist() == sorted(expected)
    for size in (1, 7, 64, 1000):
        for name in ("BLOCK_BYTES", "BLOCK_TOKENS", "GAP_BYTES"):
            monkeypatch.setattr(language_model, name, size)
        for limit, expected in zip(limits, whole):
            found = list(language_model._tokenised(limit)(iter([rows_of(texts)])))
            assert [f.to_pylist() for f in found] == [e.to_pylist() for e in expected]


def test_a_shard_takes_little_memory():
    rng = np.random.default_rng(3)
    contexts = np.tile(rng.integers(0, 2**63, 40_000).astype(np.uint64), 10)
    sizes = np.full(len(contexts), 4, np.int32)
    words = rng.integers(0, 2**63, 50_000).astype(np.uint64)[rng.integers(0, 50_000, sizes.sum())]
    counts = rng.integers(0, 3, len(words)).astype(np.int32)
    totals = counts.reshape(-1, 4).sum(axis=1)
    size = sum(a.nbytes for a in (contexts, sizes, totals, words, counts))
    own = [contexts.copy(), sizes.copy(), totals.copy(), words.copy(), counts.copy()]
    tracemalloc.start()
    arrays = language_model.Trie.arrays(*(own.pop(0) for _ in range(5)))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 3.5 * size
    trie = language_model.Trie(arrays)
    summed = Counter()
    for v, w, c in zip(np.repeat(contexts, sizes).tolist(), words.tolist(), counts.tolist()):
        summed[v, w] += c
    v, w = np.array([*summed], np.uint64).T
    at, total, _ = trie.context(v)
    c = np.array([*summed.values()])
    p = language_model.probability(trie.discounted(at, w))
    assert np.allclose(p, np.maximum(c - 0.75, 0) / total, rtol=5e-4)
