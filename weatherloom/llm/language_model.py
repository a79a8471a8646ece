"""Scores of texts by an n-gram model kept in Elias-Fano tries.

The model is of order 2 with absolute discounting: with c counts in the training texts,

    p(w | v) = max(c(v w) - DISCOUNT, 0) / c(v) + DISCOUNT * n(v) / c(v) * p(w),
    p(w) = (c(w) + 1) / (N + V + 1),

where n(v) is the number of different words behind v. A word that never occurred as v has p(w) alone.
A text is its words and an end, which also stands in front of the first word.

The model is spread over shards: ranges of (v, w) by hash, cut at places that a bounded sample finds,
so a context that a third of all text has is divided as well. A shard is a trie in a file that is
mapped into memory. Its levels are Elias-Fano sequences: the contexts, monotone pointers to where the
words behind each context begin, and those words as numbers relative to the context (its place times
the size of the shard's vocabulary, plus the place of the word in that vocabulary), each with its
discounted probability in 16 bits. A lookup is a successor search for the context, one for the word,
and one for the word's number in the range of its context.

Batches of texts are counted before they move: a batch sends every shard its different pairs with
their counts, and the totals of its contexts, to all shards that hold a part of a context. The shard
builds its trie from the sums, then answers the same pairs from it.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import scratch_path, written
from .elias_fano import EliasFano, map_arrays, write_arrays
from .warc import open_store
from .words import find_words, utf8

DISCOUNT = 0.75
BATCH_BYTES = 16 << 20
# Words of a batch are found in blocks of about this many bytes, and numbered in blocks of this many
# tokens, as each worker of an executor holds a batch.
BLOCK_BYTES = 1 << 18
BLOCK_TOKENS = 1 << 18
# White space to cut at is looked for in so many bytes at a time.
GAP_BYTES = 1 << 16
# A shard is for about this many tokens, of which it holds the different pairs.
SHARD_TOKENS = 3_000_000
# Of a batch, one token in so many is offered to the sample that finds the cuts between shards.
SAMPLE_STEP = 1009
# Pairs of the sample that reach the driver, of 16 bytes each.
SAMPLE_PAIRS = 1 << 20

# The hash of a text's end, that of the empty word.
END = np.uint64(0)
GAPS = np.zeros(256, dtype=bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True

# Probabilities as 16-bit logarithms: from 1 down to 2 ** -48.
OCTAVES = 48
MISSING = 65535
_PER_OCTAVE = (MISSING - 1) / OCTAVES

_BATCHES = (
    "rows array<bigint>, ids array<string>, held_out array<boolean>, begins binary, vocabulary binary, "
    "tokens binary, n_tokens bigint, n_training bigint, sample array<struct<v: bigint, w: bigint>>"
)
_BATCH_TYPES = pa.schema(
    [
        ("rows", pa.list_(pa.int64())),
        ("ids", pa.list_(pa.string())),
        ("held_out", pa.list_(pa.bool_())),
        ("begins", pa.binary()),
        ("vocabulary", pa.binary()),
        ("tokens", pa.binary()),
        ("n_tokens", pa.int64()),
        ("n_training", pa.int64()),
        ("sample", pa.list_(pa.struct([("v", pa.int64()), ("w", pa.int64())]))),
    ]
)
_QUESTIONS = (
    "shard int, batch bigint, contexts binary, sizes binary, totals binary, words binary, counts binary"
)
_ANSWERS = "shard int, batch bigint, totals binary, backoffs binary, codes binary, n_contexts bigint"
_SCORES = (
    "row bigint, id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
    "score double"
)


def _schema(ddl: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(),
        "bigint": pa.int64(),
        "double": pa.float64(),
        "binary": pa.binary(),
        "string": pa.string(),
        "boolean": pa.bool_(),
    }
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def pack(numbers: np.ndarray, kind) -> bytes:
    """Numbers as compressed bytes, those of one weight together."""
    planes = np.ascontiguousarray(numbers.astype(kind)).view(np.uint8)
    planes = np.ascontiguousarray(planes.reshape(len(numbers), -1).T) if len(numbers) else planes
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], n * width, "zstd", asbytes=True) if n else b""
    planes = np.frombuffer(planes, np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _cut(data: np.ndarray, first: int, end: int, limit: int) -> int:
    """End of a piece that begins at `first`: behind white space, if all up to `end` is too long.

    That is the last white space within `limit` bytes, or else the next one.
    """
    high = low = first + limit
    if high >= end:
        return end
    while low > first:
        at, low = low, max(low - GAP_BYTES, first)
        gaps = np.flatnonzero(GAPS[data[low:at]])
        if len(gaps):
            return low + int(gaps[-1]) + 1
    while high < end:
        at, high = high, min(high + GAP_BYTES, end)
        gaps = np.flatnonzero(GAPS[data[at:high]])
        if len(gaps):
            return at + int(gaps[0]) + 1
    return end


def _together(data: np.ndarray, spans, limit: int):
    """Lists of (span, first byte, end, is the span's first, is its last) of about `limit` bytes."""
    found, size = [], 0
    for span, (start, end) in enumerate(spans):
        first = start
        while True:
            cut = _cut(data, first, end, limit)
            if found and size + cut - first > limit:
                yield found
                found, size = [], 0
            found.append((span, first, cut, first == start, cut == end))
            size += cut - first
            first = cut
            if cut == end:
                break
    if found:
        yield found


def pieces(column: pa.Array, limit: int):
    """Lists of (row, first byte, end, is the text's first, is its last) of about `limit` bytes.

    Consecutive texts are together; one that is longer is cut behind white space.
    """
    data, offsets = utf8(column)
    offsets = offsets.tolist()
    for found in _together(data, zip(offsets[:-1], offsets[1:]), limit):
        yield data, found


def _batch(data, found, before: np.uint64):
    """(hashes, begins) of the tokens of pieces; each begins with the word in front of it."""
    counts, of_words = np.zeros(len(found), np.int64), []
    for block in _together(data, [(p[1], p[2]) for p in found], BLOCK_BYTES):
        first, last = block[0][0], block[-1][0]
        low, high = block[0][1], block[-1][2]
        words = find_words(data[low:high], np.array([*[p[1] for p in block], high]) - low, ~GAPS)
        counts[first : last + 1] += np.bincount(words.row, minlength=len(block))
        of_words.append(words.hash)
    is_last = np.array([p[4] for p in found])
    lengths = 1 + counts + is_last
    ends = np.cumsum(lengths)
    begins = ends - lengths
    is_word = np.ones(int(lengths.sum()), bool)
    is_word[begins] = False
    is_word[ends[is_last] - 1] = False
    hashes = np.full(len(is_word), END)
    hashes[is_word] = np.concatenate(of_words)
    for i, (_, _, _, is_first, _) in enumerate(found):
        if not is_first:
            hashes[begins[i]] = before if i == 0 else hashes[begins[i] - 1]
    return hashes, begins


def _numbered(hashes: np.ndarray):
    """The different hashes in order, and the place of each hash among them."""
    blocks = []
    for i in range(0, len(hashes), BLOCK_TOKENS):
        own, at = np.unique(hashes[i : i + BLOCK_TOKENS], return_inverse=True)
        blocks.append((own, at.astype(np.int32)))
    vocabulary = np.unique(np.concatenate([own for own, _ in blocks]))
    tokens = [np.searchsorted(vocabulary, own).astype(np.int32)[at] for own, at in blocks]
    return vocabulary, np.concatenate(tokens)


def _counted(found, hashes, begins, row, key, is_held_out) -> pa.RecordBatch:
    """The row of a batch."""
    held_out = [bool(is_held_out[p[0]]) for p in found]
    lengths = np.diff(np.append(begins, len(hashes))) - 1
    at = np.arange(1, len(hashes), SAMPLE_STEP)
    pairs = np.unique(np.stack([hashes[at - 1], hashes[at]]).view(np.int64), axis=1)
    vocabulary, tokens = _numbered(hashes)
    return pa.RecordBatch.from_pylist(
        [
            {
                "rows": [row[p[0]] for p in found],
                "ids": [key[p[0]] for p in found],
                "held_out": held_out,
                "begins": pack(begins, np.int64),
                "vocabulary": vocabulary.tobytes(),
                "tokens": pack(tokens, np.int32),
                "n_tokens": int(lengths.sum()),
                "n_training": int(lengths[~np.array(held_out)].sum()),
                "sample": [{"v": v, "w": w} for v, w in pairs.T.tolist()],
            }
        ],
        _BATCH_TYPES,
    )


def _tokenised(batch_bytes: int):
    def tokenise(batches):
        for batch in batches:
            # What the rows before left is given back, as other workers share the executor's memory.
            pa.default_memory_pool().release_unused()
            of_rows = [batch.column(i).to_pylist() for i in range(3)]
            before = END
            for data, found in pieces(batch.column(3), batch_bytes):
                hashes, begins = _batch(data, found, before)
                before = hashes[-1]
                counted = _counted(found, hashes, begins, *of_rows)
                del hashes, begins
                yield counted

    return tokenise


class Batch:
    """Tokens of a batch of texts, its different pairs, and how both are dealt out to shards.

    Tokens are places in the batch's sorted vocabulary, so pairs sort like pairs of hashes.
    """

    def __init__(self, begins, vocabulary, tokens, held_out, cuts):
        self.vocabulary = np.frombuffer(vocabulary, np.uint64)
        self.begins = unpack(begins, np.int64)
        tokens = unpack(tokens, np.int32)
        lengths = np.diff(np.append(self.begins, len(tokens))) - 1
        self.piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.word = np.delete(tokens, self.begins)
        is_last = np.append(self.begins[1:] - 1, len(tokens) - 1)
        self.pair = np.delete(tokens, is_last).astype(np.int64)
        self.pair *= len(self.vocabulary)
        self.pair += self.word
        self.is_training = np.repeat(~np.array(held_out, bool), lengths)
        self.cut_v, self.cut_w = cuts
        # Shards that hold a part of each word's pairs, as context.
        self.first_shard = np.searchsorted(self.cut_v, self.vocabulary, side="left")
        self.last_shard = np.searchsorted(self.cut_v, self.vocabulary, side="right")

    def pairs(self):
        """Different pairs in order, and their counts in training texts."""
        marked = self.pair * 2
        marked += self.is_training
        marked.sort()
        pairs = marked >> 1
        marked &= 1
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else pairs
        counts = np.add.reduceat(marked, first) if len(first) else first
        return pairs[first], counts

    def shares(self, pairs: np.ndarray):
        """(shard, first context, end, first pair, end) of each shard that gets any context."""
        n = len(self.vocabulary)
        v = np.searchsorted(self.vocabulary, self.cut_v)
        known = v < n
        known[known] = self.vocabulary[v[known]] == self.cut_v[known]
        w = np.where(known, np.searchsorted(self.vocabulary, self.cut_w), 0)
        ends = np.searchsorted(pairs, v * n + w)
        ends = np.concatenate([[0], ends, [len(pairs)]])
        shards = np.arange(len(self.cut_v) + 1)
        first = np.searchsorted(self.last_shard, shards, side="left")
        last = np.searchsorted(self.first_shard, shards, side="right")
        for shard in shards[first < last].tolist():
            yield shard, first[shard], last[shard], ends[shard], ends[shard + 1]


def _asked(cuts):
    def ask(batches):
        for batch in batches:
            for b in batch.to_pylist():
                own = Batch(b["begins"], b["vocabulary"], b["tokens"], b["held_out"], cuts)
                n = len(own.vocabulary)
                pairs, counts = own.pairs()
                context, word = pairs // n, own.vocabulary[pairs % n]
                totals = np.bincount(context, counts, minlength=n).astype(np.int64)
                for shard, v0, v1, p0, p1 in own.shares(pairs):
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "shard": shard,
                                "batch": b["batch"],
                                "contexts": own.vocabulary[v0:v1].tobytes(),
                                "sizes": pack(
                                    np.bincount(context[p0:p1] - v0, minlength=v1 - v0), np.int32
                                ),
                                "totals": pack(totals[v0:v1], np.int64),
                                "words": word[p0:p1].tobytes(),
                                "counts": pack(counts[p0:p1], np.int32),
                            }
                        ],
                        _schema(_QUESTIONS),
                    )

    return ask


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities above 0 as codes."""
    return np.clip(np.rint(-np.log2(p) * _PER_OCTAVE), 0, MISSING - 1).astype(np.uint16)


def _beside(totals: np.ndarray) -> np.ndarray:
    """About the code of 1 / total: beside it, codes of one count are alike, and packed well."""
    return np.rint(np.log2(np.maximum(totals, 1)) * _PER_OCTAVE).astype(np.int64)


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == MISSING, 0.0, np.exp2(codes / -_PER_OCTAVE))


class Trie:
    """A shard's contexts and the words behind them, in mapped arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        def level(name):
            own = (a.split(".") for a in arrays)
            return EliasFano({part: arrays[f"{name}.{part}"] for n, part in own if n == name})

        self.contexts, self.pointers = level("contexts"), level("pointers")
        self.vocabulary, self.successors = level("vocabulary"), level("successors")
        self.totals, self.backoffs, self.codes = (
            arrays[f"values.{name}"] for name in ("totals", "backoffs", "codes")
        )

    @staticmethod
    def arrays(contexts, sizes, totals, words, counts, discount=DISCOUNT) -> dict[str, np.ndarray]:
        """The arrays of summed counts.

        `contexts` may repeat; `sizes` says how many of `words` and `counts` belong to each, and
        `totals` how often it occurred in front of any word, also of those in other shards.
        """
        own, at = np.unique(contexts, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, totals)
        seen = counts > 0
        words, counts, behind = words[seen], counts[seen], np.repeat(at, sizes)[seen]
        vocabulary = np.unique(words)
        number = behind * len(vocabulary)
        number += np.searchsorted(vocabulary, words)
        # Arrays of a length of all pairs asked for go as soon as they are used.
        del words, behind, seen, sizes, contexts, at
        order = np.argsort(number, kind="stable")
        number, counts = number[order], counts[order]
        del order
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else number
        count = np.add.reduceat(counts, first) if len(first) else first
        number = number[first]
        del counts, first
        # Contexts of held-out texts alone are not in the model.
        known = total > 0
        context = (np.cumsum(known) - 1)[number // max(len(vocabulary), 1)]
        number %= max(len(vocabulary), 1)
        number += context * len(vocabulary)
        own, total = own[known], total[known]
        types = np.bincount(context, minlength=len(own))
        pointers = np.concatenate([[0], np.cumsum(types)])
        codes = quantised((count - discount) / total[context])
        del count, context
        levels = {
            "contexts": own,
            "pointers": pointers,
            "vocabulary": vocabulary,
            "successors": number,
        }
        arrays = {
            f"{name}.{part}": a
            for name, values in levels.items()
            for part, a in EliasFano.arrays(values).items()
        }
        backoff = discount * types / np.maximum(total, 1)
        arrays["values.totals"] = total
        arrays["values.backoffs"] = np.where(
            types > 0, quantised(np.where(types > 0, backoff, 1.0)), MISSING
        ).astype(np.uint16)
        arrays["values.codes"] = codes
        return arrays

    def context(self, hashes: np.ndarray):
        """(places, totals, codes of the weight of p(w)) of contexts; place -1 for unknown ones."""
        at, there = self.contexts.successor(hashes)
        at = np.where(there, at, -1)
        totals, backoffs = np.zeros(len(at), np.int64), np.full(len(at), MISSING, np.uint16)
        totals[there], backoffs[there] = self.totals[at[there]], self.backoffs[at[there]]
        return at, totals, backoffs

    def discounted(self, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of the discounted probabilities of words behind contexts at places `at`."""
        codes = np.full(len(at), MISSING, np.uint16)
        word, there = self.vocabulary.successor(words)
        asked = np.flatnonzero(there & (at >= 0))
        at, word = at[asked], word[asked]
        place, equal = self.successors.successor((at * self.vocabulary.n + word).astype(np.uint64))
        begin, end = self.pointers[at].astype(np.int64), self.pointers[at + 1].astype(np.int64)
        found = equal & (begin <= place) & (place < end)
        codes[asked[found]] = self.codes[place[found]]
        return codes


def _answered(folder: str, cuts, discount: float):
    def answer(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        shard = asked[0]["shard"]
        contexts, words = (
            [np.frombuffer(a[name], np.uint64) for a in asked] for name in ("contexts", "words")
        )
        sizes, counts = ([unpack(a[name], np.int32) for a in asked] for name in ("sizes", "counts"))
        totals = [unpack(a["totals"], np.int64) for a in asked]
        together = [np.concatenate(x) for x in (contexts, sizes, totals, words, counts)]
        del counts, totals
        place = f"{folder}/shard-{shard}"
        # Only the trie's arrays hold them from here.
        write_arrays(place, Trie.arrays(*(together.pop(0) for _ in range(5)), discount))
        trie = Trie(map_arrays(place))
        # A context is counted in the first of its shards.
        own = trie.contexts[np.arange(trie.contexts.n)]
        n_contexts = int((np.searchsorted(cuts[0], own, side="left") == shard).sum())
        result = []
        for a, own_contexts, own_sizes, own_words in zip(asked, contexts, sizes, words):
            at, total, backoffs = trie.context(own_contexts)
            codes = trie.discounted(np.repeat(at, own_sizes), own_words).astype(np.int64)
            codes = (codes - np.repeat(_beside(total), own_sizes)) & 0xFFFF
            result.append(
                {
                    "shard": shard,
                    "batch": a["batch"],
                    "totals": pack(total, np.int64),
                    "backoffs": pack(backoffs, np.uint16),
                    "codes": pack(codes, np.uint16),
                    "n_contexts": 0 if result else n_contexts,
                }
            )
        return pa.Table.from_pylist(result, _schema(_ANSWERS))

    return answer


def read_batch(folder: str, batch: int) -> dict:
    """A batch of the written table of batches, from its own folder."""
    store, path = open_store(f"{folder}/batch={batch}")
    files = store.get_file_info(pa.fs.FileSelector(path))
    (file,) = (f.path for f in files if f.path.endswith(".parquet"))
    with store.open_input_file(file) as source:
        return pq.ParquetFile(source).read().to_pylist()[0]


def _scored(folder: str, cuts, n_training: int, n_words: int):
    def score(table: pa.Table) -> pa.Table:
        answers = sorted(table.to_pylist(), key=lambda a: a["shard"])
        b = read_batch(folder, answers[0]["batch"])
        own = Batch(b["begins"], b["vocabulary"], b["tokens"], b["held_out"], cuts)
        n = len(own.vocabulary)
        pairs, _ = own.pairs()
        context = pairs // max(n, 1)
        count, weight, discounted = np.zeros(n, np.int64), np.zeros(n), np.zeros(len(pairs))
        for (_, v0, v1, p0, p1), a in zip(own.shares(pairs), answers, strict=True):
            count[v0:v1] = unpack(a["totals"], np.int64)
            weight[v0:v1] += probability(unpack(a["backoffs"], np.uint16))
            codes = unpack(a["codes"], np.uint16) + _beside(count)[context[p0:p1]]
            discounted[p0:p1] = probability(codes & 0xFFFF)
        weight[count == 0] = 1.0
        alone = (count + 1) / (n_training + n_words + 1)
        p = discounted + weight[context] * alone[pairs % max(n, 1)]
        of_pair = np.log10(p)[np.searchsorted(pairs, own.pair)]
        m = len(own.begins)

        def summed(values):
            return np.bincount(own.piece, values, minlength=m)

        columns = {
            "row": b["rows"],
            "id": b["ids"],
            "held_out": b["held_out"],
            "n_tokens": np.bincount(own.piece, minlength=m),
            "n_known": summed(count[own.word] > 0).astype(np.int64),
            "base_score": summed(np.log10(alone)[own.word]),
            "score": summed(of_pair),
        }
        return pa.table(columns, schema=_schema(_SCORES))

    return score


def find_cuts(sample: DataFrame, shards: int, pairs: int = SAMPLE_PAIRS):
    """Places (v, w) that cut all pairs into `shards` ranges of about one size.

    They only balance the shards, and no result depends on them. At most about `pairs` sampled pairs
    reach the driver.
    """
    n = sample.count()
    chosen = sample if n <= pairs else sample.where(
        F.pmod(F.xxhash64("v", "w"), F.lit(1 << 20)) < int((1 << 20) * pairs / n)
    )
    found = chosen.toPandas()
    v, w = (found[c].to_numpy(np.int64).view(np.uint64) for c in ("v", "w"))
    order = np.lexsort((w, v))
    at = order[(np.arange(1, shards) * len(order)) // shards] if len(order) else order
    return v[at], w[at]


def score_texts(
    documents: DataFrame,
    is_held_out: Column,
    folder: str | None = None,
    discount: float = DISCOUNT,
    batch_bytes: int = BATCH_BYTES,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the documents that are not held out, and scores all. Words are what lies
    between white space, with A-Z in lower case; a missing text is empty and has its end alone. A row
    whose `is_held_out` is missing is not held out. Every input row gives one row; texts that are
    longer than a batch are cut and their scores added up. An empty table gives no rows, other columns
    are not looked at. Tries are written to `folder`, in scratch if it is not given. Runs jobs at once.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("string").alias("id"),
        F.coalesce(is_held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    place = scratch_path(spark, "token-batches")
    tokenised = texts.mapInArrow(_tokenised(batch_bytes), _BATCHES)
    tokenised = tokenised.withColumn("batch", F.monotonically_increasing_id())
    tokenised.write.partitionBy("batch").parquet(place)
    batches = spark.read.schema(tokenised.schema).parquet(place)
    n_tokens, n_training = batches.agg(F.sum("n_tokens"), F.sum("n_training")).first()
    n_training = n_training or 0

    sample = batches.select(F.explode("sample").alias("s")).select("s.*")
    cuts = find_cuts(sample, max(math.ceil((n_tokens or 0) / shard_tokens), 1))
    tries = folder or scratch_path(spark, "tries")
    store, path = open_store(tries)
    store.create_dir(path, recursive=True)
    asked = batches.select("batch", "begins", "vocabulary", "tokens", "held_out").mapInArrow(
        _asked(cuts), _QUESTIONS
    )
    answers = asked.groupBy("shard").applyInArrow(_answered(tries, cuts, discount), _ANSWERS)
    answers = written(answers, "lm-answers")
    n_words = answers.agg(F.sum("n_contexts")).first()[0] or 0
    scores = answers.groupBy("batch").applyInArrow(
        _scored(place, cuts, n_training, n_words), _SCORES
    )
    doc_id = F.any_value("id").cast(documents.schema["doc_id"].dataType).alias("doc_id")
    return scores.groupBy("row").agg(
        doc_id,
        F.any_value("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(n_training).cast("bigint").alias("train_tokens"),
        F.sum("base_score").alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row")
