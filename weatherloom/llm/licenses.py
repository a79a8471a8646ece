"""License scans by an exact set-similarity join of text blocks with license templates.

Tokens are pairs of neighbouring words (of a template of one word: that word), so words scattered
over a sentence are no notice. A template of L words is compared with blocks of `2 * step` words
that begin at every multiple of `step`, the least power of two that is at least L / threshold: any
run of `step` words lies whole in some block, however it is broken into lines. A template is found
in a block if at least THRESHOLD of the template's distinct tokens are among the block's. The join
is exact: tokens are ordered by how many blocks of the whole corpus hold them, rarest first, and
three filters rule out pairs without missing any that reaches the threshold:

- length: a block must hold as many template tokens as the template requires at least;
- prefix: of the template's |template| - required + 1 rarest tokens one must be in the block;
- position: the tokens that follow a shared one, in template and block, must still suffice.

Only tokens of some template can be shared, so blocks are sets of those alone.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import written
from .license_texts import TEMPLATES
from .words import Words, find_words, grams, hash_word, parts

# A changed word costs two pairs.
THRESHOLD = 0.8
# A table of templates may have this many rows; they are broadcast.
MOST_TEMPLATES = 2000

# Phrases whose consecutive words give a base label.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)


def templates_of(table: DataFrame, at_most: int = MOST_TEMPLATES) -> list[tuple[str, str]]:
    """(label, text) of a table of templates, for `license_scan`.

    Rows without a label or a text are left out. More than `at_most` rows are an error.
    """
    rows = table.select("label", "text").dropna().limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} templates")
    return sorted((r.label, r.text) for r in rows)


def template_tokens(text: str) -> tuple[int, dict[str, int]]:
    """Number of words of a template, and the hash of each of its tokens."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = find_words(data, np.array([0, len(data)]))
    n = len(words.start)
    hashes = words.hash if n == 1 else grams(words, 2)[0]
    size = min(n, 2)
    return n, {words.text(i, size): int(h) for i, h in enumerate(hashes)}


def window_step(n_words: int, threshold: float) -> int:
    """Least power of two that is at least n_words / threshold."""
    return 1 << max(math.ceil(n_words / threshold - 1e-9) - 1, 1).bit_length()


def required(size: int, threshold: float) -> int:
    """Least number of shared tokens for a template of `size` tokens."""
    return max(1, math.ceil(size * threshold - 1e-9))


# --- blocks of a batch ---------------------------------------------------------------------------


def _occurrences(words: Words, hashes: np.ndarray, single: bool):
    """(row, place in the text, words, token) of all template tokens; `single`: also of one word.

    A token is the place of its hash in `hashes`, which are sorted.
    """
    pairs, within = grams(words, 2)
    candidates = [(np.flatnonzero(within), pairs[within], 2)]
    if single:
        candidates.append((np.arange(len(words.hash)), words.hash, 1))
    firsts = words.bounds()
    found = []
    for at, own, size in candidates:
        token = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        same = hashes[token] == own if len(hashes) else np.zeros(len(own), bool)
        at, token = at[same], token[same]
        row = words.row[at]
        found.append((row, at - firsts[row], np.full(len(at), size), token))
    return [np.concatenate(columns) for columns in zip(*found)]


def _token_sets(words: Words, occurrences, step: int, n_tokens: int):
    """(block, token) pairs, sorted, each once, and the number of the first block of each text."""
    row, place, size, token = occurrences
    firsts = np.concatenate([[0], np.cumsum(np.diff(words.bounds()) // step + 1)])
    inner = place // step
    # The block that began a step earlier, if the whole token lies in it.
    outer = (place + size - 1) // step - 1
    reached = outer >= 0
    block = np.concatenate([firsts[row] + inner, (firsts[row] + outer)[reached]])
    both = np.concatenate([token, token[reached]])
    pairs = np.unique(block * max(n_tokens, 1) + both)
    return pairs // max(n_tokens, 1), pairs % max(n_tokens, 1), firsts


def _frequencies(hashes: np.ndarray, single: bool, steps: list[int]):
    def count(batches):
        """Number of blocks of this task that hold each token."""
        totals = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for _, data, offsets in parts(batch.column(0)):
                words = find_words(data, offsets)
                occurrences = _occurrences(words, hashes, single)
                for step in steps:
                    _, tokens, _ = _token_sets(words, occurrences, step, len(hashes))
                    totals += np.bincount(tokens, minlength=len(hashes))
        yield pa.record_batch(
            [pa.array(np.arange(len(hashes)), pa.int32()), pa.array(totals)], ["token", "n"]
        )

    return count


_SCAN = (
    "struct<n_words: bigint, base: array<struct<label: string, start: bigint>>,"
    " blocks: array<struct<step: int, at: bigint, tokens: array<int>>>>"
)
_BASE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_BLOCKS = pa.list_(
    pa.struct([("step", pa.int32()), ("at", pa.int64()), ("tokens", pa.list_(pa.int32()))])
)


def _phrase_places(words: Words, phrase: str) -> np.ndarray:
    """Index of the first word of every place where the phrase's words stand consecutively."""
    hashes = [hash_word(w) for w in phrase.split()]
    n = max(len(words.hash) - len(hashes) + 1, 0)
    same = words.row[:n] == words.row[len(hashes) - 1 : len(hashes) - 1 + n]
    for i, h in enumerate(hashes):
        same &= words.hash[i : i + n] == h
    places = np.flatnonzero(same)
    return np.array([p for p in places if words.text(p, len(hashes)) == phrase], np.int64)


def _scan_udf(phrases, hashes, ranks, single, classes):
    """`hashes`: sorted, of the tokens; `ranks`: rank of each token, rarest first.

    `classes`: (step, whether a rank is in a prefix, least number of tokens) by length of templates.
    """

    @F.arrow_udf(_SCAN)
    def scan(texts: pa.Array) -> pa.Array:
        n_words = np.zeros(len(texts), np.int64)
        base = [[] for _ in range(len(texts))]
        blocks = [[] for _ in range(len(texts))]
        for first, data, offsets in parts(texts):
            words = find_words(data, offsets)
            bounds = words.bounds()
            n_words[first : first + words.rows] = np.diff(bounds)
            for phrase, label in phrases:
                for at in _phrase_places(words, phrase):
                    row = words.row[at]
                    base[first + row].append({"label": label, "start": int(at - bounds[row])})
            row, place, size, token = _occurrences(words, hashes, single)
            occurrences = row, place, size, ranks[token]
            for step, prefixes, least in classes:
                owner, token, firsts = _token_sets(words, occurrences, step, len(hashes))
                own, begins, counts = np.unique(owner, return_index=True, return_counts=True)
                rare = np.bincount(
                    np.repeat(np.arange(len(own)), counts)[prefixes[token]], minlength=len(own)
                )
                for i in np.flatnonzero((counts >= least) & (rare > 0)):
                    row = int(np.searchsorted(firsts, own[i], "right")) - 1
                    held = token[begins[i] : begins[i] + counts[i]].tolist()
                    at = int(own[i] - firsts[row]) * step
                    blocks[first + row].append({"step": step, "at": at, "tokens": held})
        return pa.StructArray.from_arrays(
            [pa.array(n_words), pa.array(base, _BASE), pa.array(blocks, _BLOCKS)],
            ["n_words", "base", "blocks"],
        )

    return scan


# --- the join ------------------------------------------------------------------------------------


def _template_table(templates, rank_of, threshold):
    """(template, label, step, tokens by rank, required) for templates that have words."""
    rows = []
    for i, (label, text) in enumerate(templates):
        n_words, tokens = template_tokens(text)
        ranks = sorted(rank_of[t] for t in tokens)
        if ranks:
            step = window_step(n_words, threshold)
            rows.append((i, label, step, ranks, required(len(ranks), threshold)))
    return rows


def license_blocks(blocks: DataFrame, templates: list[tuple]) -> DataFrame:
    """(row, at, label, containment) of every block and template that reach the threshold.

    `blocks` has row, step, at and tokens (ranks in ascending order). Equal blocks are compared
    once however many texts hold them.
    """
    spark = blocks.sparkSession
    table = spark.createDataFrame(
        templates, "template int, label string, step int, words array<int>, required int"
    )
    place = F.posexplode(F.expr("slice(words, 1, size(words) - required + 1)"))
    prefixes = table.select("*", place.alias("template_at", "token"))
    distinct = blocks.select("step", "tokens").distinct()
    placed = distinct.select("step", "tokens", F.posexplode("tokens").alias("block_at", "token"))
    # As many rows as the templates have prefix tokens, a number that the caller's list bounds.
    candidates = placed.join(F.broadcast(prefixes), ["step", "token"]).where(
        (F.size("tokens") >= F.col("required"))
        & (
            F.least(
                F.size("tokens") - F.col("block_at"), F.size("words") - F.col("template_at")
            )
            + F.least("block_at", "template_at")
            >= F.col("required")
        )
    )
    shared = F.size(F.array_intersect("tokens", "words"))
    held = (
        candidates.select("step", "tokens", "template", "label", "words", "required")
        .distinct()
        .where(shared >= F.col("required"))
        .select("step", "tokens", "label", (shared / F.size("words")).alias("containment"))
        .groupBy("step", "tokens", "label")
        .agg(F.max("containment").alias("containment"))
    )
    return blocks.join(held, ["step", "tokens"]).select(
        "row", "step", "at", "label", "containment"
    )


def license_scan(
    documents: DataFrame,
    templates=TEMPLATES,
    phrases=BASE_PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, found_labels
    (sorted arrays), score, the best containment found, and places, an array of (at, n_words, label,
    containment) of every block with a template, `at` its first word from 0.

    Words are runs of letters, digits and characters beyond ASCII, in lower case. Base labels come
    from phrases, at any place; found ones from `templates`, (label, text) each, which
    `templates_of` reads from a table; templates without words are never found. A missing or empty
    text has no words. Each input row, repeated or not, gives one row; an empty table gives none;
    other columns are not looked at. Reads the texts twice, the first time for the frequencies, and
    writes a small table to scratch.
    """
    spark = documents.sparkSession
    text = F.col("text").cast("string")
    parsed = [template_tokens(t) for _, t in templates]
    hash_of = {token: h for _, tokens in parsed for token, h in tokens.items()}
    hashes = np.array(sorted(set(hash_of.values())), np.uint64)
    single = any(n == 1 for n, _ in parsed)
    steps = sorted({window_step(n, threshold) for n, _ in parsed if n})
    counted = documents.select(text.alias("text")).mapInArrow(
        _frequencies(hashes, single, steps), "token int, n bigint"
    )
    # One row per token of the templates.
    sums = {r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    by_rarity = sorted(range(len(hashes)), key=lambda i: (sums.get(i, 0), i))
    ranks = np.empty(len(hashes), np.int64)
    ranks[by_rarity] = np.arange(len(hashes))
    at_hash = {int(h): i for i, h in enumerate(hashes)}
    rank_of = {token: int(ranks[at_hash[h]]) for token, h in hash_of.items()}
    table = _template_table(templates, rank_of, threshold)
    classes = []
    for step in steps:
        prefixes, least = np.zeros(len(hashes), bool), len(hashes)
        for _, _, own, tokens, need in table:
            if own == step:
                prefixes[tokens[: len(tokens) - need + 1]] = True
                least = min(least, need)
        classes.append((step, prefixes, least))
    scan = _scan_udf(phrases, hashes, ranks, single, classes)
    scanned = written(
        documents.select("doc_id", scan(text).alias("s")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "s.n_words", "s.base", "s.blocks"
        ),
        "license-blocks",
    )
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    width = (2 * F.col("step")).alias("n_words")
    found = (
        license_blocks(blocks, table)
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_set("label")).alias("found_labels"),
            F.max("containment").alias("score"),
            F.array_sort(F.collect_list(F.struct("at", width, "label", "containment"))).alias("places"),
        )
    )
    starts = F.transform("base", lambda b: b["start"])
    labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    return scanned.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels.alias("base_labels"),
        F.coalesce("found_labels", F.array().cast("array<string>")).alias("found_labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("places", F.array()).alias("places"),
    )
