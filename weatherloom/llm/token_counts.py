"""Token counts of whole texts; huge texts are encoded in overlapping chunks by many tasks.

A text of up to CHUNK characters is encoded as it is. A longer one is cut into chunks of CHUNK
characters that overlap by OVERLAP on either side, each of which is encoded with offsets on its own.
Two neighbours are spliced at a place where both have a boundary between pre-tokens (the pieces that
the tokenizer's pattern cuts before any merge) and which lies MARGIN characters inside the overlap.

Such a place is proven stable: the pattern scans from left to right and looks at most a few
characters ahead, so what the left chunk found up to there does not depend on the text beyond the
overlap; and what follows a boundary depends only on the text after it, so the right chunk, once it
shares a boundary, goes on as an encoding of the whole text would. Special strings are shorter than
MARGIN, so none is cut at such a place unnoticed. Where a pair has no such place, the overlap of that
text is widened until it has one, or until one chunk holds the whole text.

Other texts are counted by pre-token where the file is of the byte-level kind: a text is cut by the
kind's pattern, and each piece counts as the library encodes it, which is remembered. The library
says for every character that is new to a process whether the pattern sees it as the library does;
texts with a character that it sees otherwise, or with a special string, go to the library whole.
"""

import json
import os

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import scratch_path

CHUNK = 1 << 16
OVERLAP = 1 << 9
MARGIN = 32
LIMIT = 512
# Short texts go to the library in calls of about this many bytes, which bounds its memory.
_CALL_BYTES = 1 << 20

# Counts of pieces that a process remembers, in two generations of this size: when the young one is
# full it becomes the old one, whose pieces stay only if they are met again.
REMEMBERED = 100_000
# Only pieces of up to this many characters are remembered, which bounds the memory in bytes.
REMEMBERED_LENGTH = 64

# Fixed value: the pattern that byte-level pre-tokenizers cut texts by.
BYTE_LEVEL_PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

_tokenizers: dict = {}
_counters: dict = {}

_PLACES = "array<struct<at: int, before: int>>"
_CHUNK = f"struct<n_tokens: int, left: {_PLACES}, right: {_PLACES}>"
_PLACE_LIST = pa.list_(pa.struct([("at", pa.int32()), ("before", pa.int32())]))
_CHUNK_STRUCT = pa.struct(
    [("n_tokens", pa.int32()), ("left", _PLACE_LIST), ("right", _PLACE_LIST)]
)
_PIECES = "row bigint, i int, last boolean, piece string, left int, right int"
_PIECE_SCHEMA = pa.schema(
    [
        ("row", pa.int64()),
        ("i", pa.int32()),
        ("last", pa.bool_()),
        ("piece", pa.string()),
        ("left", pa.int32()),
        ("right", pa.int32()),
    ]
)


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once per process, single-threaded."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _tokenizers[path] = loaded
    return _tokenizers[path]


def _calls(texts: pa.Array):
    """Slices of a column of about _CALL_BYTES each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first, size = 0, 0
    for i, length in enumerate(lengths):
        if size and size + length > _CALL_BYTES:
            yield texts.slice(first, i - first)
            first, size = i, 0
        size += length
    if first < len(texts):
        yield texts.slice(first)


class Remembered(dict):
    """Numbers of tokens of pieces: those not in it are encoded, and kept if they are not too long."""

    def __init__(self, count):
        self.count, self.older = count, {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece) or self.count(piece)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n


class PieceCounter:
    """Numbers of tokens of texts, by piece, with the tokenizer of a .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec["pre_tokenizer"] or {}
        self.by_piece = (
            spec["normalizer"] is None
            and (cut.get("type"), cut.get("use_regex")) == ("ByteLevel", True)
            and not cut.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        self.library = tokenizer(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = regex.compile(BYTE_LEVEL_PIECES)
        self.remembered = Remembered(self.whole)
        self.known, self.other = set(map(chr, range(128))), set()

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def seen_alike(self, c: str) -> bool:
        """Whether the library cuts a text with this character as the pattern does."""
        for text in (c, f"a{c}a", f"1{c}1", f"!{c}!", f" {c} ", f"{c}{c}a", f"{c} {c}", f"'{c}"):
            cut = self.library.pre_tokenizer.pre_tokenize_str(text)
            if [text[a:b] for _, (a, b) in cut] != self.pieces.findall(text):
                return False
        return True

    def alike(self, text: str) -> bool:
        """Whether the pattern sees all characters of a text as the library does."""
        if text.isascii():
            return True
        new = set(text) - self.known - self.other
        for c in new:
            (self.known if self.seen_alike(c) else self.other).add(c)
        return not self.other or self.other.isdisjoint(text)

    def count(self, text: str) -> int:
        special = any(content in text for content in self.special)
        if not self.by_piece or special or not self.alike(text):
            return self.whole(text)
        return sum(map(self.remembered.__getitem__, self.pieces.findall(text)))


def counter(path: str) -> PieceCounter:
    """The counter of a .json file, loaded once per process."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def _count_udf(path):
    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        own, counts = counter(path), []
        for call in _calls(texts):
            counts += map(own.count, call.to_pylist())
        return pa.array(counts, pa.int64())

    return count


def boundaries(text: str, path: str) -> tuple[int, list[tuple[int, int]]]:
    """(number of tokens, places where a pre-token ends with the tokens before them).

    A place counts only next to a character that is not white space: offsets may leave out spaces.
    """
    encoded = tokenizer(path).encode(text, add_special_tokens=False)
    words, offsets, special = encoded.word_ids, encoded.offsets, encoded.special_tokens_mask
    places = []
    for i in range(len(words) - 1):
        if words[i] != words[i + 1] or special[i] != special[i + 1]:
            at = offsets[i][1]
            if not text[at - 1 : at].isspace() and offsets[i + 1][0] >= at:
                places.append((at, i + 1))
    return len(words), places


def _chunk_udf(path):
    @F.arrow_udf(_CHUNK)
    def encode(texts: pa.Array, lefts: pa.Array, rights: pa.Array) -> pa.Array:
        """`lefts` and `rights`: characters shared with the neighbours, 0 without one."""
        result = []
        for text, left, right in zip(texts.to_pylist(), lefts.to_pylist(), rights.to_pylist()):
            n, places = boundaries(text, path)
            size = len(text)
            result.append(
                {
                    "n_tokens": n,
                    "left": [
                        {"at": a, "before": b} for a, b in places if MARGIN <= a <= left - MARGIN
                    ],
                    "right": [
                        {"at": a - (size - right), "before": b}
                        for a, b in places
                        if MARGIN <= a - (size - right) <= right - MARGIN
                    ],
                }
            )
        return pa.array(result, _CHUNK_STRUCT)

    return encode


def _cut(chunk: int, overlap: int):
    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                n = max(len(text) // chunk, 1)
                for i in range(n):
                    last = i == n - 1
                    end = len(text) if last else (i + 1) * chunk + overlap
                    piece = {
                        "row": row,
                        "i": i,
                        "last": last,
                        "piece": text[max(i * chunk - overlap, 0) : end],
                        "left": 2 * overlap if i else 0,
                        "right": 0 if last else 2 * overlap,
                    }
                    yield pa.RecordBatch.from_pylist([piece], _PIECE_SCHEMA)

    return cut


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, i, last, piece, left, right): overlapping pieces of each text, dealt out evenly.

    Piece i covers [i * chunk, (i + 1) * chunk) and `overlap` characters on either side, so two
    neighbours share 2 * overlap characters. The last one takes what is too short for a piece. A text
    is cut in one pass.
    """
    pieces = texts.select("row", "text").mapInArrow(_cut(chunk, overlap), _PIECES)
    return pieces.repartition("row", "i")


def _spliced(pieces: DataFrame, path: str) -> DataFrame:
    """(row, n_tokens): sums over the pieces, null where some pair of neighbours has no splice."""
    encoded = pieces.withColumn("e", _chunk_udf(path)("piece", "left", "right"))
    encoded = encoded.select("row", "i", "last", "e.n_tokens", F.col("e.left"), F.col("e.right"))
    ordered = Window.partitionBy("row").orderBy("i")
    encoded = encoded.withColumn("next_left", F.lead("left").over(ordered))
    shared = F.array_intersect(
        F.transform("right", lambda p: p["at"]), F.transform("next_left", lambda p: p["at"])
    )
    encoded = encoded.withColumn("splice", F.get(shared, F.lit(0)))
    encoded = encoded.withColumn("previous", F.lag("splice").over(ordered))

    def before(places, at):
        return F.get(F.filter(places, lambda p: p["at"] == F.col(at)), F.lit(0))["before"]

    upto = F.when(F.col("last"), F.col("n_tokens")).otherwise(before("right", "splice"))
    skipped = F.when(F.col("i") == 0, F.lit(0)).otherwise(before("left", "previous"))
    own = encoded.select("row", (upto - skipped).cast("bigint").alias("n"))
    complete = F.count("n") == F.count(F.lit(1))
    return own.groupBy("row").agg(F.when(complete, F.sum("n")).alias("n_tokens"))


def long_text_counts(
    texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(row, n_tokens) of texts (row, text), all encoded in overlapping chunks.

    Runs a round of jobs for each width of the overlap; a round takes only the texts that the one
    before could not splice, and the last one takes them whole.
    """
    spark = texts.sparkSession
    results, rest = [], texts
    while True:
        result = scratch_path(spark, "spliced")
        _spliced(_chunks(rest, chunk, overlap), path).write.parquet(result)
        result = spark.read.schema("row bigint, n_tokens bigint").parquet(result)
        results.append(result.where("n_tokens IS NOT NULL"))
        failed = result.where("n_tokens IS NULL").select("row")
        if failed.isEmpty():
            break
        rest = rest.join(failed, "row", "left_semi")
        # A piece has to hold more of its own than it shares.
        overlap *= 8
        chunk = max(chunk, 4 * overlap)
    total = results[0]
    for result in results[1:]:
        total = total.unionByName(result)
    return total


def token_counts(
    documents: DataFrame,
    path: str,
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit, as the library counts them.

    `path` is a tokenizer file of the tokenizers library, at the same place on every executor. No
    tokens are added; special strings inside texts are the tokens they name. A missing text is empty
    and has none. Every input row gives one row, and other columns are not looked at. Short and long
    texts are told apart by length; both give what an encoding of the whole text gives. Runs jobs at
    once: counts of short texts and the long texts themselves are written to scratch.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    is_long = F.length("text") > chunk
    first = texts.select(
        "row",
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        is_long.alias("is_long"),
        F.when(is_long, F.col("text")).alias("long_text"),
        _count_udf(path)(F.when(is_long, F.lit("")).otherwise(F.col("text"))).alias("n_short"),
    )
    place = scratch_path(spark, "short-counts")
    first.write.parquet(place)
    counted = spark.read.schema(first.schema).parquet(place)
    long_texts = counted.where("is_long").select("row", F.col("long_text").alias("text"))
    n_long = long_text_counts(long_texts, path, chunk, overlap).select(
        "row", F.col("n_tokens").alias("n_long")
    )
    n_tokens = F.coalesce("n_long", "n_short")
    return counted.join(n_long, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
