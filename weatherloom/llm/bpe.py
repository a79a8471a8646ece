"""Byte-pair encoding and decoding of whole texts with a word-level vocabulary.

The vocabulary file says everything: normalisation is NFC and lower case, pieces are contractions,
runs of letters, single digits and runs of other visible characters; each is a word of byte symbols
whose last one carries the end-of-word mark. White space is dropped.

A word is held as a contiguous array of part boundaries with the rank of the merge of each part and
the next. The smallest rank is looked for by a scan, its boundary is deleted, and the two ranks
beside it are refreshed, until none is left. A scan beats any other structure on words of usual
length; words of over LONG_WORD symbols use a heap of the same ranks over linked boundaries.
"""

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD = 64
# Words whose ids a process remembers, in two generations of this size: when the young one is full it
# becomes the old one, whose words stay only if they are met again.
REMEMBERED = 80_000
# Only words of up to this many characters are remembered, which bounds the memory in bytes.
REMEMBERED_LENGTH = 64

# Words of a long text that are held at a time.
BLOCK_WORDS = 50_000

_NO_RANK = 1 << 60


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible, else 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, extra = [""] * 256, 256
    for byte in range(256):
        if byte in visible:
            symbols[byte] = chr(byte)
        else:
            symbols[byte], extra = chr(extra), extra + 1
    return symbols


def merge_word(parts: list[int], ranks: dict, merged: list[int]) -> list[int]:
    """Merge symbols (ids) of one word by lowest rank, leftmost first.

    `ranks`: rank of a pair of ids. `merged`: the id that the merge of each rank makes.
    """
    if len(parts) > LONG_WORD:
        return _merge_long_word(parts, ranks, merged)
    parts, rank_of = list(parts), ranks.get
    pairs = list(map(rank_of, zip(parts, parts[1:]), repeat(_NO_RANK)))
    while pairs:
        best = min(pairs)
        if best == _NO_RANK:
            break
        at = pairs.index(best)
        parts[at] = merged[best]
        del parts[at + 1], pairs[at]
        if at:
            pairs[at - 1] = rank_of((parts[at - 1], parts[at]), _NO_RANK)
        if at < len(pairs):
            pairs[at] = rank_of((parts[at], parts[at + 1]), _NO_RANK)
    return parts


def _merge_long_word(parts: list[int], ranks: dict, merged: list[int]) -> list[int]:
    """The same result for long words, in n log n steps."""
    parts, n = list(parts), len(parts)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = []

    def offer(i):
        j = after[i]
        if j < n:
            rank = ranks.get((parts[i], parts[j]))
            if rank is not None:
                heapq.heappush(queue, (rank, i, parts[i], parts[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        rank, i, left, right = heapq.heappop(queue)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i], parts[j] = merged[rank], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p >= 0]


class Remembered(dict):
    """Packed ids of words: those not in it are encoded, and kept if they are not too long."""

    def __init__(self, encode_word):
        self.encode_word, self.older = encode_word, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word) or array("i", self.encode_word(word)).tobytes()
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class WordBpe:
    """A vocabulary file of this kind: `encode` gives ids, `decode` joins their tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, by_bytes = spec["pre_tokenizer"]["pretokenizers"]
        known = (
            model["type"] == "BPE"
            and kinds == ["NFC", "Replace", "Lowercase"]
            and (split["type"], by_bytes["type"]) == ("Split", "ByteLevel")
            and split["invert"]
            and split["behavior"] == "Removed"
            and not by_bytes["use_regex"]
            and not by_bytes["add_prefix_space"]
            and spec["decoder"] is None
        )
        if not known:
            raise ValueError(f"{path}: not a vocabulary of words with ends")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.first = [vocabulary[s] for s in _byte_symbols()]
        self.last = [vocabulary[s + end] for s in _byte_symbols()]
        self.ranks = {
            (vocabulary[a], vocabulary[b]): rank
            for rank, (a, b) in reversed(list(enumerate(model["merges"])))
        }
        self.merged = [vocabulary[a + b] for a, b in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.at_special = regex.compile(f"({'|'.join(map(regex.escape, special))})")
        self.tokens = [""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for token, i in [*vocabulary.items(), *special.items()]:
            self.tokens[i] = token
        self.remembered = Remembered(self.encode_word)
        self.path, self._library, self.assigned = path, None, set()

    def all_assigned(self, text: str) -> bool:
        """Whether this Python's Unicode tables know all characters of a text."""
        new = set(text) - self.assigned
        unknown = {c for c in new if unicodedata.category(c) == "Cn"}
        self.assigned |= new - unknown
        return not unknown

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special strings.

        What a character newer than Python's Unicode tables is (a letter or not, its lower case) only
        the library's tables can say; texts with such characters are cut by its own rules.
        """
        if text.isascii() or self.all_assigned(text):
            return self.pieces.findall(self.normalized(text))
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def word_blocks(self, text: str) -> Iterator[list[str]]:
        """`words` of a text, some at a time if it is long."""
        if len(text) <= BLOCK_WORDS or not (text.isascii() or self.all_assigned(text)):
            yield self.words(text)
            return
        words = (found[0] for found in self.pieces.finditer(self.normalized(text)))
        while block := list(islice(words, BLOCK_WORDS)):
            yield block

    def normalized(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # Each character on its own: a whole string's lower case has a final sigma.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        parts = [*map(self.first.__getitem__, data[:-1]), self.last[data[-1]]]
        return merge_word(parts, self.ranks, self.merged)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers, one after the other."""
        packed = []
        for i, piece in enumerate(self.at_special.split(text)):
            if i % 2:
                packed.append(array("i", [self.special[piece]]).tobytes())
            else:
                for words in self.word_blocks(piece):
                    packed.append(b"".join(map(self.remembered.__getitem__, words)))
        return b"".join(packed)

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> str:
        """Tokens of the ids, joined by spaces, as the file names no decoder. Unknown ids are skipped."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if 0 <= i < len(tokens)])


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """The vocabulary of a file, once per process."""
    return WordBpe(path)


def encode_udf(path: str):
    """Texts to arrays of ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        # What the batch before left is given back, as other workers share the executor's memory.
        pa.default_memory_pool().release_unused()
        flat, offsets = array("i"), [0]
        for text in texts:
            flat.frombytes(bpe.packed(text.as_py() or ""))
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.asarray(flat)))

    # Else a plan that uses the ids twice, as decoding them does, would encode each text twice.
    return encode.asNondeterministic()


def decode_udf(path: str):
    """Arrays of ids to texts."""

    @F.arrow_udf("string")
    def decode(arrays: pa.Array) -> pa.Array:
        bpe = load(path)
        pa.default_memory_pool().release_unused()
        data, offsets = bytearray(), [0]
        for ids in arrays:
            if ids.is_valid:
                data += bpe.decode(ids.values.to_numpy(zero_copy_only=False).tolist()).encode()
            offsets.append(len(data))
        valid = arrays.is_valid().to_numpy(zero_copy_only=False)
        buffers = (
            pa.array(offsets, pa.int32()).buffers()[1],
            pa.py_buffer(data),
            pa.py_buffer(np.packbits(valid, bitorder="little")),
        )
        return pa.StringArray.from_buffers(len(arrays), *buffers)

    return decode


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """`documents` with the column `ids`: the token ids of the whole text, without added tokens.

    `path` is a vocabulary file, at the same place on every executor. Special strings in a text are
    the tokens they name. A missing text is empty and has no ids. A column `ids` is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.withColumn("ids", encode_udf(path)(text))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with the column `decoded`: the tokens of `ids` as text, special ones included.

    No array of ids gives no text, an empty one an empty text; an array's own ids must not be missing.
    Repeated rows stay, an empty table stays empty, and a column `decoded` is replaced.
    """
    return encoded.withColumn("decoded", decode_udf(path)("ids"))
