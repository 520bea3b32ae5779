"""Byte-level BPE by a published vocabulary: texts to token ids and back.

Merging keeps a segment tree over the ranks of adjacent pairs of a word, sixteen children to a node. The root is the
lowest rank, and among equal ranks the leftmost pair; a merge changes three leaves, each in a logarithmic walk, until no
pair can be merged. So a word without blanks of a million bytes costs n log n, not n squared.
"""

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quoteflow.llm.common import with_column_in_batches

# Fixed value: the split pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A word this short is remembered. Two memories of so many words each: when the new one is full, the old one is dropped
# and the new one becomes the old. Bounded, and the results are the same.
CACHED_SIGNS = 40
CACHED_WORDS = 500_000
# The rank of what is no pair, and a leaf above every pair wherever it stands.
NONE = 1 << 24
OUT = 1 << 80
# Children of a node of the tree.
FAN = 16


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a vocabulary file: itself if printable, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(byte) if byte in shown else chr(next(spare)) for byte in range(256)]


class Vocabulary:
    """Ids of the bytes, mergeable pairs with rank and merged id, bytes of every id, and the added tokens."""

    def __init__(self, described: dict):
        signs = byte_signs()
        of_sign = {sign: byte for byte, sign in enumerate(signs)}
        ids = described["model"]["vocab"]
        if max(ids.values()) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.byte_ids = [ids[sign] for sign in signs]
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(described["model"]["merges"]):
            self.pairs.setdefault(ids[left] << 16 | ids[right], rank)
            self.merged.append(ids[left + right])
        self.added = {token["content"]: token["id"] for token in described["added_tokens"]}
        everything = {**ids, **self.added}
        self.pieces = [b""] * (max(everything.values()) + 1)
        for token, number in everything.items():
            known = all(sign in of_sign for sign in token)
            self.pieces[number] = bytes(of_sign[sign] for sign in token) if known else token.encode()


def read_description(path: str) -> dict:
    """What a vocabulary file says of ids, merges and added tokens."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    model = described["model"]
    return {"model": {"vocab": model["vocab"], "merges": model["merges"]}, "added_tokens": described["added_tokens"]}


def read_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_description(path))


def merge_node(ids: list[int], rank_of, merged: list[int]) -> list[int]:
    """The ids of a word whose pairs fit one node: its children are the ranks themselves, in place order."""
    ranks = [rank_of(one << 16 | other, NONE) for one, other in zip(ids, ids[1:])]
    while ranks and (best := min(ranks)) < NONE:
        i = ranks.index(best)
        ids[i] = new = merged[best]
        del ids[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank_of(new << 16 | ids[i + 1], NONE)
        if i:
            ranks[i - 1] = rank_of(ids[i - 1] << 16 | new, NONE)
    return ids


def merge_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Token ids of one word."""
    ids = [vocabulary.byte_ids[byte] for byte in word]
    n = len(ids)
    if n < 2:
        return ids
    rank_of, merged = vocabulary.pairs.get, vocabulary.merged
    if n <= FAN:
        return merge_node(ids, rank_of, merged)
    shift = n.bit_length()
    limit, mask = NONE << shift, (1 << shift) - 1
    # A leaf is the rank of a pair, then its place, so that the least leaf is the leftmost pair of lowest rank.
    leaves = [rank_of(ids[i] << 16 | ids[i + 1], NONE) << shift | i for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[at : at + FAN]) for at in range(0, len(below), FAN)])
    top, tall = levels[-1], len(levels) > 1
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := min(top)) < limit:
        i = best & mask
        j = following[i]
        k = following[j]
        ids[i] = new = merged[best >> shift]
        ids[j] = -1
        following[i] = k
        if k < n:
            before[k] = i
            leaves[i] = rank_of(new << 16 | ids[k], NONE) << shift | i
            leaves[j] = OUT
        else:
            leaves[i] = OUT
        p = before[i]
        if p >= 0:
            leaves[p] = rank_of(ids[p] << 16 | new, NONE) << shift | p
        if tall:
            for at in {i, min(j, n - 2), max(p, 0)}:
                for below, above in zip(levels, levels[1:]):
                    at //= FAN
                    above[at] = min(below[at * FAN : at * FAN + FAN])
    return [one for one in ids if one >= 0]


class Memory(dict):
    """What a function gives for short strings, in two generations of bounded size."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHED_SIGNS:
                return value
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """From a text to its ids, as bytes of 32-bit numbers, so that what is remembered is nothing to garbage collection.

    Where a single blank stands between two signs that are no white space, no word of the split pattern crosses it, and
    the blank belongs to what follows. So a text is cut at its blanks and each chunk is split by itself, remembered with
    its ids. A text with other white space at a blank is split by the pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(WORDS).findall
        self.letters = regex.compile(r"\p{L}+").fullmatch
        self.crossing = regex.compile(r"\s | \s|^ | $|\s$").search
        self.words = Memory(lambda word: array("i", merge_word(word.encode(), vocabulary)).tobytes())
        self.chunks = Memory(self.chunk)
        self.added = {token: array("i", [number]).tobytes() for token, number in vocabulary.added.items()}
        self.specials = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")")
            if vocabulary.added else None
        )

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def chunk(self, signs: str) -> bytes:
        if self.letters(signs):
            return self.words.make(" " + signs)
        return self.by_pattern(" " + signs)

    def plain(self, text: str) -> bytes:
        if self.crossing(text):
            return self.by_pattern(text)
        first, *rest = text.split(" ")
        return self.by_pattern(first) + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.specials is None or not self.specials.search(text):
            return np.frombuffer(self.plain(text), np.int32)
        parts = [self.added.get(part) or self.plain(part) for part in self.specials.split(text) if part]
        return np.frombuffer(b"".join(parts), np.int32)


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Every column of `df` and the token ids of its text in `into` (array of int; replaces a column of that name).

    Null and empty texts have no ids. Strings of added tokens in a text become those tokens. Rows are worked on one by
    one, so ties, repeated rows and an empty table need nothing; there is no shuffle. The vocabulary is read on the
    driver and broadcast: its size is that of a published file, not of the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_description(vocabulary_path))

    def task():
        encoder = Encoder(Vocabulary(shared.value))

        def ids_of(texts):
            found = [encoder.encode(one) for one in texts]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))

        return ids_of

    return with_column_in_batches(df, text, into, T.ArrayType(T.IntegerType()), task)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Every column of `df` and the text of its ids in `into`, added tokens included.

    Bytes that are no UTF-8 become U+FFFD; null or empty ids give the empty text; an id outside the vocabulary is an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_description(vocabulary_path))

    def task():
        pieces = Vocabulary(shared.value).pieces

        def texts_of(lists):
            flat = lists.values.to_numpy()
            edges = lists.offsets.to_numpy()
            return [
                b"".join(map(pieces.__getitem__, flat[low:high].tolist())).decode("utf-8", "replace")
                for low, high in zip(edges, edges[1:])
            ]

        return texts_of

    return with_column_in_batches(df, ids, into, T.StringType(), task, arrow=True)


def default_vocabulary(spark: SparkSession | None = None) -> str:
    """Where the installed package of public vocabularies keeps the byte-level one."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
