"""Byte-level BPE: text to token ids and back.

A word is merged with a priority queue of merge ranks over a doubly linked list
of symbols. Entries of the queue whose pair has changed since are stale and
skipped. Decoding concatenates the byte strings of the vocabulary.

Rows are independent: a null text counts as empty, an empty text has no ids,
repeated rows get the same ids, columns other than the text pass through.
"""

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

# Unicode White_Space, spelled out because the shorthand of re differs
SPACE = "\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
                      rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
# white space before a space: a run of white space reaches over the space
RUN = re.compile(f"[{SPACE}] ")
CACHED = 600_000         # words kept per worker, twice; a full cache starts anew
LONGEST_CACHED = 64     # letters


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(printable))
    return [letters[b] for b in range(256)]


class Codec:
    """Ids of one vocabulary file (byte-level BPE, no normaliser)."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        # by id of the left symbol: id of the right one -> rank; by rank: id of the merged symbol
        self.rank, self.into = [{} for _ in range(max(vocab.values()) + 1)], []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[a]][vocab[b]] = rank
            self.into.append(vocab[a + b])
        byte_of = {c: b for b, c in enumerate(letters)}
        bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.special = {}
        for token in spec["added_tokens"]:
            self.special[token["content"]] = token["id"].to_bytes(4, "little")
            bytes_of[token["id"]] = token["content"].encode()
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bare: dict[str, bytes] = {}      # ids by word
        self.spaced: dict[str, bytes] = {}    # by what follows the space that begins a word

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        rank_of, into, push, pop = self.rank, self.into, heapq.heappush, heapq.heappop
        ids = [self.first[b] for b in word]
        n = len(ids)
        bits = n.bit_length()
        # ranks[i]: rank of the pair that starts at symbol i, -1 if it doesn't merge
        ranks = [rank_of[a].get(b, -1) for a, b in zip(ids, ids[1:])]
        # rank and place in one number: the lowest rank comes first, the leftmost of equals
        queue = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        if not queue:
            return ids
        heapq.heapify(queue)
        ranks.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        place = (1 << bits) - 1
        while queue:
            top = pop(queue)
            i, rank = top & place, top >> bits
            if ranks[i] != rank:
                continue    # stale: one of the two symbols has changed since
            j = after[i]
            after[i] = k = after[j]
            ids[i] = own = into[rank]
            ids[j] = ranks[j] = -1
            if k < n:
                before[k] = i
                ranks[i] = rank = rank_of[own].get(ids[k], -1)
                if rank >= 0:
                    push(queue, rank << bits | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                ranks[h] = rank = rank_of[ids[h]].get(own, -1)
                if rank >= 0:
                    push(queue, rank << bits | h)
        return [i for i in ids if i >= 0]

    def _word(self, word: str) -> bytes:
        """Ids of one word, which may begin with a space."""
        spaced = word[0] == " "
        kept, key = (self.spaced, word[1:]) if spaced else (self.bare, word)
        got = kept.get(key)
        if got is None:
            got = array("I", self.merge(word.encode())).tobytes()
            if len(key) <= LONGEST_CACHED:
                if len(kept) >= CACHED:
                    kept.clear()
                kept[key] = got
        return got

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._word, WORDS.findall(text)))

    def _section(self, text: str) -> bytes:
        """Text without special tokens. Where no white space stands before a
        space, words never reach over a space, so that the parts between
        spaces can be looked up one by one."""
        first, *rest = text.split(" ")
        if "" in rest or RUN.search(text):
            return self._plain(text)
        word, known, out = self._word, self.spaced.get, [self._plain(first)]
        for piece in rest:
            got = known(piece)
            if got is None:
                if piece.isalpha():
                    got = word(" " + piece)
                elif piece[-1] in ".,|" and piece[:-1].isalpha():
                    out.append(word(" " + piece[:-1]))
                    got = word(piece[-1])
                else:
                    got = self._plain(" " + piece)
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.split:
            return self._section(text)
        return b"".join(self.special.get(part) or self._section(part)
                        for part in self.split.split(text) if part)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def codec(tokenizer_json: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(tokenizer_json)


def encode_column(text: Column, tokenizer_json: str) -> Column:
    """Token ids of a text as binary: little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def bpe_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(tokenizer_json)
        for texts in batches:
            yield texts.map(own.encode)

    return bpe_encode(F.coalesce(text, F.lit("")))


def decode_column(ids: Column, tokenizer_json: str) -> Column:
    """Text of token ids; bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def bpe_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(tokenizer_json)
        for ids_of in batches:
            yield ids_of.map(own.decode)

    return bpe_decode(F.coalesce(ids, F.lit(b"")))


def encode(docs: DataFrame, tokenizer_json: str, text: str = "text", name: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in column ``name`` (replaced if there)."""
    return docs.withColumn(name, encode_column(F.col(text), tokenizer_json))


def round_trip(docs: DataFrame, tokenizer_json: str, text: str = "text") -> DataFrame:
    """``docs`` with columns ``token_ids`` (binary) and ``decoded`` (string), the ids decoded again."""

    @F.pandas_udf("struct<ids: binary, text: string>")
    def bpe_round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(tokenizer_json)
        for texts in batches:
            ids = texts.map(own.encode)
            yield pd.DataFrame({"ids": ids, "text": ids.map(own.decode)})

    coded = docs.withColumn("_coded", bpe_round_trip(F.coalesce(F.col(text), F.lit(""))))
    return (coded.withColumn("token_ids", F.col("_coded.ids"))
            .withColumn("decoded", F.col("_coded.text")).drop("_coded"))


def n_tokens(ids: Column) -> Column:
    """How many ids a binary column holds."""
    return (F.octet_length(ids) / 4).cast("long")
