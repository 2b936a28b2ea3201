"""Token ids packed into rows of equal length.

A document's ids, with an end mark, are cut into pieces of at most ``length``
ids. Pieces are packed best-fit decreasing: in order of falling length each one
goes into the fullest row that still has room, which a segment tree over the
free room of the rows finds. What a row holds is told by ``cu_seqlens``, the
cumulative lengths of its segments; positions start at 0 in every segment.

Packing needs pieces together, so documents are dealt by hash to shards of
about ``SHARD_BYTES`` of text, whatever their source. No shard grows with the
input or with a document: a document's pieces are dealt one by one.

Nothing is lost: ``unpacked`` gives back each row's ids. A null text counts as
empty; an empty text is its end mark alone. Pieces carry the number of their row,
so rows with equal or null ids, also wholly equal rows, are documents of their own.
An id may be of any type that a text can be cast to; it goes through the workers as text.
"""

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import SPACE

LENGTH = 2048
SHARD_BYTES = 1 << 20
LONG_SPACE = re.compile(f"[{SPACE}]{{1000,}}")
PACKED = ("shard long, row int, doc_ids array<string>, doc_rows array<long>, pieces array<int>, "
          "cu_seqlens array<int>, n_tokens int, token_ids binary, position_ids binary")


@cache
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_dtype(vocabulary: int) -> str:
    """Little-endian unsigned integers, of 16 bits where that is enough."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Room:
    """How many rows have so much free room: a segment tree over 0 to ``length``."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def smallest(self, need: int) -> int:
        """The least room of at least ``need`` that some row has, -1 if none has."""
        tree, i = self.tree, need + self.leaves
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows as lists of places in ``lengths``; none of these exceeds ``length``."""
    room, open_rows, rows = Room(length), [[] for _ in range(length + 1)], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        free = room.smallest(n)
        if free < 0:
            free, row = length, len(rows)
            rows.append([])
        else:
            room.change(free, -1)
            row = open_rows[free].pop()
        rows[row].append(i)
        room.change(free - n, 1)
        open_rows[free - n].append(row)
    return rows


def pieces(docs: DataFrame, ranks: bytes, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
           length: int = LENGTH) -> DataFrame:
    """doc_row (a number of the row), doc_id (as text), piece (from 0), n_tokens and token_ids (binary) of every piece of every row."""
    dtype = token_dtype(end_id + 1)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(ranks, pattern)
        for batch in batches:
            out = []
            for row, doc, text_of in zip(batch["doc_row"], batch["doc_id"], batch["text"]):
                ids = np.append(tokens(own, text_of), end_id).astype(dtype)
                out += [(row, doc, k, min(length, len(ids) - at), ids[at:at + length].tobytes())
                        for k, at in enumerate(range(0, len(ids), length))]
            yield pd.DataFrame(out, columns=["doc_row", "doc_id", "piece", "n_tokens", "token_ids"])

    given = docs.select(F.monotonically_increasing_id().alias("doc_row"), F.col(doc_id).cast("string").alias("doc_id"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    return given.mapInPandas(cut, "doc_row long, doc_id string, piece int, n_tokens int, token_ids binary")


def tokens(own: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text. Long runs of white space overflow the stack of the library's
    pattern matcher, so they are handed over as the words that they are: all of a run
    but its last letter, or all of it at the end of the text."""
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += own.encode_ordinary(text[at:run.start()])
        out += own._encode_single_piece(text[run.start():end])
        at = end
    return np.array(out + own.encode_ordinary(text[at:]), np.int64)


def pack(docs: DataFrame, ranks: bytes, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
         length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed rows: shard and row, the documents (their ids and the numbers of their rows) and
    pieces in order, their cumulative lengths (from 0), the number of ids, and ``length`` ids
    and positions as binary, filled up with end marks at position 0."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = total // shard_bytes + 1
    dtype = token_dtype(end_id + 1)

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_row", "piece"]).reset_index(drop=True)
        sizes = group["n_tokens"].to_numpy()
        ids, docs_of, parts = group["token_ids"].tolist(), group["doc_id"].to_numpy(object), group["piece"].to_numpy()
        rows_of = group["doc_row"].to_numpy()
        out = []
        for row, held in enumerate(best_fit_decreasing(sizes, length)):
            ends = np.cumsum(sizes[held])
            row_ids = np.full(length, end_id, dtype)
            row_ids[:ends[-1]] = np.frombuffer(b"".join(ids[i] for i in held), dtype)
            places = np.zeros(length, dtype)
            places[:ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - sizes[held], sizes[held])
            out.append((group["shard"].iloc[0], row, docs_of[held], rows_of[held], parts[held], np.append(0, ends), int(ends[-1]),
                        row_ids.tobytes(), places.tobytes()))
        return pd.DataFrame(out, columns=["shard", "row", "doc_ids", "doc_rows", "pieces", "cu_seqlens", "n_tokens",
                                          "token_ids", "position_ids"])

    cut = pieces(docs, ranks, pattern, end_id, doc_id, text, length)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_row", "piece"), F.lit(shards)))
    kind = docs.schema[doc_id].dataType.simpleString()
    return dealt.groupBy("shard").applyInPandas(packed, PACKED).withColumn("doc_ids", F.col("doc_ids").cast(f"array<{kind}>"))


def unpacked(rows: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, doc_row and token_ids (binary) of every document, end marks included; ``width`` bytes an id."""
    at = F.explode(F.arrays_zip("doc_ids", "doc_rows", "pieces", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("at"),
                                F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("to")))
    parts = rows.select(at.alias("s"), "token_ids").select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_rows").alias("doc_row"), F.col("s.pieces").alias("piece"),
        F.substring("token_ids", F.col("s.at") * width + 1, (F.col("s.to") - F.col("s.at")) * width).alias("ids"))
    return parts.groupBy("doc_id", "doc_row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p")).select(
        "doc_id", "doc_row", _joined(F.col("p.ids")).alias("token_ids"))


def _joined(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


def write_packed(rows: DataFrame, path: str) -> None:
    """The id matrix with its segment lengths and positions as Parquet: one part per
    task, a matrix row per row, in order of shard and row."""
    rows.repartitionByRange("shard").sortWithinPartitions("shard", "row").write.parquet(path)
