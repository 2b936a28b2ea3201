"""Near-duplicates by SimHash: 64-bit fingerprints that differ in a few bits.

Fingerprints are compared exactly, in tiles, with numpy: exclusive-or and bit
counts; two tiles whose population counts lie further apart than the radius are
skipped. So that not every tile meets every other one, tiles hold fingerprints
that agree in a part of their bits: of two fingerprints within the radius, one
of ``radius + 1`` equal parts of the bits agrees, and of the bits left, again
one of ``radius + 1`` parts. Nothing is lost by that.

Repeated fingerprints are compared once. Links leave a tile as a forest, so
their number grows with the fingerprints and not with the pairs.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .blocks import tiled_groups
from .components import connected_components
from .words import hashes, spaced_words

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 1024       # fingerprints
STRIP = 256       # fingerprints compared at once with all others of a tile pair
CHUNK = 1 << 16   # shingles hashed at once


def shingles(words: list[bytes], size: int) -> tuple[int, Iterator[bytes]]:
    """Number of shingles and the shingles; the whole sequence if there are fewer words."""
    if len(words) <= size:
        return min(len(words), 1), iter([b" ".join(words)] if words else [])
    return len(words) - size + 1, map(b" ".join, zip(*(words[i:] for i in range(size))))


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """Fingerprint as a signed 64-bit number; a bit is set if more than half of the hashes have it."""
    n, parts = shingles(spaced_words(text), size)
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, CHUNK):
        h = hashes(parts if n <= CHUNK else (next(parts) for _ in range(min(CHUNK, n - begin))),
                   min(CHUNK, n - begin), SEED)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, size: int = SHINGLE) -> Column:
    """SimHash of a text as a long; null and texts without words: 0."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: simhash(t, size)).astype("int64")

    return fingerprint(F.coalesce(text, F.lit("")).cast("binary"))


def forest(prints: np.ndarray, radius: int, strip: int = STRIP) -> np.ndarray:
    """For each fingerprint the smallest one that it reaches by links among these."""
    unsigned = prints.view(np.uint64)    # of a negative number the bits of its absolute value would be counted
    order = np.argsort(np.bitwise_count(unsigned), kind="stable")
    own = unsigned[order]
    counts = np.bitwise_count(own).astype(np.int16)
    n = len(own)
    rows, columns = [], []
    for a in range(0, n, strip):
        # tiles whose counts differ beyond the radius hold no link
        end = np.searchsorted(counts, counts[min(a + strip, n) - 1] + radius, "right")
        near = np.bitwise_count(own[a:a + strip, None] ^ own[None, a:end]) <= radius
        i, j = np.nonzero(near)
        rows.append(i + a)
        columns.append(j + a)
    i, j = np.concatenate(rows), np.concatenate(columns)
    rank = np.empty(n, np.int64)
    rank[np.argsort(own.view(np.int64))] = np.arange(n)
    label = rank.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if np.array_equal(new, label):
            break
        label = new
    out = np.empty(n, np.int64)
    out[order] = np.sort(own.view(np.int64))[label]
    return out


def links(prints: DataFrame, name: str = "print", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Forest of links (a, b) between the different values of ``name``."""
    parts = radius + 1
    entries = prints.select(F.col(name).alias("p")).distinct().select(
        "p", F.posexplode(F.array(*_blocks("p", parts))).alias("_part", "_bits"))

    @F.pandas_udf("array<long>")
    def smallest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for groups in batches:
            yield groups.map(lambda g: forest(np.asarray(g, np.int64), radius))

    groups = tiled_groups(entries, ["_part", "_bits"], "p", tile)
    found = groups.select("items", smallest("items").alias("_least"))
    return (found.select(F.explode(F.arrays_zip(F.col("items").alias("a"), F.col("_least").alias("b"))).alias("l"))
            .select("l.*").where("a <> b").distinct())


def _blocks(name: str, parts: int) -> list[Column]:
    """Bits of which two fingerprints within the radius share one set: a part, and a part of the rest."""
    width = 64 // parts
    out = []
    for first in range(parts):
        rest = [b for b in range(64) if b // width != first]
        share = len(rest) // parts
        for second in range(parts):
            bits = [b for b in range(64) if b // width == first]
            bits += rest[second * share:(second + 1) * share if second < parts - 1 else None]
            mask = sum(1 << b for b in bits)
            out.append(F.col(name).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return out


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """_print, and by its component ``_component`` and ``component_id``, the smallest id, of rows of _id and _print."""
    smallest = written(prints.groupBy("_print").agg(F.min("_id").alias("_least")), "first-ids")
    found = connected_components(links(smallest, "_print", radius))
    # a component's smallest id is that of its fingerprints
    members = smallest.join(found, smallest["_print"] == found["node"], "left").select(
        "_print", "_least", F.coalesce("component", "_print").alias("_component"))
    ids = members.groupBy("_component").agg(F.min("_least").alias("component_id"))
    return members.join(ids, "_component").select("_print", "_component", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that it reaches by links, itself included.

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated ids are rows of their own; a null id is no smallest id.
    """
    prints = written(docs.select(F.col(doc_id).alias("_id"), fingerprint_column(F.col(text), size).alias("_print")),
                     "fingerprints")
    known = _components(prints, radius).select("_print", "component_id")
    return prints.join(known, "_print").select(
        F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
               radius: int = RADIUS) -> DataFrame:
    """Of each component one row, all columns: that of the smallest id, and of rows with that
    id that of the smallest text hash. Rows without an id stay. Rows that share an id and
    not the text are judged each by its own text; of rows equal in both one stays. A null text is an empty one.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    prints = written(docs.select(F.col(doc_id).alias("_id"), hashed.alias("_hash"),
                                 fingerprint_column(F.col(text), size).alias("_print")), "fingerprints")
    rows = written(prints.groupBy("_id", "_hash", "_print").agg(F.count(F.lit(1)).alias("_n"))
                   .join(_components(prints.select("_id", "_print"), radius), "_print"), "members")
    own = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    # written, so that the join has both sides plain and Spark can split a large component
    first = written(rows.groupBy("_component").agg(F.min(own).alias("_first")), "first-rows")
    judged = rows.join(first, "_component").withColumn("_gone", ~own.eqNullSafe(F.col("_first")))
    # what stays as it is needs no mark, so the marks are few and the texts move little
    marks = judged.where("_id IS NOT NULL AND (_gone OR _n > 1)").select(F.col("_id").alias("_own"), F.col("_hash").alias("_of"), "_gone")
    given = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_key"), hashed.alias("_text"))
    marked = given.join(marks, F.col("_key").eqNullSafe(F.col("_own")) & (F.col("_text") == F.col("_of")), "left")
    once = marked.where("_gone IS NULL").select("_row.*")
    return once.unionByName(marked.where("NOT _gone").dropDuplicates(["_key", "_text"]).select("_row.*"))
