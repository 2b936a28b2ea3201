"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

In each table a vector gets the signs of its products with ``bits`` random
planes. Vectors that agree in all signs of a table meet in a block, and their
cosines are computed in double precision, so no pair below the threshold is
linked. A pair with cosine c agrees in one sign with probability
1 - arccos(c) / pi; with 16 bits and 32 tables a pair of cosine 0.9 is found
with probability 0.94, one of 0.95 with 0.998. Recall is checked in the tests.
So that blocks of unlike vectors don't grow with the table, bits follow the
logarithm of the number of vectors, and tables follow the bits at the same recall.

Equal directions are one class and are compared once. A pair is counted in the
first table where it meets, and only there does it join its two ends, so links
leave a block as a row for each vector that has any. Up to ``TILE`` members a
block is one group, and its rows grow with the vectors; a larger block of m
members costs m / TILE rows for each of them, and all its cosines in any case.

Vectors that are null, empty or zero or that hold null or non-finite components
link with nothing; vectors of different lengths don't link. Repeated ids are
vectors of their own.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .blocks import dealt
from .components import connected_components

COSINE = 0.9
BITS = 16         # at least
RANDOM = 16       # vectors that share a block by chance, about, from where on bits are added
RECALL = 0.939    # of pairs at the cosine
TILE = 4096
STRIP = 256       # vectors compared at once with all others of a group
SEED = 7


def planes(dimension: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, bits * tables))


def chosen(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits and tables for so many vectors."""
    bits = max(BITS, math.ceil(math.log2(max(vectors, 1) / RANDOM)))
    met = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - met)) if met < 1 else 1


def unit_vectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of the rows of ``v``, and which of them are usable."""
    v = v.astype(np.float64)
    usable = np.isfinite(v).all(1)
    v[~usable] = 0
    largest = np.abs(v).max(1, keepdims=True)    # first scaled, so that squares neither overflow nor vanish
    usable &= largest[:, 0] > 0
    v /= np.where(largest > 0, largest, 1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1), usable


def signature_column(vector: Column, bits: int, tables: int, seed: int, dtype: str) -> Column:
    """key (digest of the direction), vector (binary, of ``dtype``) and codes (one per table); null for
    vectors that link with nothing."""

    @F.pandas_udf("struct<key: binary, vector: binary, codes: array<int>>")
    def signatures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(bits)
        for batch in batches:
            out = [(None, None, None)] * len(batch)
            sizes = batch.map(lambda x: 0 if x is None else len(x)).to_numpy()
            for size in np.unique(sizes[sizes > 0]):
                at = np.nonzero(sizes == size)[0]
                given = np.array([[np.nan if x is None else x for x in batch.iloc[i]] for i in at], np.float64)
                unit, usable = unit_vectors(given)
                signs = (unit @ planes(int(size), bits, tables, seed) > 0).reshape(len(at), tables, bits)
                codes = (signs * weights).sum(2).astype(np.int32)
                given = given.astype(dtype)
                for i, u, v, c, ok in zip(at, unit, given, codes, usable):
                    if ok:
                        out[i] = hashlib.sha256(u.tobytes()).digest(), v.tobytes(), c
            yield pd.DataFrame(out, columns=["key", "vector", "codes"])

    return signatures(vector)


def block_links(units: np.ndarray, codes: np.ndarray, weights: np.ndarray, tiles: np.ndarray, table: int,
                cosine: float, strip: int = STRIP) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of a group: how many vectors each one links with that it has not met in an
    earlier table, and the place of the first vector that it reaches by these links."""
    n = len(units)
    links, near = np.zeros(n), []
    mixed = tiles.min() != tiles.max()
    for a in range(0, n, strip):
        b = min(a + strip, n)
        own = units[a:b] @ units.T >= cosine
        own[np.arange(b - a), np.arange(a, b)] = False
        if mixed:
            own &= tiles[a:b, None] != tiles[None, :]    # pairs of one tile meet in that tile's own group
        for t in range(table):
            if not own.any():
                break
            own &= codes[a:b, t][:, None] != codes[:, t][None, :]
        links[a:b] = own @ weights
        near.append(np.packbits(own, axis=1))
    label = np.arange(n)
    while True:
        new = label.copy()
        for k, bits in enumerate(near):
            own = np.unpackbits(bits, axis=1, count=n).astype(bool)
            new[k * strip:k * strip + len(own)] = np.minimum(label[k * strip:k * strip + len(own)],
                                                             np.where(own, label[None, :], n).min(1))
        if np.array_equal(new, label):
            return links.astype(np.int64), label
        label = new


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                    bits: int | None = None, tables: int | None = None, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links`` (other vectors linked
    directly), ``component_id`` (the smallest id reachable, itself included) and
    ``kept`` (it is that one). A null id is no smallest id. Bits and tables are ``chosen`` unless given."""
    if bits is None or tables is None:
        own_bits, own_tables = chosen(vectors.count(), cosine)
        bits, tables = bits or own_bits, tables or own_tables
    dtype = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    signed = vectors.select(F.col(vec_id).alias("_id"), signature_column(F.col(vector), bits, tables, seed, dtype).alias("_s"))
    rows = written(signed.select(
        F.monotonically_increasing_id().alias("_row"), "_id", F.col("_s.key").alias("_key"),
        F.col("_s.vector").alias("_vector"), F.col("_s.codes").alias("_codes")), "signed")
    classes = written(
        rows.where("_key is not null").groupBy("_key").agg(
            F.min("_row").alias("_node"), F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_weight"),
            F.first(F.struct("_vector", "_codes")).alias("_of")).select("_key", "_node", "_least", "_weight", "_of.*"), "classes")

    entries = classes.select("_node", F.octet_length("_vector").alias("_size"),
                             F.posexplode("_codes").alias("_table", "_code"))
    own = classes.select("_node", "_vector", "_codes", "_weight")
    groups = (dealt(entries, ["_size", "_table", "_code"], "_node", tile).join(own, "_node")
              .groupBy("_size", "_table", "_code", "_a", "_b").agg(F.collect_list(F.struct(
                  "_node", "_vector", F.slice("_codes", F.lit(1), F.col("_table")).alias("_codes"), "_weight", "_own")).alias("_members")))

    @F.pandas_udf("struct<links: array<long>, first: array<long>>")
    def compared(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for nodes, given, codes, weights, tiles, at in batches:
            out = []
            for k, v, c, w, t, table in zip(nodes, given, codes, weights, tiles, at):
                unit, _ = unit_vectors(np.frombuffer(b"".join(v), dtype).reshape(len(k), -1))
                links, first = block_links(unit, np.array(c.tolist(), np.int32).reshape(len(k), -1), np.asarray(w, float), np.asarray(t), table, cosine)
                out.append((links, np.asarray(k, np.int64)[first]))
            yield pd.DataFrame(out, columns=["links", "first"])

    nodes = F.col("_members._node")
    found = written(
        groups.where(F.size("_members") > 1)
        .select(nodes.alias("_nodes"), compared(nodes, "_members._vector", "_members._codes", "_members._weight",
                                                "_members._own", "_table").alias("_found"))
        .select(F.explode(F.arrays_zip(F.col("_nodes").alias("node"), F.col("_found.links").alias("links"),
                                       F.col("_found.first").alias("first"))).alias("x"))
        .select("x.*").where("links > 0 or first <> node"), "block-links")
    links = found.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("_links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("first").alias("b")).where("a <> b"))

    known = (classes.select("_key", "_node", "_least", "_weight").join(links, "_node", "left")
             .join(parts.withColumnRenamed("node", "_node"), "_node", "left")
             .withColumn("_part", F.coalesce("component", "_node")))
    ids = known.groupBy("_part").agg(F.min("_least").alias("_component"))
    known = known.join(ids, "_part").select(
        "_key", (F.coalesce("_links", F.lit(0)) + F.col("_weight") - 1).alias("_n"), "_component")
    component = F.coalesce("_component", "_id")
    return rows.select("_id", "_key").join(known, "_key", "left").select(
        F.col("_id").alias(vec_id), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
