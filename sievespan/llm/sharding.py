"""Shards of near equal bytes that lie close together in their metadata: a k-d tree.

A node of the tree that is to become k shards is split along the dimension in
which it is widest (its extent as a share of that of the whole table), at the
weighted median, or for an odd k at the quantile that leaves k // 2 shards on the
left, until each leaf is one shard. Weights are the bytes of the texts, and the
cut is made after the row that comes closest to the share.

A dimension is a metadata column. Its order is made strict by the crc32 of the
text, the id and the row, so equal values (one source with a third of all rows)
are split like any others, and copies of a text among them stay side by side.
Rows are sorted once for each dimension, by ranges, and get a number that rises
in that order; a median is then found in three passes over these numbers: the
partition, the block of ``BLOCK`` rows and the row where the running sum crosses
the share. Only one row for each node of a level comes to the driver. The texts
are read once and never shuffled.

Null texts have no bytes. Null values of a dimension come first. Values that are
no finite numbers add nothing to a width. Repeated ids and repeated rows are rows
of their own. If there are fewer rows than shards, some shards are empty; a
document larger than a shard's share has one for itself, and no shard is off its
share by more than the largest document.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from ..operators.numbering import dense_position
from ..session import written

DIMENSIONS = ("doc_id", "n_chars", "source", "lang")
OVERHEAD = 8      # bytes that a row takes besides its text
BLOCK = 12        # bits of a row's number in its partition that are looked at last: 4,096 rows
_IN_PARTITION = 33
_AFTER_ALL = (1 << 63) - 1


def sizes(docs: DataFrame, dimensions=DIMENSIONS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_row, _id, size, text_crc32, and by dimension its value (_v0, ...) and its place as a number (array _x)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    places = [F.col(d).cast("double") if isinstance(kinds[d], NumericType) else _place(F.col(d).cast("string")) for d in dimensions]
    return docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.array(*[F.when(F.abs(p) < float("inf"), p) for p in places]).alias("_x"),
        *[F.col(d).alias(f"_v{i}") for i, d in enumerate(dimensions)])


def _place(value: Column) -> Column:
    """The first six bytes as a number; keeps the order of strings."""
    return F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def numbered(rows: DataFrame, n: int) -> DataFrame:
    """_row, _id, size, text_crc32, _x and _r: by dimension a number that rises in its order."""
    for i in range(n):
        order = [f"_v{i}", "text_crc32", "_id", "_row"]
        rows = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn(f"_r{i}", F.monotonically_increasing_id()))
    return rows.select("_row", "_id", "size", "text_crc32", "_x", F.array(*[f"_r{i}" for i in range(n)]).alias("_r"))


def node_of(levels: list[tuple[list[int], list[int]]]) -> Column:
    """The node of a row after ``levels``, each the dimension and the last number on the left for each of its nodes."""
    if not levels:
        return F.lit(0)
    tree = F.array(*[F.struct(F.array(*[F.lit(d) for d in dims]).alias("dim"),
                              F.array(*[F.lit(c).cast("long") for c in cuts]).alias("cut")) for dims, cuts in levels])

    def down(node, level):
        right = F.get(F.col("_r"), F.get(level["dim"], node)) > F.get(level["cut"], node)
        return node * 2 + right.cast("int")

    return F.aggregate(tree, F.lit(0), down)


def _by_node(values: dict[int, int]) -> Column:
    """The value of column ``node``, null where there is none."""
    return F.get(F.array(*[F.lit(values.get(i)).cast("long") for i in range(max(values) + 1)]), F.col("node"))


def _crossing(rows: DataFrame, share: dict[int, int], before: dict[int, int]) -> dict:
    """By node the first _bin where the running sum of sizes, from ``before`` on, reaches the share, and the sums there."""
    sums = rows.groupBy("node", "_bin").agg(F.sum("size").alias("w"))
    upto = Window.partitionBy("node").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("upto", F.sum("w").over(upto) + _by_node(before))
    first = running.where(F.col("upto") >= _by_node(share)).groupBy("node").agg(
        F.min(F.struct("_bin", (F.col("upto") - F.col("w")).alias("before"), "upto")).alias("at"))
    return {r.node: r.at for r in first.collect()}


def weighted_cuts(rows: DataFrame, dims: dict[int, int], parts: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    """By node the last number on the left. ``dims``: by node its dimension; ``parts``: its bytes, and
    how many of how many shards are to lie on the left. Of two cuts equally close to the share the left one is taken."""
    share = {i: -(-total * left // k) for i, (total, left, k) in parts.items()}
    rows = rows.where(_by_node(dims).isNotNull()).select("node", "size", F.get("_r", _by_node(dims).cast("int")).alias("_n"))
    block = F.shiftright("_n", BLOCK)
    partition = _crossing(rows.withColumn("_bin", F.shiftright("_n", _IN_PARTITION)), share, dict.fromkeys(share, 0))
    rows = rows.where(F.shiftright("_n", _IN_PARTITION) == _by_node({i: at["_bin"] for i, at in partition.items()}))
    blocks = _crossing(rows.withColumn("_bin", block), share, {i: at["before"] for i, at in partition.items()})
    rows = rows.where(block == _by_node({i: at["_bin"] for i, at in blocks.items()}))
    last = _crossing(rows.withColumn("_bin", F.col("_n")), share, {i: at["before"] for i, at in blocks.items()})
    out = {}
    for i, (total, left, k) in parts.items():
        at = last[i]
        over, under = k * at["upto"] - total * left, total * left - k * at["before"]
        out[i] = at["_bin"] if over < under else at["_bin"] - 1
    return out


def grow(rows: DataFrame, n: int, shards: int) -> tuple[list[tuple[list[int], list[int]]], dict[int, int]]:
    """Levels for ``node_of``, and the shard of each node below the last one."""
    levels, leaves, whole = [], {0: shards}, None
    while max(leaves.values()) > 1:
        level = rows.withColumn("node", node_of(levels))
        found = {r.node: r for r in level.groupBy("node").agg(
            F.sum("size").alias("total"),
            *[f(F.get("_x", F.lit(i))).alias(f"{name}{i}") for i in range(n) for name, f in (("low", F.min), ("high", F.max))]
        ).collect()}
        whole = whole or found[0]
        todo = [i for i, k in leaves.items() if k > 1 and i in found]
        dims = {i: max(range(n), key=lambda d: (_width(found[i], whole, d), -d)) for i in todo}
        cuts = weighted_cuts(level, dims, {i: (found[i]["total"], leaves[i] // 2, leaves[i]) for i in todo}) if todo else {}
        levels.append(([dims.get(i, 0) for i in range(2 ** len(levels))],
                       [cuts.get(i, _AFTER_ALL) for i in range(2 ** len(levels))]))
        leaves = {j: m for i, k in leaves.items()
                  for j, m in ([(2 * i, k // 2), (2 * i + 1, k - k // 2)] if k > 1 else [(2 * i, 1)])}
    return levels, {node: shard for shard, node in enumerate(sorted(leaves))}


def _width(node, whole, dim: int) -> float:
    """Extent of a node as a share of the table's; below 0 if no row has a value."""
    low, high = node[f"low{dim}"], node[f"high{dim}"]
    if low is None:
        return -1.0
    extent = whole[f"high{dim}"] - whole[f"low{dim}"]
    return (high - low) / extent if extent > 0 else 0.0


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions=DIMENSIONS,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, size, text_crc32, shard (from 0) and slot, its place in the
    shard by id (from 0, gapless). Either the number of shards is given or the bytes that a shard is to hold."""
    narrow = written(sizes(docs, dimensions, doc_id, text), "sizes")
    rows = written(numbered(narrow, len(dimensions)), "ranked")
    total = rows.agg(F.sum("size")).first()[0]
    if shards is None:
        shards = max(1, math.ceil((total or 0) / target_bytes))
    levels, shard_of = grow(rows, len(dimensions), shards) if total else ([], {0: 0})
    placed = rows.withColumn("node", node_of(levels)).select(
        "_row", "_id", "size", "text_crc32", _by_node(shard_of).cast("int").alias("shard"))
    order = ["_id", "text_crc32", "_row"]
    return dense_position(placed, ["shard"], order).select(
        F.col("_id").alias(doc_id), "size", "text_crc32", "shard", (F.col("pos") - 1).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write ``docs`` with one folder per shard, rows in order of slot. Ids must not repeat or be null."""
    odd = placed.groupBy(doc_id).count().where((F.col("count") > 1) | F.col(doc_id).isNull())
    if not odd.isEmpty():
        raise ValueError("ids that repeat or are null can't be told apart")
    taken = [c for c in ("shard", "slot") if c in docs.columns]
    if taken:
        raise ValueError(f"columns of these names are in the way: {taken}")
    (docs.join(placed.select(doc_id, "shard", "slot"), doc_id).repartitionByRange("shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))

