"""Comparing the items of a block with each other, whatever the block's size."""

from pyspark.sql import DataFrame, functions as F


def dealt(entries: DataFrame, keys: list[str], item: str, tile: int) -> DataFrame:
    """The rows of ``entries`` dealt to groups in which all pairs of a block's items meet.

    A block is the rows with equal ``keys``; ``item`` is what it holds, without
    repeats. Blocks of one item are dropped. A block of up to ``tile`` items is
    one group. A larger one is dealt into tiles by hash, and each pair of tiles
    is a group, so no group grows with its block. A group is a value of
    (``keys``, _a, _b); _own is an item's tile, and a pair of one tile belongs
    to the group where _a equals _b.
    """
    sizes = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tiles = F.ceil(F.col("_n") / tile).cast("int")
    own = F.pmod(F.xxhash64(item, F.lit("tile")), F.col("_tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    return (entries.join(sizes, keys).withColumn("_tiles", tiles).withColumn("_own", own)
            .withColumn("_other", other)
            .withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")})
            .drop("_n", "_tiles", "_other"))


def tiled_groups(entries: DataFrame, keys: list[str], item: str, tile: int) -> DataFrame:
    """The items of each group of ``dealt`` as an array ``items``."""
    return (dealt(entries, keys, item, tile).groupBy(*keys, "_a", "_b")
            .agg(F.collect_list(item).alias("items")).where(F.size("items") > 1).select("items"))
