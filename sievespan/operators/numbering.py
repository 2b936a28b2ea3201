"""Dense row numbers that do not put a whole group into one task."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written


def dense_position(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """1-based row number per key in ``order``, which must be unique per key.

    ``row_number()`` over the key would sort a hot key, or with no keys the
    whole table, in a single task. Here the rows are range-partitioned by
    (keys, order), which cuts a hot key into several partitions, and numbered
    inside their partition. What is added up across partitions is one count
    per (key, partition). The partitioned rows are written to the shared
    folder, because both the counts and the rows must see the same cuts.
    """
    sort = [*keys, *order]
    cut = written(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "positions",
    )
    chunks = cut.groupBy(*keys, "_chunk").agg(F.min("_row").alias("_first"),
                                              F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy(*keys).orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = chunks.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_chunk").alias("_in_chunk"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = reduce(lambda a, b: a & b,
                  [cut[k].eqNullSafe(starts[f"_{k}"]) for k in keys],
                  cut["_chunk"] == starts["_in_chunk"])
    pos = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return cut.join(starts, same).select(*[cut[c] for c in df.columns], pos.alias(name))


def batch_number(pos: str, size: int):
    """Batch of a 1-based position: ``size`` rows each, counted from 1."""
    return (F.floor((F.col(pos) - 1) / size) + 1).cast("long")


def rank_ascending(df: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Rank by ``order`` within groups, ties settled by the later order columns."""
    return dense_position(df, groups, order, name)
