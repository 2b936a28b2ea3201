"""Long to wide with a known key list."""

from pyspark.sql import Column, DataFrame, functions as F


def pivot_filled(long: DataFrame, id_col: str, key_col: str, value: Column, keys: list[str],
                 fill=0, prefix: str = "", roster: DataFrame | None = None) -> DataFrame:
    """One column per known key with the greatest ``value``, ``fill`` where absent.

    The keys are given, so one aggregation with a conditional maximum per key
    does it: no job to find the keys, no second shuffle.
    """
    cells = [F.max(F.when(F.col(key_col) == k, value)).alias(f"{prefix}{k}") for k in keys]
    wide = long.groupBy(id_col).agg(*cells)
    if roster is not None:
        wide = roster.select(id_col).join(wide, id_col, "left")
    return wide.select(id_col, *[F.coalesce(f"`{prefix}{k}`", F.lit(fill)).alias(f"{prefix}{k}") for k in keys])
