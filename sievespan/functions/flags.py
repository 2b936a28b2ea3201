"""A small table that tells which values can't be among given ones, for use before rows move."""

from pyspark.sql import Column, DataFrame, functions as F

LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 22    # a byte each, so a task gets 4 MB at most
BITMAP = 1 << 15    # bits of one bitmap of bitmap_construct_agg


def flag_table(values: DataFrame, column: str) -> bytes:
    """A byte for each cell, 1 if a value's hash falls into it.

    There are some eight cells for a value, up to ``MOST_CELLS``; beyond half a million values the table lets
    more through, and what passes it is still compared. At most ``MOST_CELLS / BITMAP`` rows come to the driver.
    """
    known = values.select(F.col(column)).distinct()
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (8 * known.count()).bit_length()))
    cell = F.pmod(F.xxhash64(column), F.lit(cells)) + 1
    maps = known.groupBy(F.bitmap_bucket_number(cell).alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    flags = bytearray(cells)
    for row in maps:
        for i, byte in enumerate(row["bits"]):
            if byte:
                at = (row["at"] - 1) * BITMAP + 8 * i
                flags[at:at + 8] = bytes(byte >> b & 1 for b in range(8))
    return bytes(flags)


def may_be_among(flags: bytes, value: Column) -> Column:
    """False only for values that the table was not made of."""
    return F.substring(F.lit(flags), F.pmod(F.xxhash64(value), F.lit(len(flags))).cast("int") + 1, 1) == F.lit(b"\x01")
