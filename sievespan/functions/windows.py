"""Sliding sequence windows."""

from pyspark.sql import DataFrame, functions as F

from ..constants import WINDOW_LENGTH

BLOCK = 4096


def blocks(df: DataFrame, key: str, text: str, size: int = BLOCK, overlap: int = 0) -> DataFrame:
    """key, _block (from 0) and _text: the text in blocks of ``size`` characters, each with ``overlap`` more of
    the next ones, so a part of up to ``overlap`` + 1 characters lies whole in the block where it begins."""
    overlapping = f"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"
    return df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(overlapping), F.lit(1))).alias("_block", "_text"))


def sliding_windows(df: DataFrame, key: str, text: str, length: int = WINDOW_LENGTH) -> DataFrame:
    """All windows of ``length`` characters: key, pos (from 1), window.

    A text shorter than ``length`` has none. A text is first cut into blocks
    that overlap by ``length - 1`` characters, one row each, so that no row's
    array of windows grows with the text.
    """
    window = f"(?s)(?=(.{{{length}}}))."
    return (
        blocks(df.where(F.length(text) >= length), key, text, BLOCK, length - 1)
        .select(key, "_block", F.posexplode(F.regexp_extract_all("_text", F.lit(window), F.lit(1)))
                .alias("_p", "window"))
        .select(key, (F.col("_block").cast("long") * BLOCK + F.col("_p") + 1).alias("pos"), "window")
    )
