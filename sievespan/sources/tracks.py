"""Per-residue score tracks, one whitespace-separated file per candidate."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import tokens


def profile_lines(lines: DataFrame, keys: list[str], line: str, min_tokens: int = 6) -> DataFrame:
    """keys and ``tok`` (words of the line) for lines with ``min_tokens`` words or more."""
    return (lines.select(*keys, tokens(line).alias("tok"))
            .where(F.size("tok") >= min_tokens))


def read_tracks(spark: SparkSession, paths) -> DataFrame:
    """(id, res, aa, agg) of every residue; the id is the file's name.

    The header line goes out by its first word. ``res`` gives the order: a
    distributed read has no row order of its own.
    """
    lines = spark.read.text(paths).select(
        F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("id"), "value")
    rows = profile_lines(lines, ["id"], "value")
    return (
        rows.select("id", F.col("tok")[0].try_cast("int").alias("res"), F.col("tok")[1].alias("aa"),
                    F.col("tok")[5].try_cast("double").alias("agg"))
        .where(F.col("res").isNotNull())
    )
