"""Runs of high values along an ordered track (gaps and islands)."""

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import RUN_MIN_LENGTH, RUN_THRESHOLD
from ..functions.text import fixed_decimals


def find_runs(track: DataFrame, key: str, pos: str, value: str,
              threshold: float = RUN_THRESHOLD, min_length: int = RUN_MIN_LENGTH,
              chunk_rows: int = 1 << 16) -> DataFrame:
    """Maximal runs of consecutive positions with ``value`` > ``threshold``.

    ``pos`` is dense and unique per key. Returns key, run_start, run_end (both
    inclusive), run_length, run_max for runs of ``min_length`` or more.

    The track is cut into chunks of ``chunk_rows`` positions, so a task sorts a
    bounded part of a key however long its track is. Only runs that touch a
    chunk border, two per chunk at most, are brought together per key.
    """
    chunk = F.floor(F.col(pos) / chunk_rows)
    high = (
        track.where((F.col(value) > threshold) & ~F.isnan(value))
        .select(key, F.col(pos).alias("_pos"), F.col(value).alias("_value"), chunk.alias("_chunk"))
    )
    in_chunk = Window.partitionBy(key, "_chunk").orderBy("_pos")
    pieces = (
        high.withColumn("_island", F.col("_pos") - F.row_number().over(in_chunk))
        .groupBy(key, "_chunk", "_island")
        .agg(F.min("_pos").alias("_start"), F.max("_pos").alias("_end"), F.max("_value").alias("_max"))
    )
    at_border = (F.col("_start") % chunk_rows == 0) | ((F.col("_end") + 1) % chunk_rows == 0)
    # pieces inside a chunk stay in a lane of their own and never meet another
    lane = F.when(at_border, F.lit(-1)).otherwise(F.col("_chunk"))
    in_lane = Window.partitionBy(key, "_lane").orderBy("_start")
    opens = F.coalesce(F.col("_start") > F.lag("_end").over(in_lane) + 1, F.lit(True))
    merged = (
        pieces.withColumn("_lane", lane)
        .withColumn("_opens", opens.cast("long"))
        .withColumn("_run", F.sum("_opens").over(in_lane.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "_lane", "_run")
        .agg(F.min("_start").alias("run_start"), F.max("_end").alias("run_end"),
             F.max("_max").alias("run_max"))
    )
    length = F.col("run_end") - F.col("run_start") + 1
    return (merged.select(key, "run_start", "run_end", length.alias("run_length"), "run_max")
            .where(F.col("run_length") >= min_length))


def run_summary(roster: DataFrame, track: DataFrame, runs: DataFrame, key: str, value: str,
                empty_track: str = "PASS") -> DataFrame:
    """Per roster id: score_total, n_runs, longest_run, highest, status.

    An id passes when its track has no run. ``empty_track`` is the status of an
    id with no track rows at all: "PASS" is the lenient rule, "no_track" keeps
    such ids apart.
    """
    totals = track.groupBy(key).agg(F.sum(value).alias("score_total"))
    counts = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n_runs"),
                                   F.max("run_length").alias("longest_run"),
                                   F.max("run_max").alias("highest"))
    n_runs = F.coalesce("n_runs", F.lit(0))
    status = (F.when(F.col("_tracked").isNull(), empty_track)
              .when(n_runs == 0, "PASS").otherwise("FAIL"))
    return (
        roster.select(key)
        .join(totals.withColumn("_tracked", F.lit(True)), key, "left")
        .join(counts, key, "left")
        .select(key, F.coalesce("score_total", F.lit(0.0)).alias("score_total"),
                n_runs.alias("n_runs"), "longest_run", "highest", status.alias("status"))
    )


def run_text(runs: DataFrame, key: str, per_line: int | None = None) -> DataFrame:
    """Runs as text, ``res<start>-<end>(len=<n>,max=<x.x>%)`` joined by ``; ``.

    One line per id, ``line_no`` 0. Where a text may not fit into one row,
    ``per_line`` cuts it: a line for each stretch of so many track positions.
    """
    piece = F.concat(F.lit("res"), F.col("run_start").cast("string"), F.lit("-"),
                     F.col("run_end").cast("string"), F.lit("(len="),
                     F.col("run_length").cast("string"), F.lit(",max="),
                     fixed_decimals("run_max", 1), F.lit("%)"))
    line = (F.floor((F.col("run_start") - 1) / per_line) if per_line else F.lit(0).cast("long")).alias("line_no")
    rows = runs.select(key, line, F.struct(F.col("run_start").alias("at"), piece.alias("text")).alias("_p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["text"]), "; ")
    return rows.groupBy(key, "line_no").agg(joined.alias("run_detail"))
