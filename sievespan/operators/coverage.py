"""Binder counts and the coverage of binders by scores."""

from pyspark.sql import DataFrame, functions as F

from ..constants import BINDER_CUTOFF, RISK_THRESHOLD
from ..functions.flags import flag_table, may_be_among

TESTED, INCOMPLETE, NOT_SCREENED = "tested", "incomplete", "not_screened"


def binder_count(roster: DataFrame, pairs: DataFrame, key: str, rank: str,
                 cutoff: float = BINDER_CUTOFF, name: str = "n_binders") -> DataFrame:
    """Rows with ``rank`` <= cutoff per roster id, 0 for ids without any.

    ``rank`` may be text: empty and ``-`` stand for no value.
    """
    number = F.col(rank).try_cast("double")
    counted = pairs.where(number <= cutoff).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return (roster.select(key).join(counted, key, "left")
            .select(key, F.coalesce("_n", F.lit(0)).alias(name)))


def binders(pairs: DataFrame, key: str, item: str, rank: str,
            cutoff: float = BINDER_CUTOFF) -> DataFrame:
    """Distinct (item, key) with ``rank`` < cutoff; unlike the count, not <=."""
    return pairs.where(F.col(rank).try_cast("double") < cutoff).select(item, key).distinct()


def coverage(bridge: DataFrame, scores: DataFrame, key: str, item: str, score: str,
             risk: float = RISK_THRESHOLD) -> DataFrame:
    """Roll item scores up to ids: n_scored, min_score, n_below, status, verdict.

    An item may have several scores and belong to several ids. ``status`` is
    incomplete when any item of the id has no score, and then ``verdict`` is
    NULL; else it is true when no score lies below ``risk``. Ids without items
    do not appear.

    The scores of an item are summed up first, so the join carries one row per
    (id, item) whatever the number of scores.
    """
    per_item = scores.groupBy(item).agg(
        F.count(score).alias("_n"), F.min(score).alias("_min"),
        F.count_if(F.col(score) < risk).alias("_below"))
    joined = bridge.select(key, item).join(per_item, item, "left")
    n_below = F.coalesce(F.sum("_below"), F.lit(0))
    rolled = joined.groupBy(key).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_scored"),
        F.min("_min").alias("min_score"),
        n_below.alias("n_below"),
        F.when(F.bool_or(F.col("_n").isNull()), INCOMPLETE).otherwise(TESTED).alias("status"))
    verdict = F.when(F.col("status") == TESTED, F.col("n_below") == 0)
    return rolled.withColumn("verdict", verdict)


def screened_coverage(roster: DataFrame, screened: DataFrame, rolled: DataFrame, key: str) -> DataFrame:
    """Coverage for every roster id, telling "no binder" from "never screened".

    A screened id without items has nothing to flag and passes; an id that was
    not screened has status not_screened and no verdict.
    """
    seen = screened.select(key).distinct().withColumn("_seen", F.lit(True))
    joined = roster.select(key).join(seen, key, "left").join(rolled, key, "left")
    clean = F.col("status").isNull() & F.col("_seen").isNotNull()
    return joined.select(
        key,
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "min_score",
        F.coalesce("n_below", F.lit(0)).alias("n_below"),
        F.when(clean, TESTED).otherwise(F.coalesce("status", F.lit(NOT_SCREENED))).alias("status"),
        F.when(clean, True).otherwise(F.col("verdict")).alias("verdict"))


def located_windows(windows: DataFrame, scored: DataFrame, key: str, item: str) -> DataFrame:
    """Scored items found in an id's windows: key, pos and the item's columns.

    Items as long as the windows are matched by equality, which needs no
    search inside the sequences. Windows that no item can equal are dropped before any move.
    """
    flags = flag_table(scored, item)
    return (windows.where(may_be_among(flags, F.col("window"))).withColumnRenamed("window", item)
            .join(scored, item).select(key, "pos", *scored.columns))


def combined_score(immunogenicity: str, median_rank: str):
    """Combined score: 0.4 x immunogenicity + 0.6 x median percentile rank."""
    return F.col(immunogenicity) * 0.4 + F.col(median_rank) * 0.6


def hybrid_score(model: str, positive: str, negative: str):
    """Hybrid toxicity score: model and motif scores added, at least 0."""
    return F.greatest(F.lit(0.0), F.col(model) + F.col(positive) + F.col(negative))
