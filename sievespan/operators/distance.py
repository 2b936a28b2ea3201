"""Smallest distance between two point sets per key."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import NO_DISTANCE
from ..session import written

SPLIT = 4             # cells per axis that a cell is divided into
LEAF_PAIRS = 1 << 16  # point pairs up to which two cells are compared point by point
MAX_LEVEL = 26        # cells of 2^-52 of a key's extent: a double tells no smaller ones apart
SLACK = 1 - 1e-9      # a cell distance is trusted up to rounding


def min_distance_squared(points_a: DataFrame, points_b: DataFrame, keys: list[str],
                         coords: list[str], leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """Exact least squared distance between a- and b-points of each key.

    Keys with an empty side are left out. The result has ``keys`` and ``min_sq``.

    Comparing all pairs of a key is quadratic, so cells are compared instead,
    coarse ones first. One real point pair per cell pair gives an upper bound
    for the key; cell pairs that lie further apart than the bound are dropped;
    those that hold few point pairs are compared point by point; the rest is
    divided into smaller cells, and only the points of these go on. Cells follow
    the extent of their own key, so a far point of one key costs the others
    nothing. The number of rounds follows the density of the points, not their
    number, and small groups are done in the first. Points with a coordinate
    that is NULL or not finite are left out.
    """
    axes = range(len(coords))
    both = _scaled(_side(points_a, "a", keys, coords).unionByName(_side(points_b, "b", keys, coords)), keys, coords)
    found, opened, points = [], None, written(both, "points")
    for level in range(MAX_LEVEL + 1):
        width = F.col("_w") / float(SPLIT ** level)
        celled = points.withColumns({
            f"_{i}": F.floor((F.col(c) - F.col(f"_low{i}")) / width) for i, c in enumerate(coords)})
        pairs = written(_cell_pairs(celled, keys, coords, level, opened), "cell-pairs")
        bound = pairs.groupBy(*keys).agg(F.min(F.least("_d2", "_best")).alias("_bound"))
        found.append(bound.select(*keys, F.col("_bound").alias("min_sq")))

        near = pairs.join(bound, keys).where(F.col("_gap2") * SLACK < F.col("_bound"))
        small = F.col("_na") * F.col("_nb") <= leaf_pairs if level < MAX_LEVEL else F.lit(True)
        found.append(_compare_points(near.where(small), celled, keys, coords))
        opened = near.where(~small).select(
            *keys, *[f"_{s}{i}" for s in "ab" for i in axes], F.col("_bound").alias("_best"))
        if opened.isEmpty():
            break
        opened = written(opened, "open-cells")
        cells = [opened.select(*keys, F.lit(s).alias("_side"), *[F.col(f"_{s}{i}").alias(f"_{i}") for i in axes])
                 for s in "ab"]
        points = written(celled.join(cells[0].unionByName(cells[1]).distinct(),
                                     [*keys, "_side", *[f"_{i}" for i in axes]], "left_semi").select(*points.columns),
                         "open-points")
    return reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.min("min_sq").alias("min_sq"))


def _side(points: DataFrame, name: str, keys: list[str], coords: list[str]) -> DataFrame:
    # copies of a point change no distance, but would make its cell look crowded
    return (points.select(*keys, *[F.col(c).cast("double").alias(c) for c in coords]).distinct()
            .withColumn("_side", F.lit(name)))


def _scaled(points: DataFrame, keys: list[str], coords: list[str]) -> DataFrame:
    """Points with the lower corner of their key's extent and the width of a cell that holds it."""
    finite = reduce(lambda x, y: x & y, [F.abs(F.col(c)) < float("inf") for c in coords])
    real = points.where(finite)
    span = real.groupBy(*keys).agg(*[F.min(c).alias(f"_low{i}") for i, c in enumerate(coords)],
                                   *[F.max(c).alias(f"_high{i}") for i, c in enumerate(coords)])
    extent = F.greatest(*[F.col(f"_high{i}") - F.col(f"_low{i}") for i in range(len(coords))], F.lit(0.0))
    # a power of two, so that a cell's parent is its index divided by SPLIT
    width = F.when(extent > 0, F.pow(F.lit(2.0), F.floor(F.log2(extent)) + 1)).otherwise(1.0)
    corner = span.select(*keys, *[f"_low{i}" for i in range(len(coords))], width.alias("_w"))
    return real.join(corner, keys)


def _squared(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)])


def _cell_pairs(celled: DataFrame, keys: list[str], coords: list[str], level: int,
                opened: DataFrame | None) -> DataFrame:
    """Cell pairs below the ``opened`` ones, each with its point counts, the
    least distance its points can have and the distance of two of its points."""
    axes = range(len(coords))

    def cells(side):
        # first() of all coordinates in one aggregation is one row's point
        summed = (celled.where(F.col("_side") == side).groupBy(*keys, *[f"_{i}" for i in axes])
                  .agg(F.count(F.lit(1)).alias(f"_n{side}"), F.first("_w").alias(f"_w{side}"),
                       *[F.first(c).alias(f"_p{side}{i}") for i, c in enumerate(coords)]))
        summed = summed.withColumnsRenamed({f"_{i}": f"_{side}{i}" for i in axes})
        if opened is None:
            return summed
        return summed.withColumns({f"_up{side}{i}": F.floor(F.col(f"_{side}{i}") / SPLIT) for i in axes})

    if opened is None:
        joined = cells("a").join(cells("b"), keys).withColumn("_best", F.lit(None).cast("double"))
    else:
        above = opened.withColumnsRenamed({f"_{s}{i}": f"_up{s}{i}" for s in "ab" for i in axes})
        joined = (above.join(cells("a"), [*keys, *[f"_upa{i}" for i in axes]])
                  .join(cells("b"), [*keys, *[f"_upb{i}" for i in axes]]))
    width = F.col("_wa") / float(SPLIT ** level)
    gaps = [F.greatest(F.abs(F.col(f"_a{i}") - F.col(f"_b{i}")) - 1, F.lit(0)) * width for i in axes]
    d2 = _squared([F.col(f"_pa{i}") for i in axes], [F.col(f"_pb{i}") for i in axes])
    out = joined.select(*keys, *[f"_{s}{i}" for s in "ab" for i in axes], "_na", "_nb", "_best",
                        reduce(lambda x, y: x + y, [g * g for g in gaps]).alias("_gap2"), d2.alias("_d2"))
    return out.where(F.col("_best").isNull() | (F.col("_gap2") * SLACK < F.col("_best")))


def _compare_points(near: DataFrame, celled: DataFrame, keys: list[str], coords: list[str]) -> DataFrame:
    axes = range(len(coords))

    def points(side):
        return celled.where(F.col("_side") == side).select(
            *keys, *[F.col(f"_{i}").alias(f"_{side}{i}") for i in axes],
            *[F.col(c).alias(f"_x{side}{i}") for i, c in enumerate(coords)])

    # few bytes but up to LEAF_PAIRS comparisons per row, so the rows are spread
    # over all tasks; a given number of partitions is not merged again
    cells = [*keys, *[f"_{s}{i}" for s in "ab" for i in axes]]
    tasks = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d2 = _squared([F.col(f"_xa{i}") for i in axes], [F.col(f"_xb{i}") for i in axes])
    return (near.select(*cells).repartition(tasks, *cells)
            .join(points("a"), [*keys, *[f"_a{i}" for i in axes]])
            .join(points("b"), [*keys, *[f"_b{i}" for i in axes]])
            .groupBy(*keys).agg(F.min(d2).alias("min_sq")))


def min_distance(roster: DataFrame, points_a: DataFrame, points_b: DataFrame, keys: list[str],
                 coords: list[str], name: str = "distance", empty: float = NO_DISTANCE) -> DataFrame:
    """Least distance for every roster key, ``empty`` where a side has no points."""
    nearest = min_distance_squared(points_a, points_b, keys, coords)
    return (roster.select(*keys).join(nearest, keys, "left")
            .select(*keys, F.coalesce(F.sqrt("min_sq"), F.lit(empty)).alias(name)))
