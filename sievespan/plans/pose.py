"""Pose check: two distances between regions of a peptide and its receptor."""

from pyspark.sql import DataFrame, functions as F

from ..constants import (C_TERMINAL, N_TERMINAL, NO_DISTANCE, PEPTIDE_CHAINS, POSE_CUTOFF,
                         RECEPTOR_CHAIN, RECEPTORS, REGION_BOUNDARIES)
from ..functions.text import fixed_decimals
from ..operators.distance import min_distance_squared
from ..session import written

STRUCTURE = ["id", "receptor"]
COORDS = ["x", "y", "z"]


def structures(atoms: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """Per structure: peptide chain, chain length and region boundaries.

    Structures without a peptide chain or of an unknown length are left out.
    ``boundaries`` (chain_length, ecd_end, tm1_start, deep_start, tmd_end) takes the place of the receptors' own.
    """
    has = [F.bool_or(F.col("chain") == c) for c in PEPTIDE_CHAINS]
    chain = F.coalesce(*[F.when(h, F.lit(c)) for h, c in zip(has, PEPTIDE_CHAINS)])
    per = atoms.groupBy(*STRUCTURE).agg(
        chain.alias("peptide_chain"),
        F.count_if(F.col("chain") == RECEPTOR_CHAIN).alias("chain_length"))
    if boundaries is None:
        boundaries = F.broadcast(atoms.sparkSession.createDataFrame(
            REGION_BOUNDARIES, "chain_length long, ecd_end int, tm1_start int, deep_start int, tmd_end int"))
    return per.where(F.col("peptide_chain").isNotNull()).join(boundaries, "chain_length")


def tag_regions(atoms: DataFrame, known: DataFrame) -> DataFrame:
    """Atoms that take part in a check, with ``region`` and ``side``."""
    res, chain = F.col("resnum"), F.col("chain")
    peptide = chain == F.col("peptide_chain")
    receptor = chain == RECEPTOR_CHAIN
    region = (
        F.when(peptide & res.between(*N_TERMINAL), "tmd")
        .when(peptide & res.between(*C_TERMINAL), "deep")
        .when(receptor & res.between(F.col("deep_start"), F.col("ecd_end")), "deep")
        .when(receptor & (res >= F.col("tm1_start")) & (res < F.col("tmd_end")), "tmd"))
    return (atoms.join(known, STRUCTURE)
            .select(*STRUCTURE, *COORDS, region.alias("region"),
                    F.when(peptide, "peptide").otherwise("receptor").alias("side"))
            .where(F.col("region").isNotNull()))


def pose_check(atoms: DataFrame, cutoff: float = POSE_CUTOFF, boundaries: DataFrame | None = None) -> DataFrame:
    """Both distances and verdicts of every structure that can be checked."""
    atoms = written(atoms, "atoms")      # read three times; structures would be parsed anew for each
    known = structures(atoms, boundaries)
    tagged = tag_regions(atoms, known)
    return two_region_gate(known, tagged.where(F.col("side") == "peptide"),
                           tagged.where(F.col("side") == "receptor"), STRUCTURE, COORDS,
                           {"tmd": "nterm", "deep": "deep"}, cutoff) \
        .withColumnsRenamed({"d_nterm": "d_nterm_tmd", "d_deep": "d_cterm_deep", "both_pass": "pose_pass"})


def pose_results(checked: DataFrame, ids: DataFrame | None = None, receptors: list[str] | None = None,
                 order: str = "roster_pos") -> DataFrame:
    """The pose table: distances with two decimals, verdicts as 0 and 1.

    ``ids`` (with an ``order`` column) and ``receptors`` choose structures and put
    them in order; without ids they come by id.
    """
    wanted = receptors or list(RECEPTORS)
    place = F.array_position(F.array(*[F.lit(r) for r in wanted]), F.col("receptor"))
    rows = checked.where(F.col("receptor").isin(wanted)).withColumn("_place", place)
    if ids is None:
        rows = rows.orderBy("id", "_place")
    else:
        rows = rows.join(ids.select("id", F.col(order).alias("_order")), "id").orderBy("_order", "_place")
    return rows.select(
        "id", "receptor", *[fixed_decimals(d, 2).alias(d) for d in ("d_nterm_tmd", "d_cterm_deep")],
        *[F.col(v).cast("int").alias(v) for v in ("nterm_pass", "deep_pass", "pose_pass")])


def two_region_gate(roster: DataFrame, points_a: DataFrame, points_b: DataFrame, keys: list[str],
                    coords: list[str], regions: dict[str, str], cutoff: float) -> DataFrame:
    """``d_<name>`` and ``<name>_pass`` per region, and ``both_pass``.

    Both point sets carry a ``region`` column; a region with an empty side has
    the distance that stands for none, and so fails. Verdicts use the unrounded
    distance.
    """
    nearest = min_distance_squared(points_a, points_b, [*keys, "region"], coords)
    wide = nearest.groupBy(*keys).agg(*[
        F.sqrt(F.min(F.when(F.col("region") == r, F.col("min_sq")))).alias(f"d_{name}")
        for r, name in regions.items()])
    out = roster.select(*keys).join(wide, keys, "left")
    for name in regions.values():
        out = out.withColumn(f"d_{name}", F.coalesce(f"d_{name}", F.lit(NO_DISTANCE)))
    both = F.lit(True)
    for name in regions.values():
        out = out.withColumn(f"{name}_pass", F.col(f"d_{name}") <= cutoff)
        both = both & F.col(f"{name}_pass")
    return out.withColumn("both_pass", both)
