"""Choosing, renaming and checking ids."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import listed_ids


def resolve_ids(universe: DataFrame | None, wanted: DataFrame | None = None,
                extra: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Distinct ids to work on.

    With a universe, ``wanted`` narrows it and unknown ids drop out; without
    one, ``wanted`` is the list itself. ``extra`` ids are always added, also
    those outside the universe. The ids come as a set; see ``ordered_ids``.
    """
    if universe is None:
        given = wanted if wanted is not None else extra
        if given is None:
            return SparkSession.active().createDataFrame([], f"`{key}` string")
        ids = given.select(key)
    elif wanted is None:
        ids = universe.select(key)
    else:
        ids = universe.select(key).join(wanted.select(key), key, "left_semi")
    if extra is not None:
        ids = ids.unionByName(extra.select(key))
    return ids.distinct()


def ordered_ids(universe: DataFrame | None, wanted: DataFrame | None = None, extra: DataFrame | None = None,
                key: str = "id", pos: str = "pos") -> DataFrame:
    """(key, part, pos): the same ids, once each, with what orders them.

    The universe keeps its own order, a list without a universe comes as given,
    and extra ids follow at the end. ``pos`` is a column of every input.
    """
    if universe is None:
        base = wanted if wanted is not None else extra
    else:
        base = universe if wanted is None else universe.join(wanted.select(key), key, "left_semi")
    if base is None:
        return SparkSession.active().createDataFrame([], f"`{key}` string, part int, `{pos}` long")
    ids = base.select(key, F.lit(0).alias("part"), pos)
    if extra is not None:
        ids = ids.unionByName(extra.select(key, F.lit(1).alias("part"), pos))
    return ids.groupBy(key).agg(F.min(F.struct("part", pos)).alias("_at")).select(key, "_at.part", F.col("_at")[pos].alias(pos))


def ids_from_list(spark, text: str, key: str = "id") -> DataFrame:
    """Ids of a comma-separated parameter."""
    return spark.range(1).select(F.explode(listed_ids(F.lit(text))).alias(key))


def pick_targets(report: DataFrame, passed: Column, wanted: DataFrame | None = None,
                 key: str = "id") -> DataFrame:
    """Rows that passed, or exactly the wanted ones whatever their verdict."""
    if wanted is None:
        return report.where(passed)
    return report.join(wanted.select(key).distinct(), key, "left_semi")


def remap_ids(df: DataFrame, mapping: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Replace ids that the mapping names; others keep theirs.

    Of several new ids for an old one the greatest counts, so no row multiplies.
    """
    names = mapping.groupBy(F.col(old).alias(key)).agg(F.max(new).alias("_new"))
    return (df.join(names, key, "left")
            .withColumn(key, F.coalesce("_new", key)).select(*df.columns))


def missing_ids(requested: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requested ids the table does not have."""
    return requested.select(key).distinct().join(table.select(key), key, "left_anti")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row that breaks a rule; NULL counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def require_none(found: DataFrame, what: str) -> None:
    """Raise if there is any violation; the message shows a few of them."""
    some = [str(r[0]) for r in found.limit(5).collect()]
    if some:
        raise ValueError(f"{what}: {', '.join(some)}")
