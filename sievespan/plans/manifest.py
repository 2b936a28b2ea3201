"""What a run was made of, so that its outputs can be repeated and its checkpoints trusted.

Each table has a fingerprint that any change of a row changes, whatever order the
rows come in. The mark of a stage is a digest of the roster and of the stages so far
with their evidence, in order: two runs that agree in it have the same survivors
after that stage. A run with the marks of the one before it is that run started
again; it has the same number and overwrites what the other one wrote.
"""

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

STAGE_TABLES = {"01": "pose", "03": "aggregation", "04": "allergenicity", "05": "toxicity"}
MANIFEST = "run long, place int, stage string, mark string"


def fingerprint(table: DataFrame, leave_out: tuple[str, ...] = ()) -> str:
    """Number of rows and two sums of their hashes; columns count by name."""
    columns = [F.to_json(f.name) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")
               for f in sorted(table.schema.fields, key=lambda f: f.name) if f.name not in leave_out]
    names = ",".join(sorted(c for c in table.columns if c not in leave_out))
    # a null is skipped by the hash, so it also says which values there are
    there = F.concat_ws("", *[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    hashes = [F.sum(F.xxhash64(F.lit(seed), there, *columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return f"{names}:" + ":".join(str(v) for v in table.agg(F.count(F.lit(1)), *hashes).first())


def marks(roster: DataFrame, tables: dict[str, DataFrame], order: list[str], replay: bool) -> list[str]:
    """The mark of each stage of ``order``; ``tables`` has the evidence by stage."""
    mark, out = hashlib.sha256(f"{fingerprint(roster, ('roster_pos',))} {replay}".encode()).hexdigest(), []
    for stage in order:
        mark = hashlib.sha256(f"{mark} {stage} {fingerprint(tables[stage])}".encode()).hexdigest()
        out.append(mark)
    return out


def begin_run(spark: SparkSession, folder: str, order: list[str], own: list[str]) -> int:
    """The number of the run: that of the last one if it had the same marks, else the next. It is written down at once."""
    rows = list(enumerate(zip(order, own)))
    last = _last_run(spark, folder)
    if last and [(p, (s, m)) for p, s, m in last[1]] == rows:
        return last[0]
    run = last[0] + 1 if last else 1
    (spark.createDataFrame([(p, s, m) for p, (s, m) in rows], "place int, stage string, mark string").coalesce(1)
     .withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(f"{folder}/manifest"))
    return run


def _last_run(spark: SparkSession, folder: str) -> tuple[int, list[tuple[int, str, str]]] | None:
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    run = rows.agg(F.max("run")).first()[0]
    if run is None:
        return None
    return run, [(r["place"], r["stage"], r["mark"]) for r in rows.where(F.col("run") == run).orderBy("place").collect()]


def sign(spark: SparkSession, folder: str, stage: str, mark: str) -> None:
    """Note what the saved ids of a stage were made of; call it when they are written."""
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/signed/{stage}")


def fits(spark: SparkSession, folder: str, stage: str, mark: str) -> bool:
    """Whether the saved ids of a stage were made of the same tables in the same order."""
    try:
        return [r["value"] for r in spark.read.text(f"{folder}/signed/{stage}").collect()] == [mark]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
