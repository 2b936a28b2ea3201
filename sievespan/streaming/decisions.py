"""Decisions that follow the evidence: only ids with a changed verdict are decided anew.

The state holds for each id whether it is in the roster, and the verdict of each
stage with the number of the intake batch that brought it. Ids lie in ``BUCKETS``
rows of the state by hash, as a call of Python for each id costs far more than its
decision. A batch of verdicts decides the ids that it names and no others, and
reads and writes the buckets that they lie in. What changes goes to a log, with the
decision before, so counts are kept by adding differences, and neither the roster
nor the evidence is read again. The result is that of ``plans.funnel`` on the
whole tables.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.gates import Gate, pass_column, pending_column
from ..plans import funnel
from ..session import settings
from .intake import STORE, has_batches

ROSTER = -1      # stands for the stage in rows that say that an id is in the roster
MISSING = -1
BUCKETS = 1024
STATE = "known array<boolean>, verdicts array<array<int>>, batches array<array<long>>"
WHOLE = ("tinyint", "smallint", "int", "bigint")
DECISION = "was_outcome string, was_stage string, outcome string, at_stage string"


def verdicts(rows: DataFrame, gates: list[Gate], order: list[str], key: str = "id", roster: bool = False) -> DataFrame:
    """(key, stage, batch, passed) for each of the gates, from changed rows of their evidence.

    ``rows`` has the number of the intake batch in ``batch``, which the folders of an intake log give.
    Rows of the roster also say that their id belongs to it; their gates are those without evidence.
    """
    found = [F.struct(F.lit(order.index(g.stage)).alias("stage"), F.coalesce(g.passes, F.lit(False)).cast("int").alias("passed"))
             for g in gates]
    if roster:
        found.append(F.struct(F.lit(ROSTER).alias("stage"), F.lit(1).alias("passed")))
    return rows.select(key, F.col("batch").cast("long").alias("batch"), F.explode(F.array(*found)).alias("_v")).select(
        key, F.col("_v.stage").alias("stage"), "batch", F.col("_v.passed").alias("passed"))


def follow(changes: DataFrame, order: list[str], on_missing: dict[str, str], log: str, counts: str, checkpoint: str,
           key: str = "id", replay: bool = False) -> None:
    """Decide all ids that ``changes``, a stream of ``verdicts``, names; then stop.

    ``on_missing``  by stage what a missing verdict means (fail, pending or pass); fail if not named
    ``log``         gets a folder per batch: key, decision before (null for a new id) and now, of ids whose decision changed
    ``counts``      gets a folder per batch: how many ids have which decision
    """
    spark = changes.sparkSession
    n, rule = len(order), [on_missing.get(s, "fail") for s in order]
    names, missing, roster, waiting = list(order), MISSING, ROSTER, not replay
    retained, eliminated, pending = funnel.RETAINED, funnel.ELIMINATED, funnel.PENDING
    columns = [key, *[c.split()[0] for c in DECISION.split(", ")]]
    kind = changes.schema[key].dataType.simpleString()
    whole = kind in WHOLE
    if not whole and kind != "string":
        raise ValueError(f"ids are whole numbers or text, not {kind}")

    def decided(found):
        for stage, verdict, on in zip(names, found, rule):
            if verdict == 1 or (verdict == missing and on == "pass"):
                continue
            return (pending if waiting and verdict == missing and on == "pending" else eliminated), stage
        return retained, None

    def update(bucket, batches: Iterator, state):
        import pandas as pd

        ids, known, held, seen = map(list, state.get) if state.exists else ([], [], [], [])
        place, before = {i: at for at, i in enumerate(ids)}, {}
        for rows in batches:
            for i, stage, batch, passed in zip(rows["_key"].tolist(), rows["stage"].tolist(), rows["batch"].tolist(), rows["passed"].tolist()):
                i = int(i) if whole and i is not None else i
                at = place.setdefault(i, len(ids))
                if at == len(ids):
                    ids.append(i), known.append(False), held.append([missing] * n), seen.append([-1] * n)
                if at not in before:
                    before[at] = decided(held[at]) if known[at] else (None, None)
                    held[at], seen[at] = list(held[at]), list(seen[at])
                if stage == roster:
                    known[at] = True
                elif batch >= seen[at][stage]:
                    held[at][stage], seen[at][stage] = passed, batch
        state.update((ids, known, held, seen))
        changed = [(ids[at], *was, *decided(held[at])) for at, was in before.items() if known[at] and decided(held[at]) != was]
        if changed:
            yield pd.DataFrame(changed, columns=columns, dtype=object)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        changed = spark.read.schema(batch.schema).parquet(f"{log}/batch={number}")
        parts = [changed.where("was_outcome IS NOT NULL").select(
                     F.col("was_outcome").alias("outcome"), F.col("was_stage").alias("at_stage"), F.lit(-1).cast("long").alias("n")),
                 changed.select("outcome", "at_stage", F.lit(1).cast("long").alias("n"))]
        if number:
            parts.append(spark.read.schema(parts[0].schema).parquet(f"{counts}/batch={number - 1}"))
        total = parts[0]
        for part in parts[1:]:
            total = total.unionByName(part)
        (total.groupBy("outcome", "at_stage").agg(F.sum("n").alias("n")).where("n <> 0").coalesce(1)
         .write.mode("overwrite").parquet(f"{counts}/batch={number}"))

    # as text, since whole numbers with a null among them would reach Python as doubles
    decisions = (changes.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"), F.col(key).cast("string").alias("_key"),
                                "stage", "batch", "passed").groupBy("_bucket")
                 .applyInPandasWithState(update, f"`{key}` {kind}, {DECISION}", f"`{key}` array<{kind}>, {STATE}", "update", "NoTimeout"))
    with settings(spark, STORE):
        query = (decisions.writeStream.outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", checkpoint).foreachBatch(append).start())
        query.awaitTermination()


def current_decisions(spark: SparkSession, checkpoint: str, order: list[str], on_missing: dict[str, str],
                      replay: bool = False) -> DataFrame:
    """The key, a flag and a pending flag per stage, ``outcome`` and ``at_stage`` of every id of the roster, from the state."""
    buckets = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    held = buckets.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in buckets.columns]))).where("known")
    flags = held
    for i, stage in enumerate(order):
        verdict, on = F.get("verdicts", F.lit(i)), on_missing.get(stage, "fail")
        flags = (flags.withColumn(pass_column(stage), (verdict == 1) | ((verdict == MISSING) & F.lit(on == "pass")))
                 .withColumn(pending_column(stage), (verdict == MISSING) & F.lit(on == "pending")))
    return funnel.add_outcome(flags.drop("known", "verdicts", "batches"), order, replay)


def last_counts(spark: SparkSession, counts: str, checkpoint: str) -> DataFrame:
    """How many ids have which decision after the last batch; no rows before a first one."""
    schema = "outcome string, at_stage string, n long"
    if not has_batches(spark, checkpoint):
        return spark.createDataFrame([], schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.read.schema(schema).parquet(f"{counts}/batch={max(int(x) for x in names if x.isdigit())}")


def stage_counts(decided: DataFrame, order: list[str]) -> DataFrame:
    """The funnel's counts per stage from (outcome, at_stage, n)."""
    stop: Column = F.coalesce(*[F.when(F.col("at_stage") == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    rows = decided.select(stop.alias("_stop"), (F.col("outcome") == funnel.PENDING).alias("_waits"), "n")

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).cast("long")

    one = rows.agg(F.array(*[
        F.struct(F.lit(i + 1).alias("stage_no"), F.lit(s).alias("stage"), total(F.col("_stop") >= i).alias("input_count"),
                 total(F.col("_stop") > i).alias("pass_count"),
                 total((F.col("_stop") == i) & ~F.col("_waits")).alias("fail_count"),
                 total((F.col("_stop") == i) & F.col("_waits")).alias("pending_count"))
        for i, s in enumerate(order)]).alias("s"))
    return one.select(F.inline("s"))
