"""The ordered funnel as columns: who is out, where, and what still waits.

Each gate depends on the candidate alone, so the stage-by-stage loop is the
same as taking the first gate in the order that a candidate does not pass.
All of it is row-local once the flags are joined.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.gates import Gate, add_gate_flags, pass_column, pending_column

RETAINED, ELIMINATED, PENDING = "retained", "eliminated", "pending"


def check_order(order: list[str], known: list[str]) -> None:
    unknown = sorted(set(order) - set(known))
    if unknown:
        raise ValueError(f"unknown stages in order: {unknown}")


def _first_stop(order: list[str]) -> Column:
    """Index in ``order`` of the first stage not passed, or its length."""
    stops = [F.when(~F.col(pass_column(s)), F.lit(i)) for i, s in enumerate(order)]
    return F.coalesce(*stops, F.lit(len(order)))


def add_outcome(flags: DataFrame, order: list[str], replay: bool = False) -> DataFrame:
    """Add ``outcome`` and ``at_stage`` (NULL for those retained).

    With ``replay`` missing evidence eliminates at every stage, also at those
    that would otherwise wait for it.
    """
    waits = F.coalesce(
        *[F.when(~F.col(pass_column(s)), F.col(pending_column(s))) for s in order], F.lit(False))
    stop = F.coalesce(*[F.when(~F.col(pass_column(s)), F.lit(s)) for s in order],
                      F.lit(None).cast("string"))
    out = flags.withColumn("at_stage", stop)
    retained = F.col("at_stage").isNull()
    if replay:
        outcome = F.when(retained, RETAINED).otherwise(ELIMINATED)
    else:
        outcome = F.when(retained, RETAINED).when(waits, PENDING).otherwise(ELIMINATED)
    return out.withColumn("outcome", outcome)


def run_funnel(roster: DataFrame, gates: list[Gate], order: list[str] | None = None,
               key: str = "id", replay: bool = False) -> DataFrame:
    """Roster with gate flags, ``outcome`` and ``at_stage``."""
    order = order or [g.stage for g in gates]
    check_order(order, [g.stage for g in gates])
    return add_outcome(add_gate_flags(roster, gates, key), order, replay)


def funnel_audit(frame: DataFrame, key: str = "id", names: dict[str, str] | None = None) -> DataFrame:
    """One row per eliminated candidate: its id and the stage that did it."""
    out = frame.where(F.col("outcome") == ELIMINATED)
    stage = F.col("at_stage")
    if names:
        for code, name in names.items():
            stage = F.when(F.col("at_stage") == code, name).otherwise(stage)
    return out.select(key, stage.alias("eliminated_at_stage"))


def count_columns(order: list[str]) -> list[Column]:
    """Input, pass, fail and pending of each stage as conditional counts over a frame with outcomes."""
    stop, waits, counts = _first_stop(order), F.col("outcome") == PENDING, []
    for i, _ in enumerate(order):
        here = stop == i
        counts += [
            F.count_if(stop >= i).alias(f"_in{i}"),
            F.count_if(stop > i).alias(f"_ok{i}"),
            F.count_if(here & ~waits).alias(f"_no{i}"),
            F.count_if(here & waits).alias(f"_wait{i}"),
        ]
    return counts


COUNTS = "stage_no int, stage string, input_count long, pass_count long, fail_count long, pending_count long"


def count_rows(found: dict[str, int], order: list[str]) -> list[tuple]:
    """Rows of ``COUNTS`` from the values of ``count_columns``, as an Observation has them."""
    return [(i + 1, s, *(int(found.get(f"_{name}{i}") or 0) for name in ("in", "ok", "no", "wait"))) for i, s in enumerate(order)]


def funnel_counts(frame: DataFrame, order: list[str]) -> DataFrame:
    """Input, pass, fail and pending per stage, from one aggregation.

    The per-stage numbers are conditional counts, so a single row of partial
    sums per task is all that is shuffled.
    """
    one = frame.agg(*count_columns(order))
    stages = F.array(*[
        F.struct(F.lit(i + 1).alias("stage_no"), F.lit(s).alias("stage"),
                 F.col(f"_in{i}").alias("input_count"), F.col(f"_ok{i}").alias("pass_count"),
                 F.col(f"_no{i}").alias("fail_count"), F.col(f"_wait{i}").alias("pending_count"))
        for i, s in enumerate(order)
    ])
    return one.select(F.inline(stages))


def stage_inputs(frame: DataFrame, order: list[str], extra: dict[str, list], key: str = "id") -> DataFrame:
    """(stage, key): the ids that each stage looks at, those that are alive before it and the ``extra`` ones of a
    stage, which are looked at whatever came before and need not be in the roster."""
    before, rows = F.lit(True), []
    for s in order:
        rows.append(F.struct(F.lit(s).alias("stage"), before.alias("alive")))
        before = before & F.col(pass_column(s))
    ids = frame.select(key, F.explode(F.array(*rows)).alias("_s")).where("_s.alive").select("_s.stage", key)
    named = [(s, i) for s in order for i in extra.get(s, [])]
    if named:
        ids = ids.unionByName(frame.sparkSession.createDataFrame(named, ids.schema)).distinct()
    return ids


def pending_evidence(roster: DataFrame, evidence: DataFrame, key: str = "id") -> DataFrame:
    """Roster rows with no evidence row at all; a failing row counts as covered."""
    return roster.join(evidence.select(key), key, "left_anti")


def alive_after(frame: DataFrame, order: list[str], stage: str, key: str = "id") -> DataFrame:
    """Ids that passed ``stage`` and every stage before it."""
    done = order[: order.index(stage) + 1]
    keep = F.lit(True)
    for s in done:
        keep = keep & F.col(pass_column(s))
    return frame.where(keep).select(key)


def resume_after(roster: DataFrame, gates: list[Gate], order: list[str], stage: str,
                 alive: DataFrame, key: str = "id") -> DataFrame:
    """Run the stages after ``stage`` on the ids a saved checkpoint holds."""
    rest = order[order.index(stage) + 1:]
    left = roster.join(alive.select(key), key, "left_semi")
    todo = [g for g in gates if g.stage in rest]
    return run_funnel(left, todo, rest, key) if rest else add_outcome(left, [])
