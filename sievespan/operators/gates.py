"""Evidence tables as boolean gates on a roster."""

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F

from .latest import latest_per_key

ON_MISSING = ("fail", "pending", "pass")


@dataclass(frozen=True)
class Gate:
    """One stage: an evidence table and the predicate a candidate must meet.

    evidence    table with the roster's key, or None when ``passes`` reads
                roster columns only
    passes      predicate over the evidence columns; NULL counts as a fail
    on_missing  verdict for a candidate without an evidence row
    order       columns that say which of several rows of a key is the last;
                leave empty when the key is unique
    """

    stage: str
    passes: Column
    evidence: DataFrame | None = None
    on_missing: str = "fail"
    order: tuple[str, ...] = ()

    def __post_init__(self):
        if self.on_missing not in ON_MISSING:
            raise ValueError(f"on_missing must be one of {ON_MISSING}: {self.on_missing!r}")


GATES = "stage string, evidence string, passes string, on_missing string, last_by array<string>"


def gates_from(table: DataFrame, evidence: dict[str, DataFrame], roster: DataFrame, key: str = "id") -> list[Gate]:
    """Gates that a table names: by stage the evidence table (null for columns of the roster), the predicate as SQL
    text, what a missing row means (null: fail) and the columns that say which row of a key is the last (null: none).

    Everything is checked against the tables' schemas before anything runs: unknown evidence, columns that are not
    there, predicates that are no booleans and tables without the key are named, all of them at once.
    A table has a row per stage and comes to the driver; the stages come in its order of names.
    """
    found, wrong = [], []
    for row in table.orderBy("stage").collect():
        stage, name, text = row["stage"], row["evidence"], row["passes"]
        if name is not None and name not in evidence:
            wrong.append(f"{stage}: there is no evidence {name!r}")
            continue
        rows = roster if name is None else evidence[name]
        last_by = row["last_by"] or []
        absent = [c for c in [key, *last_by] if c not in rows.columns]
        if absent:
            wrong.append(f"{stage}: {name or 'the roster'} has no column {', '.join(absent)}")
        if row["on_missing"] is not None and row["on_missing"] not in ON_MISSING:
            wrong.append(f"{stage}: on_missing is {row['on_missing']!r}")
        try:
            kind = rows.select(F.expr(text).alias("passes")).schema["passes"].dataType.simpleString()
            if kind != "boolean":
                wrong.append(f"{stage}: {text} is no condition but {kind}")
        except (AnalysisException, ParseException) as error:
            wrong.append(f"{stage}: {text}: {error.getCondition()} {error.getMessageParameters().get('objectName', '')}".rstrip())
        found.append((stage, name, text, row["on_missing"] or "fail", tuple(last_by)))
    if len({f[0] for f in found}) < len(found):
        wrong.append("a stage is named twice")
    if wrong:
        raise ValueError("; ".join(wrong))
    return [Gate(stage, F.expr(text), None if name is None else evidence[name], on_missing, last_by)
            for stage, name, text, on_missing, last_by in found]


def pass_column(stage: str) -> str:
    return f"{stage}_pass"


def pending_column(stage: str) -> str:
    return f"{stage}_pending"


def add_gate_flags(roster: DataFrame, gates: list[Gate], key: str = "id") -> DataFrame:
    """Add ``<stage>_pass`` and ``<stage>_pending`` for every gate.

    Gates that read the same evidence table share one join, and all joins use
    the same key, so the roster is shuffled once at most.
    """
    names = [g.stage for g in gates]
    if len(set(names)) != len(names):
        raise ValueError(f"stage named twice: {names}")
    out = roster
    for gate in gates:
        if gate.evidence is None:
            out = (out.withColumn(pass_column(gate.stage), F.coalesce(gate.passes, F.lit(False)))
                      .withColumn(pending_column(gate.stage), F.lit(False)))
    tables: dict[tuple, list[Gate]] = {}
    for gate in gates:
        if gate.evidence is not None:
            tables.setdefault((id(gate.evidence), gate.order), []).append(gate)
    for sharing in tables.values():
        out = _join_evidence(out, sharing, key)
    return out


def _join_evidence(roster: DataFrame, gates: list[Gate], key: str) -> DataFrame:
    evidence = gates[0].evidence
    if gates[0].order:
        evidence = latest_per_key(evidence, [key], list(gates[0].order))
    # a key that repeats without an order passes only if all its rows do
    verdicts = evidence.groupBy(key).agg(
        *[F.bool_and(F.coalesce(g.passes, F.lit(False))).alias(f"_{g.stage}") for g in gates],
        F.lit(True).alias("_seen"),
    )
    joined = roster.join(verdicts, key, "left")
    for g in gates:
        missing = F.col("_seen").isNull()
        joined = (
            joined
            .withColumn(pass_column(g.stage), F.coalesce(f"_{g.stage}", F.lit(g.on_missing == "pass")))
            .withColumn(pending_column(g.stage), missing & F.lit(g.on_missing == "pending"))
        )
    return joined.drop("_seen", *[f"_{g.stage}" for g in gates])


def split_by_gate(flags: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, eliminated) of one gate: two filters on one flag column."""
    flag = F.col(pass_column(stage))
    return flags.where(flag), flags.where(~flag)


def in_ranges(floors: dict[str, float], ceilings: dict[str, float]) -> Column:
    """Conjunction of lower and upper bounds, both inclusive."""
    keep = F.lit(True)
    for name, low in floors.items():
        keep = keep & (F.col(name) >= low)
    for name, high in ceilings.items():
        keep = keep & (F.col(name) <= high)
    return keep


def require_all(long: DataFrame, id_col: str, key_col: str, pass_col: str,
                required: list[str], roster: DataFrame | None = None,
                name: str = "all_pass") -> DataFrame:
    """True for ids whose every required key is present with a true value.

    ``long`` has one row per (id, key); other keys are ignored. With a roster,
    ids that have no row at all are reported too, as False.
    """
    met = [
        F.max(F.when(F.col(key_col) == k, F.col(pass_col).cast("int"))).alias(f"_{i}")
        for i, k in enumerate(required)
    ]
    # without a roster the ids that only have other keys must still be reported
    source = long if roster is None else long.where(F.col(key_col).isin(required))
    wide = source.groupBy(id_col).agg(*met)
    every = F.lit(True)
    for i in range(len(required)):
        every = every & (F.coalesce(F.col(f"_{i}"), F.lit(0)) == 1)
    wide = wide.select(id_col, every.alias(name))
    if roster is None:
        return wide
    return (roster.select(id_col).join(wide, id_col, "left")
            .select(id_col, F.coalesce(name, F.lit(False)).alias(name)))
