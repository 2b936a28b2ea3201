"""The peptide triage: evidence files to the integrated report and the panel."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import DEFAULT_ORDER, RECEPTORS, REQUIRED_RECEPTORS, STAGE_NAMES
from ..functions.text import fixed_decimals
from ..operators import coverage as cov
from ..operators.gates import Gate, in_ranges, pass_column
from ..operators.numbering import rank_ascending
from ..operators.pivots import pivot_filled
from ..operators.segments import find_runs, run_summary, run_text
from ..sources import evidence as src
from ..sources.documents import by_position, result_rows
from .funnel import ELIMINATED, run_funnel


@dataclass(frozen=True)
class Evidence:
    """Evidence tables, one row per id but for ``pose``, which has one per receptor."""

    aggregation: DataFrame
    allergenicity: DataFrame
    toxicity: DataFrame
    pose: DataFrame
    coverage: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, aggregation, allergenicity, toxicity, pose, coverage) -> "Evidence":
        return cls(src.read_aggregation(spark, aggregation), src.read_allergenicity(spark, allergenicity),
                   src.read_toxicity(spark, toxicity), src.read_pose(spark, pose),
                   src.read_coverage_summary(spark, coverage))


def preselect(roster: DataFrame, floors: dict[str, float], ceilings: dict[str, float]) -> DataFrame:
    """Candidates within all score bounds."""
    return roster.where(in_ranges(floors, ceilings))


def triage(roster: DataFrame, evidence: Evidence, order: list[str] | None = None,
           replay: bool = True) -> DataFrame:
    """Roster with pose columns, gate flags and outcome.

    Off-target receptors are shown but do not gate. Without ``replay``,
    candidates that reach stage 04 and have no allergenicity row are pending.
    """
    wide = pivot_filled(evidence.pose, "id", "receptor", F.col("pose_pass"), RECEPTORS, prefix="pose_")
    posed = roster.join(wide, "id", "left").fillna(0, [f"pose_{r}" for r in RECEPTORS])
    docked = F.lit(True)
    for r in REQUIRED_RECEPTORS:
        docked = docked & (F.col(f"pose_{r}") == 1)
    gates = [
        Gate("01", docked),
        Gate("03", F.col("passed"), evidence.aggregation),
        Gate("04", F.col("passed"), evidence.allergenicity,
             on_missing="fail" if replay else "pending"),
        Gate("05", F.col("passed"), evidence.toxicity),
    ]
    return run_funnel(posed, gates, order or DEFAULT_ORDER, replay=replay)


def integrated_report(roster: DataFrame, evidence: Evidence, order: list[str] | None = None,
                      with_stage: bool = True) -> DataFrame:
    """The wide report, one row per candidate."""
    return report_of(triage(roster, evidence, order), evidence.coverage, with_stage)


def report_of(frame: DataFrame, coverage: DataFrame, with_stage: bool = True) -> DataFrame:
    """The wide report of a triaged roster.

    ``cd4_pass`` is true for candidates the coverage table does not name and
    NULL for those whose coverage is incomplete; it does not gate.
    """
    cd4 = coverage.groupBy("id").agg(F.min("cd4_pass").alias("_cd4"), F.lit(True).alias("_covered"))
    joined = frame.join(cd4, "id", "left")
    safe = F.col(pass_column("03")) & F.col(pass_column("05")) & F.col(pass_column("04"))
    docked = F.col(pass_column("01"))
    columns = [
        "id", "seq_24aa", "full_37aa", *[f"pose_{r}" for r in RECEPTORS],
        F.col(pass_column("03")).alias("tango_pass"),
        F.col(pass_column("05")).alias("tox3_pass"),
        F.col(pass_column("04")).alias("aller_pass"),
        F.when(F.col("_covered").isNull(), True).otherwise(F.col("_cd4") == 1).alias("cd4_pass"),
        docked.alias("amy_pose_pass"),
        safe.alias("safety_pass"),
        (docked & safe).alias("final_pass"),
    ]
    if with_stage:
        name = F.lit("")
        for code, text in STAGE_NAMES.items():
            name = F.when(F.col("at_stage") == code, text).otherwise(name)
        out = F.col("outcome") == ELIMINATED
        columns.append(F.when(out, name).otherwise("").alias("eliminated_at_stage"))
    return joined.select(*columns)


def final_panel(report: DataFrame) -> DataFrame:
    """Candidates that passed everything, immunogenicity included."""
    passed = F.lit("pass")
    return report.where(F.col("final_pass") & F.col("cd4_pass")).select(
        "id", F.col("full_37aa").alias("full_sequence"), passed.alias("aggregation"),
        passed.alias("allergenicity"), passed.alias("toxicity"), passed.alias("immunogenicity"),
        passed.alias("amy123r_pose"), F.lit("retained").alias("final_status"))


def aggregation_results(roster: DataFrame, tracks: DataFrame) -> DataFrame:
    """Aggregation table of the roster from residue tracks (id, res, aa, agg)."""
    runs = find_runs(tracks, "id", "res", "agg")
    summary = run_summary(roster, tracks, runs, "id", "agg")
    # a peptide track fits on one line of run text; longer ones have more
    lines = F.array_sort(F.collect_list(F.struct("line_no", "run_detail")))
    text = run_text(runs, "id").groupBy("id").agg(
        F.array_join(F.transform(lines, lambda t: t["run_detail"]), "; ").alias("run_detail"))
    return (
        roster.select("id", "full_37aa", "AMY1R", "AMY2R", "AMY3R", "CTR")
        .join(summary, "id").join(text, "id", "left")
        .select("id", "full_37aa", "AMY1R", "AMY2R", "AMY3R", "CTR",
                fixed_decimals("score_total", 4).alias("AGG_total"),
                F.col("n_runs").alias("n_APR"),
                F.coalesce("run_detail", F.lit("none")).alias("APR_detail"),
                F.col("status").alias("TANGO_pass")))


def toxicity_results(raw: DataFrame, roster: DataFrame) -> DataFrame:
    """Toxicity table from the tool's raw output and the roster's sequences.

    The score stands under ``Hybrid Score`` or, without such a column, ``ML Score``.
    """
    sid = "Subject" if "Subject" in raw.columns else "ID"
    score = "Hybrid Score" if "Hybrid Score" in raw.columns else "ML Score"
    rows = raw.select(F.col(f"`{sid}`").alias("id"), F.col(f"`{score}`").cast("double").alias("_score"),
                      src.optional(raw, "PPV").alias("ppv"), F.col("Prediction").alias("prediction"))
    sequences = roster.select("id", F.col("full_37aa").alias("sequence"))
    return rows.join(sequences, "id", "left").select(
        "id", F.coalesce("sequence", F.lit("")).alias("sequence"),
        fixed_decimals("_score", 3).alias("ml_score"), "ppv", "prediction",
        F.when(F.col("prediction") == src.TOXICITY_PASS, "PASS").otherwise("FAIL").alias("toxin_pass"))


def binder_pairs(results: DataFrame, body: str, submitted: DataFrame) -> DataFrame:
    """(seq_id, peptide, percentile) of a binding result document.

    ``submitted`` has seq_id and pos, the 1-based place in the submission.
    """
    names = ["sequence_number", "peptide", "netmhciipan_ba_percentile"]
    rows = result_rows(results, [], body, names)
    return by_position(rows, submitted.select("seq_id", "pos"), "sequence_number", "pos").select(
        "seq_id", "peptide", F.col("netmhciipan_ba_percentile").alias("percentile"))


def binder_summary(targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq_id, n_wb_lt10pct, rank) of all targets, fewest binders first.

    ``targets`` has seq_id and pos; ties keep the order of the submission.
    """
    counted = cov.binder_count(targets, pairs, "seq_id", "percentile", name="n_wb_lt10pct")
    placed = counted.join(targets.select("seq_id", "pos"), "seq_id")
    return rank_ascending(placed, [], ["n_wb_lt10pct", "pos"]).drop("pos")


def coverage_summary(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """The coverage table of the report from binder pairs and peptide scores."""
    bridge = cov.binders(pairs, "seq_id", "peptide", "percentile")
    rolled = cov.coverage(bridge, scores, "seq_id", "peptide", "combined_score")
    return rolled.select(
        F.col("seq_id").alias("id"), F.col("n_scored").alias("n_peptides_scored"),
        fixed_decimals("min_score", 2).alias("min_combined_score"),
        F.col("n_below").alias("n_below_43"), "status", F.col("verdict").cast("int").alias("cd4_pass"))
