"""Whole runs: the funnel with its outputs, and the jobs for structure prediction."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..constants import BATCH_SIZE, DEFAULT_ORDER, REFERENCE_PEPTIDE, STAGE_NAMES
from ..operators import jobs
from ..operators.subsets import missing_ids, require_none
from ..session import written
from ..sinks import writers
from ..sinks.writers import write_alignments
from ..sources.alignments import alignments_in_results, read_cached
from ..sources.documents import repeated_templates
from ..sources.evidence import read_ids
from . import funnel, manifest
from .funnel import check_order
from .peptides import Evidence, report_of, triage


FILE_BATCHES = 1000    # batches of pending candidates up to which each is a file of its own


def run_triage(roster: DataFrame, evidence: Evidence, folder: str,
               order: list[str] | None = None, replay: bool = False, resume_from: str | None = None,
               file_batches: int = FILE_BATCHES) -> DataFrame:
    """Run the funnel and write its outputs below ``folder``.

    With ``resume_from`` the run starts at that stage with the ids that an
    earlier run saved after the stage before it, if it had the same roster and the same evidence
    for the same stages until then; else ValueError is raised. The report always covers the
    whole roster. A run that is started again with the same tables gives the same folder.

    manifest            what the runs were made of
    inputs              ids that each stage looks at, the reference peptide at stage 01 among them
    alive_after_<stage> ids, one per line
    audit               (id, stage name), a folder per run
    counts              input, pass, fail and pending per stage
    final_results       the wide report
    pending             FASTA batches of candidates that wait for evidence: files up to ``file_batches``, else a table
    """
    order = order or DEFAULT_ORDER
    spark = roster.sparkSession
    whole, stages, left = triage(roster, evidence, order, replay), order, roster
    own = manifest.marks(roster, {s: getattr(evidence, manifest.STAGE_TABLES[s]) for s in order}, order, replay)
    if resume_from is not None:
        check_order([resume_from], order)
        stages, done = order[order.index(resume_from):], order[:order.index(resume_from)]
        if done:
            if not manifest.fits(spark, folder, done[-1], own[len(done) - 1]):
                raise ValueError(f"the ids saved after {done[-1]} were made of other tables, or of stages in another order")
            alive = read_ids(spark, f"{folder}/alive_after_{done[-1]}")
            left = roster.join(alive, "id", "left_semi")
    run = manifest.begin_run(spark, folder, stages, own[len(order) - len(stages):])
    # written once, as each of the outputs would compute the joins anew; the counts come with it
    seen = Observation("triage")
    made = whole if left is roster else triage(left, evidence, stages, replay)
    frame = written(made.observe(seen, *funnel.count_columns(stages)), "triage")
    counts = funnel.count_rows(seen.get, stages)
    writers.write_inputs(funnel.stage_inputs(frame, stages, {"01": [REFERENCE_PEPTIDE]}), f"{folder}/inputs")
    for stage, mark in zip(stages, own[len(order) - len(stages):]):
        writers.write_ids(funnel.alive_after(frame, stages, stage), f"{folder}/alive_after_{stage}")
        manifest.sign(spark, folder, stage, mark)
    writers.append_audit(funnel.funnel_audit(frame, names=STAGE_NAMES), f"{folder}/audit", run)
    spark.createDataFrame(counts, funnel.COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts")
    writers.write_report(report_of(frame if left is roster else whole, evidence.coverage), f"{folder}/final_results")
    waiting = sum(row[-1] for row in counts)
    if waiting:
        batches = writers.fasta_batches(frame.where(F.col("outcome") == funnel.PENDING), "id", "full_37aa", ["roster_pos"])
        writers.write_fasta(batches, f"{folder}/pending", files=waiting <= file_batches * BATCH_SIZE)
    return frame


def last_checkpoint(spark: SparkSession, folder: str, order: list[str],
                    marks: list[str] | None = None) -> tuple[str, DataFrame] | None:
    """The latest stage of ``order`` with a saved id list, and its ids; given the stages' ``marks``, one that fits."""
    for place, stage in reversed(list(enumerate(order))):
        if marks is not None and not manifest.fits(spark, folder, stage, marks[place]):
            continue
        try:
            return stage, read_ids(spark, f"{folder}/alive_after_{stage}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def folding_jobs(roster: DataFrame, ids: DataFrame, receptors: list[str], templates: DataFrame,
                 alignments: DataFrame | None = None, done: DataFrame | None = None,
                 seed: int | None = None) -> DataFrame:
    """(job, document) for every id and receptor that is not done.

    ``ids``         candidates to fold; each must be in the roster
    ``templates``   (receptor, document), one per receptor
    ``alignments``  records of the peptides' alignments; without them, or for a
                    peptide that has none, the alignment is the query alone
    """
    peptides = roster.join(ids.select("id").distinct(), "id", "left_semi").select("id", "seq_24aa", "full_37aa")
    require_none(missing_ids(ids, roster, "id"), "ids not in the roster")
    require_none(jobs.sequence_mismatch(peptides, "id", "seq_24aa", "full_37aa"),
                 "constant part and designed part do not make the full sequence")
    wanted = list(dict.fromkeys(receptors))
    keys = roster.sparkSession.createDataFrame([(r,) for r in wanted], "receptor string")
    require_none(repeated_templates(templates, keys), "receptors without exactly one template")
    require_none(jobs.templates_with_chain(templates.where(F.col("receptor").isin(wanted)), "receptor"),
                 "templates that already have the peptide chain")

    query = jobs.query_only_alignment("seq_24aa")
    todo = jobs.job_matrix(peptides, "id", wanted, "receptor", done)
    if alignments is None:
        texts = peptides.select("id", query.alias("msa"))
    else:
        mine = alignments.join(peptides.select("id"), "id", "left_semi")
        require_none(jobs.query_mismatch(mine, peptides, "id", "full_37aa"),
                     "alignments that do not start with the peptide")
        capped = jobs.alignment_text(jobs.add_cap_column(mine), "id").withColumnRenamed("msa", "_msa")
        texts = peptides.join(capped, "id", "left").select("id", F.coalesce("_msa", query).alias("msa"))
    full = (todo.join(texts, "id")
            .select("receptor", "job", jobs.folding_sequence("seq_24aa").alias("sequence"), "msa"))
    return jobs.job_documents(full, templates, "receptor", "sequence", "msa", seed)


def unaligned(peptides: DataFrame, alignments: DataFrame) -> DataFrame:
    """Peptides that still need an alignment search."""
    return peptides.join(alignments.select("id").distinct(), "id", "left_anti")


def fill_cache(spark: SparkSession, results: DataFrame, cache: str) -> None:
    """Save the alignments of finished search documents (id, document) that the cache does not have."""
    missing = unaligned(results, read_cached(spark, cache))
    write_alignments(alignments_in_results(missing), cache)
