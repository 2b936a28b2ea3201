"""CSV and text readers for rosters and evidence tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..constants import AGGREGATION_PASS, ALLERGEN_PASS, TOXICITY_PASS
from ..functions.text import stripped
from ..operators.latest import latest_per_key
from ..session import written


def read_csv(spark: SparkSession, path, schema: StructType | None = None) -> DataFrame:
    """CSV with a header. Given a schema, columns are found by header name.

    All columns are read as text first, since a file may hold more columns than
    the schema and in another order; blank cells are NULL.
    """
    table = spark.read.csv(path, header=True)
    if schema is None:
        return table
    return table.select(*[optional(table, f.name).try_cast(f.dataType).alias(f.name)
                          for f in schema.fields])


REJECT = "_line_text"


def read_csv_strictly(spark: SparkSession, path, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV files with a header that fit ``schema``, and the rejects: file, block, line and reason.

    A line is rejected if it has more or fewer values than the header, or if a value that is not blank
    doesn't parse as its column's type; the reason names the first such column. Columns that the files lack
    are NULL. Each line of the files but the headers is in one of the two.
    """
    names = spark.read.csv(path, header=True).columns
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECT, schema=StructType(
        [StructField(n, StringType()) for n in (*names, REJECT)])).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    wrong = [F.when((F.trim(f"`{f.name}`") != "") & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(), F.lit(f"value of {f.name}"))
             for f in schema.fields if f.name in names]
    # written: a read of some columns only would not see that a line is too short
    judged = written(raw.withColumn("_reason", F.coalesce(F.when(F.col(REJECT).isNotNull(), F.lit("number of values")), *wrong)), "judged")
    rows = judged.where("_reason IS NULL").select(*[optional(raw, f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    line = F.coalesce(REJECT, F.array_join(F.array(*[F.coalesce(f"`{n}`", F.lit("")) for n in names]), ","))
    return rows, judged.where("_reason IS NOT NULL").select(
        F.col("_file").alias("file"), F.col("_block").alias("block"), line.alias("line"), F.col("_reason").alias("reason"))


def optional(table: DataFrame, name: str) -> Column:
    """A column, or NULL text when the file has no such header."""
    return F.col(f"`{name}`") if name in table.columns else F.lit(None).cast("string")


def _read_if_present(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """The last row of each id; no file means no rows."""
    try:
        table = spark.read.csv(path, header=True)
        ordered = with_file_order(table).select(
            *[optional(table, f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields], *FILE_ORDER)
        return latest_per_key(ordered, ["id"], FILE_ORDER).drop(*FILE_ORDER)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def with_file_order(table: DataFrame) -> DataFrame:
    """Add the columns that say which row was written last: file time, path, row."""
    return table.select(
        "*",
        F.col("_metadata.file_modification_time").alias("_file_time"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))


FILE_ORDER = ["_file_time", "_file", "_block", "_line"]


def read_roster(spark: SparkSession, path) -> DataFrame:
    """Candidates with ``roster_pos``, which orders them as the file does.

    A read has no row numbers; the place of the block in the file and of the
    row in the block compare the same way.
    """
    table = spark.read.csv(path, header=True)
    pos = F.struct(F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row")).alias("roster_pos")
    return table.select(*[optional(table, f.name).try_cast(f.dataType).alias(f.name)
                          for f in schemas.ROSTER.fields], pos)


def read_ids(spark: SparkSession, path) -> DataFrame:
    """One id per line: trimmed, blank lines dropped, duplicates kept."""
    lines = spark.read.text(path).select(stripped("value").alias("id"))
    return lines.where(F.col("id") != "")


def read_aggregation(spark: SparkSession, path) -> DataFrame:
    """(id, passed) from the aggregation results."""
    table = with_file_order(spark.read.csv(path, header=True))
    return _last_verdict(table.select(
        "id", (F.col("TANGO_pass") == AGGREGATION_PASS).alias("passed"), *FILE_ORDER))


def read_allergenicity(spark: SparkSession, paths, numbered: bool = False) -> DataFrame:
    """(id, passed) from any number of batch files; the newest file wins an id. If the list of
    paths is ``numbered``, the last path that has the id wins, whatever the files' times."""
    parts = [with_file_order(spark.read.csv(path, header=True)).withColumn("_batch", F.lit(i)).select(
        "Protein", "Result", "_batch", *FILE_ORDER) for i, path in enumerate(paths if numbered else [paths])]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    rows = table.where(F.coalesce("Protein", F.lit("")) != "")
    return _last_verdict(rows.select(
        F.col("Protein").alias("id"), (F.col("Result") == ALLERGEN_PASS).alias("passed"), "_batch", *FILE_ORDER),
        ["_batch", *FILE_ORDER])


def read_toxicity(spark: SparkSession, path) -> DataFrame:
    """(id, passed); the id stands under ``Subject`` or, where that is empty, ``id``."""
    table = spark.read.csv(path, header=True)
    sid = F.coalesce(F.nullif(optional(table, "Subject"), F.lit("")), optional(table, "id"), F.lit(""))
    verdict = optional(table, "Prediction") == TOXICITY_PASS
    ordered = with_file_order(table)
    return _last_verdict(ordered.select(sid.alias("id"), verdict.alias("passed"), *FILE_ORDER))


def read_pose(spark: SparkSession, path) -> DataFrame:
    """(id, receptor, pose_pass); the last row of a pair counts."""
    table = with_file_order(spark.read.csv(path, header=True))
    rows = table.select("id", "receptor", F.col("pose_pass").cast("int").alias("pose_pass"), *FILE_ORDER)
    return latest_per_key(rows, ["id", "receptor"], FILE_ORDER).drop(*FILE_ORDER)


def read_coverage_summary(spark: SparkSession, path) -> DataFrame:
    """Coverage per id; no file means no rows."""
    return _read_if_present(spark, path, schemas.COVERAGE)


def read_binder_summary(spark: SparkSession, path) -> DataFrame:
    """Binder counts per id; no file means no rows."""
    return _read_if_present(spark, path, schemas.BINDER_SUMMARY)


def read_peptide_scores(spark: SparkSession, path) -> DataFrame:
    """(peptide, combined_score): every row kept, also repeats of a peptide."""
    table = spark.read.csv(path, header=True)
    return table.select(F.col("Peptide").alias("peptide"),
                        F.col("`Combined Score`").cast("double").alias("combined_score"))


def read_binder_pairs(spark: SparkSession, path) -> DataFrame:
    """(seq_id, peptide, percentile as text) of every window and allele."""
    table = spark.read.csv(path, header=True)
    return table.select("seq_id", "peptide", optional(table, "netmhciipan_ba_percentile").alias("percentile"))


def read_id_map(spark: SparkSession, path) -> DataFrame:
    """(old_id, new_id)."""
    return spark.read.csv(path, header=True).select("old_id", "new_id")


def _last_verdict(rows: DataFrame, order: list[str] = FILE_ORDER) -> DataFrame:
    last = latest_per_key(rows, ["id"], order)
    return last.select("id", F.coalesce("passed", F.lit(False)).alias("passed"))
