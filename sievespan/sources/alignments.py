"""Alignments in A3M text: header and row pairs, the query first."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.latest import latest_per_key


def read_alignments(spark: SparkSession, paths) -> DataFrame:
    """(id, at, is_query, header, row) of every record; the id is the file's name.

    Records are split at ``>`` by the reader itself, so a large alignment is
    read by several tasks. ``at`` orders the records of a file, and the first
    one is the query. Blank lines and carriage returns don't count.
    """
    return _records(spark.read.option("lineSep", "\n>").text(paths).withColumn(
        "_id", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.a3m)?$", 1)))


def read_cached(spark: SparkSession, cache: str) -> DataFrame:
    """The same from a cache, a table of alignments, each a row; before a first one is saved there is none.
    Of an alignment that was saved again the last text counts."""
    try:
        saved = spark.read.schema("id string, run long, value string").parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        saved = spark.createDataFrame([], "id string, run long, value string")
    parts = F.transform(F.split("value", "\n>"), lambda r: F.replace(r, F.lit("\r"), F.lit("")))
    records = F.filter(parts, lambda r: F.trim(F.translate(r, "\n", "")) != "")
    rows = latest_per_key(saved, ["id"], ["run"]).select("id", F.posexplode(records).alias("_line", "value"))
    return _split(rows.select("id", F.struct(F.lit(0).cast("long").alias("_block"), F.col("_line").cast("long").alias("_line")).alias("at"),
                              (F.col("_line") == 0).alias("is_query"), "value"))


def alignments_in_results(documents: DataFrame, document: str = "document") -> DataFrame:
    """(id, msa) from finished search documents (id, and their JSON text): the alignment of the first chain.
    Documents without one are left out."""
    text = F.try_variant_get(F.try_parse_json(document), "$.sequences[0].protein.unpairedMsa", "string")
    return documents.select("id", text.alias("msa")).where(F.col("msa").isNotNull())


def _records(lines: DataFrame) -> DataFrame:
    records = lines.select(
        F.col("_id").alias("id"),
        F.struct(F.col("_metadata.file_block_start").alias("_block"),
                 F.monotonically_increasing_id().alias("_line")).alias("at"),
        F.regexp_replace("value", r"\r", "").alias("value")).where(F.trim(F.translate("value", "\n", "")) != "")
    first = records.groupBy("id").agg(F.min("at").alias("_first"))
    return _split(records.join(first, "id").withColumn("is_query", F.col("at") == F.col("_first")))


def _split(known: DataFrame) -> DataFrame:
    """Header and row of each record's text."""
    # only the record that begins a file keeps its own ">"
    parts = F.split(F.when(F.col("is_query"), F.regexp_replace("value", r"^\s*>?", "")).otherwise(F.col("value")), "\n")
    return known.select(
        "id", "at", "is_query", parts[0].alias("header"),
        F.array_join(F.slice(parts, 2, F.size(parts)), "").alias("row"))
