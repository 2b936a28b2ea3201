"""JSON documents: job templates and column/row result tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.subsets import require_none

RESULT_SCHEMA = ("struct<table_columns: array<struct<name: string>>, "
                 "table_data: array<array<string>>>")


def read_templates(spark: SparkSession, path, key_of: str = r"([^/]+)/[^/]+/[^/]+$",
                   key: str = "receptor") -> DataFrame:
    """(key, document) from one JSON file per key; the key is taken from the path.

    The document stays text: a schema inferred from the files would lose or
    change fields that happen to be empty in them.
    """
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_path", key_of, 1).alias(key), F.col("value").alias("document"))


def repeated_templates(templates: DataFrame, wanted: DataFrame, key: str = "receptor") -> DataFrame:
    """Wanted keys that do not have exactly one template, with their number."""
    counts = templates.groupBy(key).agg(F.count(F.lit(1)).alias("n_templates"))
    return (wanted.select(key).distinct().join(counts, key, "left")
            .select(key, F.coalesce("n_templates", F.lit(0)).alias("n_templates"))
            .where(F.col("n_templates") != 1))


def result_rows(results: DataFrame, keys: list[str], body: str, wanted: list[str]) -> DataFrame:
    """Flatten result documents that name their columns apart from the rows.

    Cells are found by the position of their column's name; a name the
    document lacks gives NULL.
    """
    parsed = results.select(*keys, F.from_json(body, RESULT_SCHEMA).alias("_r"))
    # places are looked up once per document, not per row
    names = F.col("_r.table_columns.name")
    places = [F.nullif(F.array_position(names, F.lit(name)), F.lit(0)).cast("int").alias(f"_at{i}")
              for i, name in enumerate(wanted)]
    rows = parsed.select(*keys, *places, F.explode("_r.table_data").alias("_row"))
    return rows.select(*keys, *[_cell(f"_at{i}").alias(name) for i, name in enumerate(wanted)])


def _cell(place: str) -> Column:
    return F.when(F.col(place).isNotNull(), F.try_element_at("_row", F.col(place)))


def by_position(rows: DataFrame, submitted: DataFrame, number: str, pos: str, strict: bool = True) -> DataFrame:
    """Give result rows the columns of the record with that submission number.

    Raises if a row's number is not among the submitted ones; if not ``strict``,
    such rows are left out, and ``unknown_numbers`` tells them.
    """
    if strict:
        require_none(unknown_numbers(rows, submitted, number, pos), "result rows with an unknown number")
    numbered = submitted.withColumnRenamed(pos, "_pos")
    return rows.join(numbered, rows[number].cast("long") == numbered["_pos"]).drop("_pos")


def unknown_numbers(rows: DataFrame, submitted: DataFrame, number: str, pos: str) -> DataFrame:
    """Numbers of result rows that no submitted record has; NULL is unknown too."""
    numbers = rows.select(F.col(number).cast("string").alias("number")).distinct()
    known = submitted.select(F.col(pos).cast("long").alias("_pos"))
    return numbers.join(known, F.col("number").try_cast("long") == F.col("_pos"), "left_anti")
