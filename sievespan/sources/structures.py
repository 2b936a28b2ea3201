"""C-alpha positions from mmCIF structure files.

Files lie as ``<id>/<receptor>/<id>_<receptor>_model.cif``, or, keyed, as any files
in ``id=<id>/receptor=<receptor>/``. A funnel has few candidates left where
structures are looked at, so both readers can be given those that are: of the
keyed layout Spark then opens the partitions that the join with them asks for
(dynamic partition pruning), of the other one the files that are picked by name.

A file per structure costs a listing, an opening and, when it is written, a commit by
the driver each, whatever its size. Large sets are packed instead: a table (id,
receptor, path, value) with the text of a model file per row and many in a part
file, in ``BUCKETS`` folders by id, of which a reader opens those of the ids it is given.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import tokens
from ..operators.latest import latest_per_key
from ..session import written

# <id>/<receptor>/<id>_<receptor>_model.cif; other files of a folder are not its structure
PLACE = r"/([^/]+)/([^/]+)/\1_\2_model\.cif$"
MODELS = "*/*/*_model.cif"
# the fourth word says which atom it is; most lines are of others, and aren't split
CA_LINE = r"^ATOM\S*\s+\S+\s+\S+\s+CA(\s|$)"
BUCKETS = 64
PACKED = "id string, receptor string, path string, value string, bucket int"


def read_ca_atoms(spark: SparkSession, path, alive: DataFrame | None = None) -> DataFrame:
    """(id, receptor, chain, resnum, x, y, z) of the C-alpha atoms of each structure's model
    file, ``<id>/<receptor>/<id>_<receptor>_model.cif`` below ``path``.

    Lines whose numbers cannot be read are skipped; of several lines for one
    residue the last in the file counts. Files may be split between tasks: the
    block offset and the line number in the block give the order.

    With ``alive`` (id, and receptor if it has one) only the files of these are read.
    Their names come to the driver, which lists all names in any case.
    """
    files = f"{path}/{MODELS}"
    if alive is not None:
        known = _models(spark, path)
        files = [r["_path"] for r in known.join(_wanted(alive), _keys(alive), "left_semi").select("_path").collect()]
        if not files:
            return parse_ca_atoms(spark.createDataFrame([], "value string, _path string, _block long, _line long"))
    return parse_ca_atoms(spark.read.text(files).select("value", *_place()))


def read_keyed_ca_atoms(spark: SparkSession, path, alive: DataFrame | None = None) -> DataFrame:
    """The same from files in ``id=<id>/receptor=<receptor>/`` below ``path``, each a row until the ones wanted are
    known. Partitions that ``alive`` doesn't name aren't opened as long as Spark finds it small enough to broadcast."""
    files = spark.read.schema("value string, id string, receptor string").text(str(path), wholetext=True).select(
        "id", "receptor", "value", F.col("_metadata.file_path").alias("_path"))
    if alive is not None:
        files = files.join(_wanted(alive), _keys(alive), "left_semi")
    return _atoms(files.select("id", "receptor", "_path", F.lit(0).cast("long").alias("_block"),
                               F.posexplode(F.split("value", "\n")).alias("_line", "value")))


def pack_models(models: DataFrame, table: str, dealt: bool = False) -> None:
    """Add (id, receptor, path, value), the texts of model files, to a packed table. Of two texts of
    a structure the one with the later ``path`` counts where they have the same residue.

    With ``dealt`` the rows have their ``bucket`` and lie in ranges of it, so the texts aren't moved once more.
    """
    texts = models if dealt else models.withColumn("bucket", bucket_of("id")).repartition("bucket")
    (texts.select("id", "receptor", "path", "value", "bucket")
     .write.mode("append").partitionBy("bucket").parquet(table))


def model_texts(spark: SparkSession, path) -> DataFrame:
    """(id, receptor, path, value) of the model files below ``path``, to be packed."""
    files = spark.read.text(f"{path}/{MODELS}", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.where(F.col("path").rlike(PLACE)).select(
        F.regexp_extract("path", PLACE, 1).alias("id"), F.regexp_extract("path", PLACE, 2).alias("receptor"), "path", "value")


def read_packed_ca_atoms(spark: SparkSession, table: str, alive: DataFrame | None = None) -> DataFrame:
    """The same from a packed table."""
    models = spark.read.schema(PACKED).parquet(table)
    if alive is not None:
        models = models.join(_wanted(alive).withColumn("bucket", bucket_of("id")), [*_keys(alive), "bucket"], "left_semi")
    lines = F.posexplode(F.split("value", "\n")).alias("_line", "value")
    return _atoms(models.select("id", "receptor", F.col("path").alias("_path"), F.lit(0).cast("long").alias("_block"), lines))


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _keys(alive: DataFrame) -> list[str]:
    return ["id", "receptor"] if "receptor" in alive.columns else ["id"]


def _wanted(alive: DataFrame) -> DataFrame:
    """The keys of ``alive`` as text, written so that Spark knows their size. It prunes by a side that a comparison
    filters, so there is one, which all keys pass."""
    keys = alive.select(*[F.col(k).cast("string").alias(k) for k in _keys(alive)]).distinct()
    return written(keys, "alive").where(F.col("id") >= "")


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line")]


def parse_ca_atoms(lines: DataFrame) -> DataFrame:
    """The same from (value, _path, _block, _line) rows."""
    placed = lines.where(F.col("_path").rlike(PLACE)).select(
        F.regexp_extract("_path", PLACE, 1).alias("id"), F.regexp_extract("_path", PLACE, 2).alias("receptor"),
        "value", "_path", "_block", "_line")
    return _atoms(placed)


def _atoms(lines: DataFrame) -> DataFrame:
    """From (id, receptor, value, _path, _block, _line) rows."""
    tok = F.col("tok")
    atoms = (
        lines.where(F.col("value").rlike(CA_LINE))
        # a generated column: a filter on a plain one would be pushed below it, and split the line for each of its terms
        .withColumn("tok", F.explode(F.array(tokens("value"))))
        .where((F.size("tok") >= 13) & (tok[3] == "CA"))
        .select(
            "id", "receptor",
            tok[6].alias("chain"), tok[8].try_cast("int").alias("resnum"),
            *[tok[i].try_cast("double").alias(c) for i, c in ((10, "x"), (11, "y"), (12, "z"))],
            "_path", "_block", "_line")
        .dropna(subset=["resnum", "x", "y", "z"])
    )
    return latest_per_key(atoms, ["id", "receptor", "chain", "resnum"],
                          ["_path", "_block", "_line"]).drop("_path", "_block", "_line")


def done_jobs(spark: SparkSession, path) -> DataFrame:
    """(id, receptor) of the structures below ``path`` that have their model file.

    Only names are listed; the files are not opened.
    """
    return _models(spark, path).select("id", "receptor").distinct()


KEYED = r"/id=([^/]+)/receptor=([^/]+)/[^/]+$"
FILES = "path string, modificationTime timestamp, length long, content binary"


def note_done(spark: SparkSession, path, table: str, checkpoint: str, keyed: bool = False) -> None:
    """Add the structures that came since the last call to ``table``, a folder per call that found any.

    The stream's own log of files says which are new, so what is noted is not looked at again; only names are
    taken, files are not opened. With ``keyed`` any file in ``id=<id>/receptor=<receptor>/`` counts, else model files.
    """
    files = (spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*" if keyed else "*_model.cif")
             .load(f"{path}/*/*").select("path"))
    place = KEYED if keyed else PLACE

    def part(n):
        text = F.regexp_extract("path", place, n)
        return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))) if keyed else text    # names of partitions are escaped

    _note(files.where(F.col("path").rlike(place)).select(part(1).alias("id"), part(2).alias("receptor")), table, checkpoint)


def note_packed(spark: SparkSession, packed: str, table: str, checkpoint: str) -> None:
    """The same for structures of a packed table, by its part files that came since the last call; of these
    only the names of structures are read."""
    _note(spark.readStream.schema(PACKED).parquet(packed).select("id", "receptor"), table, checkpoint)


def _note(found: DataFrame, table: str, checkpoint: str) -> None:
    def append(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = (found.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(append).start())
    query.awaitTermination()


def noted_jobs(spark: SparkSession, table: str) -> DataFrame:
    """(id, receptor) of all structures noted so far."""
    try:
        rows = spark.read.schema("id string, receptor string").parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], "id string, receptor string")
    return rows.select("id", "receptor").distinct()


def _models(spark: SparkSession, path) -> DataFrame:
    files = spark.read.format("binaryFile").load(f"{path}/{MODELS}").select(F.col("_metadata.file_path").alias("_path"))
    return files.where(F.col("_path").rlike(PLACE)).select(
        F.regexp_extract("_path", PLACE, 1).alias("id"), F.regexp_extract("_path", PLACE, 2).alias("receptor"), "_path")


def folder_ids(spark: SparkSession, path) -> DataFrame:
    """Sorted ids of the structures below ``path``."""
    return done_jobs(spark, path).select("id").distinct().orderBy("id")
