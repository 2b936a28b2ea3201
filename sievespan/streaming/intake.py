"""Incremental evidence intake with Structured Streaming.

New evidence files are picked up by a file stream. ``keep_latest`` holds the last
row of each key in the stream's state store, so a batch costs what its own rows
cost, whatever has come before, and appends to a log only the rows that became
the last of their key. ``latest_state`` reads the table from the store: a row per
key, no history.

``take_in`` is the plain way without state: it appends all rows to a log, and the
current table is the last row per key of that log, which each read folds.

Either way a micro-batch has a folder of its own, written in overwrite mode, so a
repeated batch is harmless.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.latest import latest_per_key
from ..session import settings

# state on disk, of which a batch saves only what it changed
STORE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def evidence_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "csv",
                    files_per_batch: int | None = None, **options) -> DataFrame:
    """Stream of the evidence files that lie or arrive in ``folder``.

    ``folder`` may be a pattern, and what it names a folder of part files or a
    single file: the stream's reader refuses a file's plain path.
    """
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def take_in(stream: DataFrame, log: str, checkpoint: str, keys: list[str], order: list[str]) -> None:
    """Append all that has arrived to the log, then stop."""
    def append(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = (stream.writeStream.trigger(availableNow=True)
             .option("checkpointLocation", checkpoint).foreachBatch(append).start())
    query.awaitTermination()


def current_evidence(spark: SparkSession, log: str, schema: StructType, keys: list[str],
                     order: list[str]) -> DataFrame:
    """The last row per key over all batches; late rows are weighed like any other.

    There is no row before a first batch has come in.
    """
    try:
        rows = spark.read.schema(schema).parquet(log).select(*schema.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return latest_per_key(rows, keys, order)


def compact(spark: SparkSession, log: str, target: str, schema: StructType, keys: list[str],
            order: list[str]) -> None:
    """Write the current table as the first batch of a new log."""
    current_evidence(spark, log, schema, keys, order).write.parquet(f"{target}/batch=-1")


def keep_latest(stream: DataFrame, log: str, checkpoint: str, keys: list[str], order: list[str]) -> None:
    """Take in all that has arrived, then stop. Of each batch the log gets the rows that became the
    last of their key (in ``order``, ties by the other columns); late and repeated rows leave no trace.

    The state is one row per key, kept by Spark in the checkpoint: the greatest struct, as in
    ``latest_per_key``, with the time of the batch that brought it, the earliest one for a row that
    came several times. If that is the key's last batch, the row is new. Should the clock not have
    moved on since the batch before, all rows the batch touched are logged, which repeats some and loses none.
    """
    spark = stream.sparkSession
    rest = [c for c in stream.columns if c not in keys and c not in order]
    last = (stream.withColumn("_now", F.unix_micros(F.current_timestamp())).groupBy(*keys)
            .agg(F.max(F.struct(*order, *rest, (-F.col("_now")).alias("_since"))).alias("_row"), F.max("_now").alias("_seen")))

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/_touched")    # the batch itself can be read once only
        batch = spark.read.schema(batch.schema).parquet(f"{log}/_touched")
        stamp = batch.agg(F.max("_seen")).first()[0] or 0
        before = spark.read.parquet(f"{log}/_stamps/batch={number - 1}").first()["stamp"] if number else 0
        fresh = -F.col("_row._since") == F.col("_seen") if stamp > before else F.lit(True)
        columns = [F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in stream.columns]
        batch.where(fresh).select(columns).write.mode("overwrite").parquet(f"{log}/batch={number}")
        (spark.range(1).select(F.lit(max(stamp, before)).cast("long").alias("stamp"))
         .write.mode("overwrite").parquet(f"{log}/_stamps/batch={number}"))

    with settings(spark, STORE):
        query = (last.writeStream.outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", checkpoint).foreachBatch(append).start())
        query.awaitTermination()


def latest_state(spark: SparkSession, checkpoint: str, schema: StructType, keys: list[str], order: list[str]) -> DataFrame:
    """The table that ``keep_latest`` holds: the last row of each key. There is none before a first batch."""
    if not has_batches(spark, checkpoint):
        return spark.createDataFrame([], schema)
    rest = [c for c in schema.fieldNames() if c not in keys and c not in order]
    row = StructType([schema[c] for c in (*order, *rest)] + [StructField("_since", LongType())])
    held = spark.read.format("statestore").load(checkpoint).select(
        F.col("key").cast(StructType([schema[c] for c in keys])).alias("key"),
        F.col("value").cast(StructType([StructField("row", row), StructField("seen", LongType())])).alias("value"))
    return held.select([F.col("key")[c].alias(c) if c in keys else F.col("value.row")[c].alias(c) for c in schema.fieldNames()])


def has_batches(spark: SparkSession, checkpoint: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
