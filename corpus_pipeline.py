"""A corpus from raw documents: rejects poor ones, near copies and benchmark text,
takes out personal data and turns the rest into token ids."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievespan.llm import bpe, decontamination, pii, quality, simhash
from sievespan.llm.queries import tokenizer_json
from sievespan.llm.workers import prepare
from sievespan.session import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return simhash.keep_first(docs)


def keep_unknown(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token ids of every document, and whether
    they give its text back."""
    prepare(spark)
    coded = bpe.round_trip(docs.withColumn("text", F.coalesce("text", F.lit(""))), tokenizer_json())
    return coded.select(
        "doc_id", "lang", "source", bpe.n_tokens(F.col("token_ids")).alias("n_tokens"), "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), (F.col("decoded") == F.col("text")).alias("exact"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_different),
    ("benchmark decontamination", keep_unknown),
    ("PII", redact),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None    # classifiers, tokenizers and components aren't SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
