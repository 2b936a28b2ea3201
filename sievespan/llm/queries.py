"""The driver's queries for the operators of this package, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontamination, embeddings, licenses, packing, periodic, pii, quality, repeats, sharding, simhash, toxicity, tries
from .checking_sql import TRIE, kd_shards
from .workers import prepare

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SHARDS = 24
END_ID = 50256    # the id that the rank file leaves free


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def tokenizer_json(path: str | None = None) -> str:
    """Content of a vocabulary file; tasks get the content, not the path."""
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        return f.read()


def op1_repeats(spark, sf_dir):
    return repeats.passages(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_quality(spark, sf_dir):
    found = quality.scored(_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"),
                           _table(spark, sf_dir, "labels", "doc_id", "quality"))
    return found.select("doc_id", "own_quality", "host_posterior", "path_posterior", "quality",
                        (F.col("quality") >= quality.THRESHOLD).alias("accepted"))


def op3_packing(spark, sf_dir):
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = f.read()
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN, END_ID)


def op4_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_licenses(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    found = F.col("licenses.found")
    base = F.filter(found, lambda d: d["base"])
    starts = F.transform("base", lambda d: d["start"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")

    return (
        licenses.detect(docs).select("doc_id", F.col("licenses.n_words").alias("n_words"), found.alias("found"),
                                     base.alias("base"))
        .select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                labels("base").alias("base_labels"), labels("found").alias("labels"),
                licenses.confidence(F.col("found")).alias("score")))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_decontamination(spark, sf_dir):
    found = decontamination.contamination(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                          _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontamination.contaminated().alias("contaminated"))


def op8_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_bpe(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    coded = bpe.round_trip(docs, tokenizer_json())
    return coded.select(
        "doc_id", bpe.n_tokens(F.col("token_ids")).alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pii(spark, sf_dir):
    found = pii.find(_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", base.alias("base"), "pii").select(
        "doc_id", *[number(kind) for kind in pii.BASE_KINDS],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op11_periodic(spark, sf_dir):
    docs = periodic.with_planted_runs(_table(spark, sf_dir, "documents", "doc_id", "text"))
    runs, best = F.col("periodic.runs"), F.col("best")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = periodic.add_runs(docs).select("doc_id", runs.alias("runs"), periodic.longest(runs).alias("best"),
                                           F.col("periodic.collapsed").alias("collapsed"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["before"]).alias("start"),
        best["length"].alias("length"), (-best["short"]).alias("period"),
        F.floor(1000 * best["length"] / -best["short"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_sharding(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", *sharding.DIMENSIONS[1:])
    return sharding.kd_shards(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op13_tries(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return tries.nodes(tries.rebuilt(tries.conversations(turns)))


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_licenses": op5_licenses,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_embeddings": op8_embeddings,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
    "op11_periodic": op11_periodic,
    "op12_sharding": op12_sharding,
    "op13_tries": op13_tries,
}

# Words as the contract has them: A-Z in lower case, runs of letters and digits and of what lies beyond ASCII.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL: dict[str, str] = {
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, place, place + n - 1), ' ') AS win
             FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS place FROM i)),
     pos AS (SELECT doc_id, n, place, array_to_string(list_slice(w, place, place + n - 1), ' ') AS win
             FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS place
                   FROM d CROSS JOIN (SELECT DISTINCT n FROM win))),
     hit AS (SELECT DISTINCT doc_id, n, place, item_id FROM pos JOIN win USING (n, win)),
     cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + n)) AS p FROM hit) GROUP BY 1),
     its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS cosine
           FROM v a JOIN v b ON a.vec_id <> b.vec_id),
     link AS (SELECT a, b FROM c WHERE isfinite(cosine) AND cosine >= 0.9),
     reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r),
     n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(max(n), 0) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN n ON a = vec_id GROUP BY vec_id""",
    "op12_sharding": kd_shards({"doc_id": True, "n_chars": True, "source": False, "lang": False}, SHARDS),
    "op13_tries": TRIE,
}
