"""Job matrix and nested job documents."""

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import CAP_MODIFICATION, CAP_RESIDUE, GAP, PEPTIDE_CHAINS, PEPTIDE_PREFIX
from ..functions.text import job_name, stripped

CHAIN = PEPTIDE_CHAINS[0]


def job_matrix(ids: DataFrame, id_col: str, keys: list[str], key_col: str,
               done: DataFrame | None = None) -> DataFrame:
    """Every row of ``ids`` with every key of a fixed list, less the pairs done.

    Adds ``key_col`` and ``job``. The keys are a short parameter: what is done
    of an id is at most that list, so it is joined as one row per id, and rows
    are multiplied only after the join.
    """
    todo = F.array(*[F.lit(k) for k in keys])
    if done is not None:
        per_id = (done.where(F.col(key_col).isin(keys)).groupBy(id_col)
                  .agg(F.collect_set(key_col).alias("_done")))
        ids = ids.join(per_id, id_col, "left")
        todo = F.filter(todo, lambda k: ~F.coalesce(F.array_contains("_done", k), F.lit(False)))
    jobs = ids.withColumn(key_col, F.explode(todo)).withColumn("job", job_name(id_col, key_col))
    return jobs.drop("_done")


def folding_sequence(seq: str) -> Column:
    """Constant part, designed part and the cap residue."""
    return F.concat(F.lit(PEPTIDE_PREFIX), F.col(seq), F.lit(CAP_RESIDUE))


def sequence_mismatch(df: DataFrame, key: str, seq: str, full: str) -> DataFrame:
    """Ids whose full sequence is not the constant part and the designed part."""
    joined = F.concat(F.lit(PEPTIDE_PREFIX), F.col(seq))
    return df.where(~joined.eqNullSafe(F.col(full))).select(key)


def query_only_alignment(seq: str) -> Column:
    """Alignment text of a peptide searched against nothing."""
    return F.concat(F.lit(">query\n"), folding_sequence(seq), F.lit("\n"))


def search_documents(peptides: DataFrame, id_col: str, seq: str, cached: DataFrame | None = None) -> DataFrame:
    """(job, document): an alignment search for each peptide, less those that ``cached`` has an alignment of."""
    if cached is not None:
        peptides = peptides.join(cached.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    chain = F.struct(F.lit("A").alias("id"), F.concat(F.lit(PEPTIDE_PREFIX), F.col(seq)).alias("sequence"))
    return peptides.select(F.col(id_col).cast("string").alias("job"), F.to_json(F.struct(
        F.lit("alphafold3").alias("dialect"), F.lit(1).alias("version"), F.col(id_col).cast("string").alias("name"),
        F.array(F.lit(1)).alias("modelSeeds"), F.array(F.struct(chain.alias("protein"))).alias("sequences"))).alias("document"))


def query_mismatch(alignment: DataFrame, peptides: DataFrame, key: str, full: str) -> DataFrame:
    """Ids whose alignment does not start with their full sequence, or has no query at all."""
    query = alignment.where("is_query").select(key, stripped("row").alias("_query"))
    aligned = peptides.select(key, full).join(alignment.select(key).distinct(), key)
    return (aligned.join(query, key, "left")
            .where(~F.col("_query").eqNullSafe(F.col(full))).select(key).distinct())


def add_cap_column(alignment: DataFrame) -> DataFrame:
    """Extend every aligned row by one column: the cap for the query, else a gap."""
    row = stripped("row")
    capped = (F.when(row == "", F.col("row"))
              .when(F.col("is_query"), F.concat(row, F.lit(CAP_RESIDUE)))
              .otherwise(F.concat(row, F.lit(GAP))))
    return alignment.withColumn("row", capped)


def alignment_text(alignment: DataFrame, key: str) -> DataFrame:
    """The records of an alignment as one text per id, in file order.

    An alignment is one field of a job document, so it is a text of its own by
    design and has to fit into one row; the ids, not the records, are what grows.
    """
    record = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("row"), F.lit("\n"))
    rows = alignment.select(key, F.struct("at", record.alias("record")).alias("_r"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["record"]), "")
    return rows.groupBy(key).agg(text.alias("msa"))


def alignment_depth(text: str) -> Column:
    """Number of ``>`` characters in an alignment text."""
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(">"), F.lit("")))


def peptide_entity(sequence: Column, msa: Column) -> Column:
    """The peptide chain as an entity of a job document."""
    cap = F.struct(F.lit(CAP_MODIFICATION).alias("ptmType"),
                   F.length(sequence).alias("ptmPosition"))
    return F.struct(F.struct(
        F.lit(CHAIN).alias("id"),
        sequence.alias("sequence"),
        F.array(cap).alias("modifications"),
        msa.alias("unpairedMsa"),
        F.lit("").alias("pairedMsa"),
        F.array().cast("array<string>").alias("templates"),
    ).alias("protein"))


def templates_with_chain(templates: DataFrame, key: str, chain: str = CHAIN) -> DataFrame:
    """Keys of templates that already have the chain, as any kind of entity.

    An entity names one chain or a list of them.
    """
    entities = F.from_json("document", "struct<sequences: array<map<string, struct<id: string>>>>")["sequences"]
    one = F.lit(chain)
    listed = F.lit(f'"{chain}"')
    taken = F.exists(entities, lambda e: F.exists(F.map_values(e), lambda v: (v["id"] == one) | v["id"].contains(listed)))
    return templates.where(F.coalesce(taken, F.lit(False))).select(key)


def job_documents(jobs: DataFrame, templates: DataFrame, key_col: str, sequence: str, msa: str,
                  seed: int | None = None) -> DataFrame:
    """(job, document) with the peptide appended to the template of the job's key.

    ``templates`` has one row per key and the template's JSON text, ``document``.
    The text is taken apart only as far as needed: the entities and all other
    fields are passed on as they are, whatever they hold. The new document has
    the job's name and, if given, the seed. It is JSON text too.
    """
    replaced = ["name", "sequences"] + ["modelSeeds"] * (seed is not None)
    fields = templates.select(key_col, F.parse_json("document").alias("_v")).lateralJoin(
        templates.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    rest = (fields.where(~F.col("key").isin(replaced)).groupBy(key_col)
            .agg(F.array_sort(F.collect_list(F.concat(_quoted("key"), F.lit(":"), F.to_json("value")))).alias("_rest")))
    entities = F.from_json("document", "struct<sequences: array<string>>")["sequences"]
    parts = templates.select(key_col, F.coalesce(entities, F.array().cast("array<string>")).alias("_entities")).join(
        rest, key_col, "left")

    head = [F.struct(F.col("job").alias("name"))]
    if seed is not None:
        head.append(F.struct(F.array(F.lit(seed)).alias("modelSeeds")))
    texts = [F.array(*[_inside(F.to_json(h)) for h in head]), F.coalesce("_rest", F.array().cast("array<string>")),
             F.array(F.concat(F.lit('"sequences":['), F.array_join(F.array_append(
                 "_entities", F.to_json(peptide_entity(F.col(sequence), F.col(msa)))), ","), F.lit("]")))]
    document = F.concat(F.lit("{"), F.array_join(F.concat(*texts), ","), F.lit("}"))
    return jobs.join(parts, key_col).select("job", document.alias("document"))


def _inside(json: Column) -> Column:
    """The fields of a JSON object, without its braces."""
    return json.substr(F.lit(2), F.length(json) - 2)


def _quoted(name: str) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(name))
    return _inside(array)
