import zlib

import numpy as np
from pyspark.sql import functions as F

from sievespan.llm import quality, toxicity
from sievespan.llm.queries import op2_quality, op4_toxicity

FOLDER = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_texts(spark):
    got = op4_toxicity(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    called = [r for r in rows if r.predicted]
    assert got.count() == docs.count() and len(rows) > 500
    assert sum(r.toxic for r in called) > 0.85 * len(called)
    # a third of these labels has nothing in the text to learn them from
    assert sum(r.toxic for r in called) > 0.5 * sum(r.toxic for r in rows)
    for r in got.limit(500).collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_labels_change_nothing(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.gains, b.gains) and np.array_equal(a.weights, b.weights)


def test_copies_of_a_passage_are_one_context():
    words = toxicity.word_hashes(b"one two three")
    held = ([np.tile(toxicity.occurrences(words), 50)], [toxicity.occurrences(words)])
    found = toxicity._distinct(held)
    assert len(found) == 3 and found.ordinary.all() and found.toxic.all()


def test_rare_words_say_nothing():
    counts = np.zeros((2, toxicity.CELLS))
    counts[:, :1000] = np.array([[90.0], [10.0]])    # as often in either class
    counts[1, 2005], counts[0, 2006] = 300, 3000
    counts[0, 2007] = 1
    gain = toxicity.log_ratios(counts, 4.0)
    assert gain[2005] > 2 and gain[2006] < -1 and abs(gain[2007] - gain[60_000]) < 1e-9 and abs(gain[60_000]) < 0.2


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 2 + [(3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.scored(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(no_docs, model).count() == 0
    assert max(r.score for r in toxicity.scored(odd_docs, toxicity.fit(odd_docs, labels.limit(0))).collect()) < 0.01
    assert toxicity.fit(no_docs, labels).weights[0] == -30


def test_quality_on_labels_not_trained_on(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    judged = quality.scored(docs, half).join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "good"), "doc_id")
    rows = judged.select((F.col("quality") >= 0.5).alias("kept"), "good").collect()
    good, poor = [r.kept for r in rows if r.good], [r.kept for r in rows if not r.good]
    assert sum(good) > 0.995 * len(good) and sum(poor) < 0.03 * len(poor)


def test_quality_query_has_every_document(spark):
    got = op2_quality(spark, "/root/testdata/sf0.01")
    assert got.count() == got.select("doc_id").distinct().count() == 1000
    assert got.where("NOT quality BETWEEN 0 AND 1 OR accepted <> (quality >= 0.5)").count() == 0


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "x", 0.2)] * 400 + [("big", "y", 0.3)] * 2 + [("good", "x", 0.9)] * 400 + [("new", "x", 0.0)]
    sites, share = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    found = {(r.host, r.path): (r.host_posterior, r.path_posterior) for r in sites.collect()}
    assert abs(share - (80 + 0.6 + 360) / 803) < 1e-9
    assert found["big", "x"][0] < 0.25 and found["good", "x"][0] > 0.85
    assert 0 < found["new", "x"][0] < share and found["new", "x"][1] < share
    assert found["big", "x"][1] < found["big", "y"][1] < 0.3


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 0), (1, 0), (6, 1), (8, 1), (8, 1), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.scored(odd_docs.drop("quality"), labels)
    assert got.count() == odd_docs.count() and got.where("quality IS NULL").count() == 0
    kept = quality.accepted(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.where("quality <> 3").count() == 0
    assert quality.accepted(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality.accepted(no_docs, labels).count() == 0


def test_properties_tell_repeats_and_signs():
    at = quality.PROPERTIES.index
    assert quality.properties(b"Of Of Of Of")[at("repeats")] == 0.75
    assert quality.properties(b"a | b | c")[at("bare_signs")] == 0.4
    assert quality.properties(b"to### of&&& it")[at("signed_words")] == 2 / 3
    assert quality.properties(b"") == [0.0] * len(quality.PROPERTIES)


def test_rare_words_have_counts_of_their_own(spark, monkeypatch):
    """Words beyond the most frequent ones are joined to the table, with the same scores."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    def scores():
        return {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).select("doc_id", "score").collect()}
    whole = scores()
    monkeypatch.setattr(toxicity, "CELLS", 100)
    parts = scores()
    assert whole.keys() == parts.keys() and all(abs(whole[i] - parts[i]) < 1e-6 for i in whole)


def test_each_word_is_counted_for_itself_and_fold_4_too(spark):
    words = [f"word{i}" for i in range(100_000)]
    texts = [(" ".join(words[i:i + 1000]).encode(), 0, False) for i in range(0, 100_000, 1000)] + [(b"vile vile thing", 1, True)]
    table = toxicity.continuation_counts(spark.createDataFrame(texts, "text binary, toxic int, fits boolean"))
    assert table.count() == 100_002
    vile = table.where(F.col("word") == int(toxicity.word_hashes(b"vile").view(np.int64)[0])).first()
    assert (vile.fit_toxic, vile.toxic, vile.ordinary) == (0, 2, 0)


def test_what_only_fold_4_has_is_known_to_the_model(spark):
    def text(i):
        fold = zlib.crc32(str(i).encode()) % toxicity.FOLDS
        return f"calm{i % 97} " + ("walk" if i % 2 else "vilest" if fold == 4 else "nasty") + f" calm{i % 89}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(1000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    gain = {w: model.lexicon.looked_up(toxicity.word_hashes(w).view(np.int64))[0][0, 0] for w in (b"vilest", b"walk", b"other")}
    assert gain[b"vilest"] > gain[b"other"] + 0.3 > gain[b"walk"]
