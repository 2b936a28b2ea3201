"""Document quality: a text classifier, and posteriors of hosts and paths.

A logistic model over simple properties of a text gives each document's own
evidence. Sites add theirs: the share of good documents of a host is estimated
by empirical Bayes, shrunk towards the global share the more the fewer documents
it has, and that of a path within the host towards the host's. How strongly is
estimated from how much hosts, and paths within hosts, differ. A document's log
odds are its own plus what its path adds to the global ones.

Site sums are one aggregation over all documents, combined before the shuffle,
so a host of any size costs a row per task. What comes to the driver are three
rows and the training sample, at most ``TRAINING_ROWS`` labelled documents.

Null and empty texts have properties of 0. Null hosts or paths count as empty
ones. Without labels of both kinds all documents' own evidence is one half, and
every document is kept. Repeated rows are judged alike and count each. Columns
other than the text, host and path pass through.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

TRAINING_ROWS = 50_000    # labelled documents at most, by hash of their id
THRESHOLD = 0.5
CLIP = 1e-4               # no evidence is more certain than that
LEAST, MOST = 1.0, 1e6    # bounds of a prior's weight, in documents

LETTER, UPPER, DIGIT, SPACE, STOP, SIGN, WIDE = range(7)
_CLASS = np.array([
    LETTER if 97 <= b <= 122 else UPPER if 65 <= b <= 90 else DIGIT if 48 <= b <= 57 else SPACE if b in b" \t\r\n"
    else STOP if b in b".,;:'\"?-()" else WIDE if b >= 128 else SIGN for b in range(256)], np.uint8)
PROPERTIES = ["letters", "upper", "digits", "spaces", "stops", "signs", "wide", "log_words", "word_length",
              "different_words", "repeats", "bare_signs", "different_lines", "words_per_line", "signed_words"]


def properties(text: bytes) -> list[float]:
    """What the classifier sees of a text."""
    words = text.split()
    if not words:
        return [0.0] * len(PROPERTIES)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7) / len(text)
    lines = [x for x in text.split(b"\n") if x]
    n = len(words)
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    bare = sum(len(w) == 1 and not w.isalnum() and w[0] < 128 for w in words) / n
    signed = sum(_CLASS[w[-1]] == SIGN for w in words) / n
    return [*kinds.tolist(), float(np.log(n)), sum(map(len, words)) / n, len(set(words)) / n, repeats, bare,
            len(set(lines)) / len(lines), float(np.log(n / len(lines))), signed]


class Classifier(NamedTuple):
    weights: np.ndarray    # bias first

    def probability(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([properties(t) for t in texts]).reshape(-1, len(PROPERTIES))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _as_bytes(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", rows: int = TRAINING_ROWS, ridge: float = 1.0) -> Classifier:
    """The classifier fitted to labelled documents (Newton steps)."""
    chosen = (labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("good"))
              .distinct().orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "good").limit(rows))
    # of bounded size: texts needn't move
    known = docs.select(F.col(doc_id).alias("_id"), _as_bytes(text).alias("text")).join(F.broadcast(chosen), "_id")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [properties(t) for t in batch["text"]], "good": batch["good"]})

    found = known.mapInPandas(seen, "x array<double>, good int").toPandas()
    y = found["good"].to_numpy(float)
    w = np.zeros(len(PROPERTIES) + 1)
    if not len(y) or y.min() == y.max():
        return Classifier(w)
    x = np.array(found["x"].tolist())
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
    return Classifier(np.append(w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread))


def _odds(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))
    return F.log(q / (1 - q))


def _prior_weight(groups: DataFrame, mean: str, centre: Column) -> float:
    """How many documents a prior is worth: the less the groups' means differ, the more.

    ``groups`` has n and ``mean``. What differs by chance, given their sizes, is taken off.
    """
    spread = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.pow(F.col(mean) - centre, 2)).alias("s"),
        F.sum(F.col("n") * centre * (1 - centre)).alias("v")).first()
    if not spread["n"] or not spread["v"]:
        return MOST
    one = spread["v"] / spread["n"]
    between = spread["s"] / spread["n"] - one * spread["k"] / spread["n"]
    return float(min(max(one / between - 1, LEAST), MOST)) if between > 0 else MOST


def site_posteriors(documents: DataFrame) -> tuple[DataFrame, float]:
    """host, path, host_posterior and path_posterior, and the global share.

    ``documents`` has host, path and p, the probability that a document is good.
    """
    paths = written(documents.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn(
        "mean", F.col("good") / F.col("n"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = whole["good"] / whole["n"] if whole["n"] else 0.5
    weight = _prior_weight(hosts, "mean", F.lit(share))
    hosts = hosts.select("host", ((F.col("good") + weight * share) / (F.col("n") + weight)).alias("host_posterior"))
    placed = paths.join(hosts, "host").withColumn("mean", F.col("good") / F.col("n"))
    weight = _prior_weight(placed, "mean", F.col("host_posterior"))
    return placed.select("host", "path", "host_posterior", (
        (F.col("good") + weight * F.col("host_posterior")) / (F.col("n") + weight)).alias("path_posterior")), share


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
           path: str = "lang", label: str = "quality") -> DataFrame:
    """``docs`` with columns ``own_quality``, ``host_posterior``, ``path_posterior`` and ``quality`` (all 0 to 1)."""
    classifier = train(docs, labels, doc_id, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.probability(texts.tolist()))

    own = docs.drop("own_quality", "host_posterior", "path_posterior", "quality", "_host", "_path").withColumns({
        "own_quality": probability(_as_bytes(text)),
        "_host": F.coalesce(F.col(host).cast("string"), F.lit("")),
        "_path": F.coalesce(F.col(path).cast("string"), F.lit(""))})
    sites, share = site_posteriors(own.select(F.col("_host").alias("host"), F.col("_path").alias("path"),
                                              F.col("own_quality").alias("p")))
    sites = sites.withColumnsRenamed({"host": "_host", "path": "_path"})
    odds = _odds(F.col("own_quality")) + _odds(F.col("path_posterior")) - _odds(F.lit(float(share)))
    return (own.join(sites, ["_host", "_path"]).withColumn("quality", 1 / (1 + F.exp(-odds)))
            .drop("_host", "_path"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
             path: str = "lang", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose quality reaches the threshold, with their own columns."""
    judged = scored(docs.withColumn("_whole", F.struct(*docs.columns)), labels, doc_id, text, host, path, label)
    return judged.where(F.col("quality") >= threshold).select("_whole.*")
