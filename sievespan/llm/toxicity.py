"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary text.

A word's probability in a class is its discounted continuation count: in how
many different contexts (words before it) the class has it. A passage that is
copied a thousand times has one context, so copies don't pass for evidence.
What the discount takes away goes to a backoff that both classes share, the
continuation counts of all texts of both, so that a rare expression gets about the
same probability from either. The discount takes the same share of both
classes, however unequal they are. Words are told apart by 64-bit hashes, in a
written table that grows with the texts. Of those whose counts exceed the discount
the ``CELLS`` most frequent go to every task, which is a matter of speed: words beyond
them are joined to the table. All others have the log-ratio of an unknown word.

A text is compared by its length-normalised log-likelihoods under both models,
as a whole and in its worst stretch of ``STRETCH`` words. A logistic function of
both differences gives the score; it and the discount are fitted on a bounded
number of labelled texts, with counts that leave these out. The final counts cover
all labelled texts of the folds other than 0, these included. Texts without
words have differences of 0. A null id belongs to no training fold. Labels that
contradict each other for one id count for both classes; without labels of both
classes every score is about 0. Repeated rows get the same score, and repeated
labels count once.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .words import hashes, word_list

CELLS = 1 << 16     # most frequent words, whose counts every task holds; others are joined
CONTEXT_BITS = 40
OCCURRENCE = np.dtype([("word", np.int64), ("before", np.int64)])
CLASSES = ("ordinary", "toxic")
DISCOUNTS = (0.75, 2.0, 4.0, 8.0, 16.0, 32.0)
STRETCH = 5
FOLDS = 5           # fold 0 is held out, all others are counted, the last one also calibrates
CALIBRATION_ROWS = 20_000    # labelled texts at most that weights and discount are fitted on, by hash of their id
BUFFER = 1 << 20    # words a task counts at once
MOST_BITS = 1 << 28    # of a set that every task holds, 32 MB; beyond 16 million entries it lets more through that are none


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def word_hashes(text: bytes) -> np.ndarray:
    words = word_list(text)
    return hashes(words, len(words))


def occurrences(word: np.ndarray) -> np.ndarray:
    """Each word's hash and a hash of the word before it (0 before the first)."""
    out = np.zeros(len(word), OCCURRENCE)
    out["word"] = word.view(np.int64)
    out["before"][1:] = (word[:-1] >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)
    return out


class Lexicon(NamedTuple):
    """Log-ratios by discount (rows): of the ``CELLS`` most frequent words, and of words without counts."""
    words: np.ndarray      # hashes, sorted
    gains: np.ndarray
    unknown: np.ndarray
    discounts: tuple[float, ...]
    sums: tuple[tuple, ...]
    others: np.ndarray | None    # bit set of the words that have to be joined

    def looked_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-ratios by discount and word, and which words may be among those that are joined."""
        if not len(self.words):
            return np.repeat(self.unknown[:, None], len(word), 1), np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        absent = self.words[at] != word
        missing = absent if self.others is None else absent & _may_hold(self.others, word)
        return np.where(absent, self.unknown[:, None], self.gains[:, at]), missing

    def ratios(self, counts: np.ndarray) -> np.ndarray:
        return np.array([log_ratios(counts, d, s) for d, s in zip(self.discounts, self.sums)])


class Model(NamedTuple):
    gains: np.ndarray      # log-probability in toxic text minus that in ordinary text, of the most frequent words
    weights: np.ndarray    # bias, whole text, worst stretch
    lexicon: Lexicon
    rare: DataFrame | None    # word, ordinary, toxic: all other words that tell the classes apart


def differences(gain: np.ndarray) -> tuple[float, float]:
    """Toxic minus ordinary log-likelihood by word: of the whole text, and of the worst stretch."""
    if not len(gain):
        return 0.0, 0.0
    total, n = np.append(0, np.cumsum(gain)), min(STRETCH, len(gain))
    return float(gain.mean()), float((total[n:] - total[:-n]).max() / n)


def continuation_counts(docs: DataFrame) -> DataFrame:
    """word (its hash), and in how many contexts ordinary and toxic texts have it.

    ``docs`` has ``text`` (binary), ``toxic`` (0 or 1) and ``fits`` (boolean): fit_ordinary and
    fit_toxic leave out texts that the weights are fitted on, ordinary and toxic have all.
    """
    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = ([], [], [], []), 0
        for batch in batches:
            for text, toxic, fits in zip(batch["text"], batch["toxic"], batch["fits"]):
                keys = occurrences(word_hashes(text))
                held[toxic + 2 * bool(fits)].append(keys)
                size += len(keys)
            if size >= BUFFER:
                yield _distinct(held)
                held, size = ([], [], [], []), 0
        yield _distinct(held)

    # bits: 1 ordinary, 2 toxic, 4 and 8 the same in texts that the weights are fitted on
    pairs = docs.mapInPandas(seen, "word long, before long, ordinary boolean, toxic boolean, bits int").groupBy(
        "word", "before").agg(F.bit_or("bits").alias("bits"))

    def having(mask: int) -> Column:
        return F.count_if(F.col("bits").bitwiseAND(F.lit(mask)) > 0)

    return pairs.groupBy("word").agg(having(1).alias("fit_ordinary"), having(2).alias("fit_toxic"),
                                     having(5).alias("ordinary"), having(10).alias("toxic"))


def _distinct(held: tuple[list, ...]) -> pd.DataFrame:
    own = [np.concatenate(h) if h else np.empty(0, OCCURRENCE) for h in held]
    keys = np.concatenate(own)
    bits = np.repeat([1 << i for i in range(len(own))], [len(k) for k in own]).astype(np.int32)
    order = np.lexsort((keys["before"], keys["word"]))
    keys, bits = keys[order], bits[order]
    start = np.nonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])[0]
    bits = np.bitwise_or.reduceat(bits, start) if len(start) else bits
    return pd.DataFrame({"word": keys["word"][start], "before": keys["before"][start],
                         "ordinary": bits & 5 > 0, "toxic": bits & 10 > 0, "bits": bits})


def log_ratios(counts: np.ndarray, discount: float, sums: tuple | None = None) -> np.ndarray:
    """By word the log of its probability in toxic over that in ordinary text, from
    continuation counts by class (ordinary, toxic) and word; ``sums`` are those of all
    words: the counts by class, what the discount leaves of them, and the backoff."""
    total, left, backoff = sums or (counts.sum(1), None, (counts.sum(0) + 1).sum())
    n = np.maximum(np.reshape(total, (2, 1)), 1)
    kept = np.maximum(counts - discount * n / n.min(), 0)
    left = kept.sum(1, keepdims=True) if left is None else np.reshape(left, (2, 1))
    p = (kept + (n - left) * (counts.sum(0) + 1) / backoff) / n
    return np.log(np.maximum(p[1], 1e-300)) - np.log(np.maximum(p[0], 1e-300))


def _lexicon(table: DataFrame, discounts: tuple[float, ...]) -> tuple[Lexicon, DataFrame | None]:
    """The most frequent words of word, ordinary and toxic counts, and the other words if there are any.

    A word of which the least discount leaves nothing in either class has the log-ratio of an unknown word,
    whatever its count, so these words need no place in either.
    """
    table = table.where("ordinary + toxic > 0")
    size, *total = table.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in CLASSES]).first()
    n = np.maximum(np.array(total, float), 1)
    left = table.agg(*[F.coalesce(F.sum(F.greatest(F.col(c) - F.lit(float(d * n[i] / n.min())), F.lit(0.0))), F.lit(0.0))
                       for d in discounts for i, c in enumerate(CLASSES)]).first()
    sums = tuple((tuple(total), tuple(left[2 * i:2 * i + 2]), sum(total) + size) for i in range(len(discounts)))
    sums = tuple((t, kept, max(backoff, 1)) for t, kept, backoff in sums)
    least = min(discounts)
    telling = table.where(" OR ".join(f"{c} > {float(least * n[i] / n.min())!r}D" for i, c in enumerate(CLASSES)))
    ranked = telling.orderBy(F.desc(F.col("ordinary") + F.col("toxic")), "word").limit(CELLS)
    most = ranked.toPandas().sort_values("word")
    counts = most[list(CLASSES)].to_numpy(float).T.reshape(2, len(most))
    lexicon = Lexicon(most["word"].to_numpy(np.int64), np.array([log_ratios(counts, d, s) for d, s in zip(discounts, sums)]),
                      np.array([log_ratios(np.zeros((2, 1)), d, s)[0] for d, s in zip(discounts, sums)]), discounts, sums, None)
    if len(most) < CELLS:
        return lexicon, None
    held = table.sparkSession.createDataFrame(pd.DataFrame({"word": lexicon.words}), "word long")
    rare = telling.join(F.broadcast(held), "word", "left_anti")
    return lexicon._replace(others=_bit_set(rare, "word")), rare


def _compared(docs: DataFrame, lexicon: Lexicon, rare: DataFrame | None, text: str) -> DataFrame:
    """``docs`` with ``_x``: both differences, by discount. Words beyond the most frequent ones are
    joined to their counts by text, of which only a hash moves with ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    flat = lambda gains: [v for g in gains for v in differences(g)]

    @F.pandas_udf("array<double>")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([flat(shared.value.looked_up(word_hashes(t).view(np.int64))[0]) for t in texts], dtype=object)

    if rare is None:
        return docs.withColumn("_x", known(content))

    # a text with missing words goes on as places of its words among the most frequent ones, and what is missing where
    @F.pandas_udf("struct<x: array<double>, words: binary, missing: array<long>, places: binary>")
    def looked_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                word = word_hashes(t).view(np.int64)
                gains, missing = shared.value.looked_up(word)
                if not missing.any():
                    out.append((flat(gains), None, None, None))
                    continue
                # words without a place take the last one, which stands for an unknown word
                known = np.minimum(np.searchsorted(shared.value.words, word), len(shared.value.words) - 1)
                at = np.where(shared.value.words[known] == word, known, len(shared.value.words)).astype("<u4")
                own, which = np.unique(word[missing], return_inverse=True)
                places = np.stack([np.nonzero(missing)[0], which]).astype("<i4")
                out.append((None, at.tobytes(), own, places.tobytes()))
            yield pd.DataFrame(out, columns=["x", "words", "missing", "places"])

    @F.pandas_udf("array<double>")
    def filled(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for words, missing, places, found, ordinary, toxic in zip(*batch):
                gains = np.append(shared.value.gains, shared.value.unknown[:, None], 1)[:, np.frombuffer(words, "<u4")]
                own = np.repeat(shared.value.unknown[:, None], len(missing), 1)
                if found is not None and len(found):
                    own[:, np.searchsorted(missing, found)] = shared.value.ratios(np.array([ordinary, toxic], float))
                where, which = np.frombuffer(places, "<i4").reshape(2, -1)
                gains[:, where] = own[:, which]
                out.append(flat(gains))
            yield pd.Series(out, dtype=object)

    key = F.struct(F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b"))
    coded = written(docs.select(key.alias("_key"), looked_up(content).alias("l")).select("_key", "l.*"), "coded")
    wanted = coded.where("words IS NOT NULL").dropDuplicates(["_key"])
    counts = (wanted.select("_key", F.explode("missing").alias("word")).join(rare, "word")
              .groupBy("_key").agg(F.collect_list(F.struct("word", *CLASSES)).alias("c")))
    late = wanted.select("_key", "words", "missing", "places").join(counts, "_key", "left").select(
        "_key", filled("words", "missing", "places", "c.word", *[f"c.{c}" for c in CLASSES]).alias("_x"))
    found = coded.where("words IS NULL").select("_key", F.col("x").alias("_x")).dropDuplicates(["_key"]).unionByName(late)
    return docs.withColumn("_key", key).join(found, "_key").drop("_key")


def _bit_set(hashes: DataFrame, name: str) -> np.ndarray:
    """A set of hashes with some 16 bits for each of them, up to ``MOST_BITS``, as numbers of 64 bits; that it holds
    a hash may be wrong, that it doesn't may not. Its size and not their number bounds what the driver gets."""
    size = min(MOST_BITS, max(1 << 10, 1 << (16 * hashes.count()).bit_length()))
    place = F.col(name).bitwiseAND(F.lit(size - 1))
    words = (hashes.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toPandas())
    held = np.zeros(size >> 6, np.int64)
    held[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return held


def _may_hold(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & (64 * len(held) - 1)
    return (held[place >> 6] >> (place & 63) & 1).astype(bool)


def _may_be_labelled(marked: DataFrame, column: str) -> Column:
    """Whether an id may have a label: false only for ids without one."""
    place = F.xxhash64(F.col(column).cast("string"))
    shared = marked.sparkSession.sparkContext.broadcast(_bit_set(marked.select(place.alias("h")), "h"))

    @F.pandas_udf("boolean")
    def among(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series(_may_hold(shared.value, h.to_numpy(np.int64)))

    return among(place)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """Both models and the weights, learned from rows of folds other than 0."""
    marked = labels.where(F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).distinct()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    counted = fold(F.col("doc_id")).between(1, FOLDS - 1)
    chosen = written(marked.where(fold(F.col("doc_id")) == FOLDS - 1)
                     .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(CALIBRATION_ROWS), "chosen")
    fits = F.broadcast(chosen.select("doc_id").distinct().withColumn("fits", F.lit(True)))
    # labels grow with the texts, so they are merged at any size; texts without one stay where they are
    known = texts.where(counted).where(_may_be_labelled(marked, "doc_id")).join(marked.where(counted).join(fits, "doc_id", "left").hint("merge"), "doc_id").select(
        "text", "toxic", F.coalesce("fits", F.lit(False)).alias("fits"))
    table = written(continuation_counts(known), "words")

    lexicon, rare = _lexicon(table.select("word", F.col("fit_ordinary").alias("ordinary"), F.col("fit_toxic").alias("toxic")),
                             DISCOUNTS)
    sample = texts.join(F.broadcast(chosen), "doc_id")    # of bounded size: texts needn't move
    fitted = _compared(sample, lexicon, rare, "text").select("_x", "toxic").toPandas()
    x = np.array(fitted["_x"].tolist()).reshape(len(fitted), len(DISCOUNTS), 2)
    y = fitted["toxic"].to_numpy(float)
    order = np.lexsort((y, *x.reshape(len(x), 2 * len(DISCOUNTS)).T))    # sums don't depend on the order of rows
    x, y = x[order], y[order]
    tried = [_logistic(x[:, i], y) for i in range(len(DISCOUNTS))]
    best = int(np.argmin([loss for loss, _ in tried]))
    lexicon, rare = _lexicon(table.select("word", *CLASSES), DISCOUNTS[best:best + 1])
    return Model(lexicon.gains[0], tried[best][1], lexicon, rare)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """Loss, and bias and weights by Newton steps; nothing is toxic without examples of both classes."""
    if not len(y) or y.min() == y.max():
        return 0.0, np.array([-30.0, 0.0, 0.0])
    x = np.column_stack([np.ones(len(x)), x])
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    z = np.clip(x @ w, -30, 30)
    return float(np.mean(np.log1p(np.exp(z)) - y * z)), w / scale


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with column ``name``: from 0 to 1, higher where toxic is likelier."""
    bias, whole, worst = (F.lit(float(w)) for w in model.weights)
    z = bias + whole * F.col("_x")[0] + worst * F.col("_x")[1]
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return _compared(docs, model.lexicon, model.rare, text).withColumn(name, 1 / (1 + F.exp(-z))).drop("_x")
