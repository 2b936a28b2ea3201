"""Periodic runs of words in a text, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) that holds at least ``EXPONENT`` periods and ``LEAST`` words and that
no neighbouring word extends. In such a run each word stands ``EXPONENT`` times
or more, so a word that stands fewer times in a segment belongs to no run there:
it splits the segment. The parts are counted anew and split in turn, until no
word is too rare; a part of fewer than ``LEAST`` words is given up. Most texts
are gone then, and what is left is scanned lag by lag. Of a run with lag q, the
places that are multiples of q come ``EXPONENT`` times, so only these are
compared, which is n/q places for lag q, and what agrees is followed word by
word. A stretch within a run of a smaller lag repeats that run, and isn't
followed. A text of n words so costs about n log n, long rows of one word too.

Words are what stands between ASCII white space. A null text has no words. Texts
are taken row by row, each whole in one task: repeated ids and repeated rows are
rows of their own, a null id changes nothing, and other columns stay as they are.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

EXPONENT = 4    # periods that a run holds at least
LEAST = 6       # words that a run has at least
WORD = r"[^\x20\x09-\x0D]+"
_word = re.compile(r"[^\x20\x09-\x0d]+")
_runs = "array<struct<start: long, length: long, period: long>>"


def segments(codes: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int]]:
    """The stretches (start, end) of words that frequency splitting leaves, in order.

    ``codes`` numbers the words. Only segments that were split are counted again.
    """
    out = []
    start, place = np.zeros(1, np.int64), np.arange(len(codes))    # of the open segments; of their words, and the segment of each
    owner = np.zeros(len(codes), np.int64)
    size = np.array([len(codes)])
    while len(place):
        pair = owner * (int(codes.max()) + 1) + codes[place]
        _, kind, count = np.unique(pair, return_inverse=True, return_counts=True)
        kept = count[kind] >= exponent
        whole = np.bincount(owner, kept, len(size)) == size
        out += [(s, s + n) for s, n in zip(start[whole].tolist(), size[whole].tolist()) if n >= least]
        left = kept & ~whole[owner]
        place, owner = place[left], owner[left]
        if not len(place):
            break
        fresh = np.append(True, (np.diff(place) > 1) | (np.diff(owner) > 0))
        owner = np.cumsum(fresh) - 1
        start, size = place[fresh], np.bincount(owner)
        long = size >= least
        place, owner = place[long[owner]], owner[long[owner]]
        owner = (np.cumsum(long) - 1)[owner]
        start, size = start[long], size[long]
    return sorted(out)


def _stretch(w: np.ndarray, place: int, lag: int) -> tuple[int, int]:
    """Start and end of the longest stretch around ``place`` where words ``lag`` apart are equal."""
    def equal(a, b):    # how many words in front agree, looked at in growing blocks
        done, step, n = 0, 64, min(len(a), len(b))
        while done < n:
            other = np.flatnonzero(a[done:done + step] != b[done:done + step])
            if len(other):
                return done + int(other[0])
            done, step = min(done + step, n), step * 4
        return n

    right = equal(w[place:len(w) - lag], w[place + lag:])
    left = equal(w[:place][::-1], w[lag:place + lag][::-1])
    return place - left, place + lag + right


def lag_scan(w: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment."""
    n, out = len(w), []
    reach = np.zeros(n, np.int64)    # by place the farthest end of the runs that hold it
    for q in range(1, n // exponent + 1):
        marks = w[::q]
        if len(marks) < exponent:
            break
        last = len(marks) - exponent + 1
        alike = marks[:last] == marks[1:last + 1]
        for step in range(1, exponent - 1):
            alike &= marks[step:last + step] == marks[step + 1:last + step + 1]
        at = np.flatnonzero(alike) * q
        for inner in (q // 2, q // 4, 3 * q // 4):    # places in between must agree as well; most chance hits end here
            if inner and len(at):
                at = at[w[at + inner] == w[at + inner + q]]
        at = at[reach[at] <= at + (exponent - 1) * q]
        end = -1
        for place in at.tolist():
            if place + q < end or reach[place] > place + (exponent - 1) * q:
                continue    # in a stretch that was followed before, or in a run of a smaller period
            start, end = _stretch(w, place, q)
            if end - start >= max(least, exponent * q) and reach[start] < end:
                out.append((start, end - start, q))
                np.maximum(reach[start:end], end, out=reach[start:end])
    return out


def periodic_runs(words: list, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < least:
        return []
    codes = pd.factorize(np.array(words, object))[0]
    out = [(a + start, length, period) for a, b in segments(codes, exponent, least)
           for start, length, period in lag_scan(codes[a:b], exponent, least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [word for word, held in zip(words, np.cumsum(drop).tolist()) if not held]


def add_runs(docs: DataFrame, text: str = "text", name: str = "periodic", exponent: int = EXPONENT,
             least: int = LEAST) -> DataFrame:
    """``docs`` with a struct ``name``: n_words, runs (start, length and period in words, by
    start, then period) and collapsed, the kept words joined by a space. A column of that name is replaced."""

    @F.pandas_udf(f"struct<n_words: long, runs: {_runs}, collapsed: string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                words = _word.findall(t)
                runs = periodic_runs(words, exponent, least)
                out.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs],
                            " ".join(kept_words(words, runs))))
            yield pd.DataFrame(out, columns=["n_words", "runs", "collapsed"])

    return docs.withColumn(name, found(F.coalesce(F.col(text), F.lit(""))))


def longest(runs: Column) -> Column:
    """The run of greatest length, of these the one of smallest start, then period; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))


def collapsed(docs: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """``docs`` with repeats taken out of the texts. A text without runs stays as it is, white space included, and null stays null."""
    own = add_runs(docs, text, "_periodic", exponent, least)
    return own.withColumn(text, F.when(F.size("_periodic.runs") > 0, F.col("_periodic.collapsed")).otherwise(F.col(text))
                          ).select(*docs.columns)


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, where a tenth of the texts, chosen by a hash of the id, ends in a periodic run.

    With h the crc32 of the decimal id and g = floor(h / 10), texts with h % 10 = 0 repeat
    from word a = g % n on the p = 1 + floor((n - a) / (3 + g % 8)) words that stand there.
    Rows without an id stay as they are. Words of such a text are joined by a space.
    """
    h = F.crc32(F.col(doc_id).cast("string"))
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.floor(h / 10).alias("g"),
                         F.when(h % 10 == 0, F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("w"))
    n = F.size("w")
    placed = chosen.withColumn("n", F.when(n > 0, n)).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    placed = placed.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    words = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), rest))
    return placed.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(F.array_join(words, " ")).alias("text"))
