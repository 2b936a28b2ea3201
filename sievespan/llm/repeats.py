"""Passages that repeat across documents, exactly or with small changes.

Seeds are k-mers of words, thinned by winnowing: of every ``WINDOW`` k-mers in a
row at least the one of least hash is kept, so passages of WINDOW + K - 1 equal
words share a seed. Rows of one word are numbered, so that they meet place by place. Each
occurrence of a seed is joined to one place in the first document that has it, its
anchor, and not to all others, so a seed costs a row per occurrence however often
it repeats; occurrences in the anchor document itself are joined to the last
document that has the seed. The matches of a document with an anchor
document are chained: ordered in both, each seed gains its length and pays for
the gap to the one before, and a Fenwick tree over the places in the anchor
document finds the best one before. Chains are then aligned word by word, which
fills the gaps and moves the ends, cut where they agree too little, and judged
part by part.

Aligned stretches that a document shares with one and the same other document are
joined over gaps of ``BRIDGE`` words, and what is long enough is a passage; passages
that overlap, shared with whichever documents, are one.
If each part of a passage has another anchor, few seeds may be left for any pair of documents.
So a second pass takes all windows of ``LENGTH`` words whose seeds are all repeated
and that no passage holds so far, and looks for equal ones by hash: every window
that another document has exactly is found, whatever its seeds were matched with.
Stretches are grouped by pair of documents, and a document's passages are reduced to one
per start before they are shuffled, so a document that anchors a third of all others is no large group.

Seeds, and then pairs of documents, go through the exchange in ``PARTS``, one part written before the next
begins, and what an exchange left on disk is dropped with it; so the disk holds the words, the
matches and the exchanges of one part.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
in lower case. Null and empty texts have no passages. Repeats within one
document don't count. Repeated rows are documents of their own, so they repeat
each other. Rows without an id are compared as well; their passages carry null.
"""

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from operator import lt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settings, written
from .words import hashes, word_list

K = 5               # words of a seed
WINDOW = 4          # seeds in a row of which one is kept
RUN = 16            # of equal seeds in a row one of so many is kept
LENGTH = 50         # a passage has so many words at least
BRIDGE = 20         # words between two stretches of one passage at most
LEAST_SEEDS = 2     # that two documents share, for which their words are compared
STRETCH = 20        # words that a part of an aligned chain must cover
IDENTITY = 0.8      # of the words of a part
GAP = 0.1           # cost of a word in a gap, on either side
CHANGE = 4          # cost of a changed word where an equal one gains 1: nothing is gained at an identity of 0.8
DROP = 20           # an end is followed until it lies so far below the best
SKIP = 4            # words changed in a row, at an end
_STEPS = sorted(((i, j) for i in range(SKIP + 1) for j in range(SKIP + 1) if i + j), key=lambda s: (max(s), s[0] != s[1], s))
SEEDED = "struct<words: binary, pos: array<int>, seed: array<long>>"
FLAGS = 20, 28, 5   # bits of a hash that flag a window, so that most windows that equal none move nowhere: least, most
                    # (32 MB, and what passes is compared in any case), and log2 of the flags for each that is set
PARTS = 2           # of seeds, and of pairs of documents, that go through the exchange one after another
# what an exchange leaves on disk goes when its query has ended, not when the driver's memory is next cleared
DROPPED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# rows hold the words of whole texts: bytes, and not rows alone, bound what goes to Python and what is read at once
BOUNDED = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}
GAP_BITS = 4096     # words of a gap that are aligned at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each ``w`` values in a row, the leftmost of equal ones."""
    n = len(values) - w + 1
    every = np.arange(n)
    least, place = values[:n], every
    for i in range(1, w):
        other = values[i:i + n]
        place = np.where(other < least, every + i, place)
        least = np.minimum(least, other)
    return place


def seeds(text: bytes, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """16-bit hashes of all words, and places and hashes of the kept k-mers."""
    words = word_list(text)
    h = hashes(words, len(words))
    n = len(h) - k + 1
    if n < 1:
        return (h >> np.uint64(48)).astype("<u2"), np.empty(0, np.int32), np.empty(0, np.int64)
    kmer = np.zeros(n, np.uint64)
    for i in range(k):
        kmer = (kmer ^ h[i:i + n]) * _MIX
        kmer ^= kmer >> np.uint64(29)
    w = min(window, n)
    place = _least(kmer, w)
    place = place[np.append(True, place[1:] != place[:-1])]
    # of equal k-mers side by side, as in a repeated word, one in RUN is enough
    run = np.append(True, (np.diff(place) > 1) | (kmer[place[1:]] != kmer[place[:-1]]))
    start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
    after = np.arange(len(place)) - start
    place, number = place[after % RUN == 0], (after[after % RUN == 0] // RUN).astype(np.uint64)
    # rows of one word meet place by place; any other k-mer is the same seed wherever it stands
    seed = np.where(number > 0, (kmer[place] ^ number) * _MIX, kmer[place])
    return (h >> np.uint64(48)).astype("<u2"), place.astype(np.int32), seed.view(np.int64)


class Best:
    """A Fenwick tree of maxima: the best value among the first places."""

    def __init__(self, n: int):
        self.value, self.owner = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, place: int, value: float, owner: int) -> None:
        i = place + 1
        while i < len(self.value):
            if value > self.value[i]:
                self.value[i], self.owner[i] = value, owner
            i += i & -i

    def before(self, place: int) -> tuple[float, int]:
        """Best value at a place below ``place``."""
        best, owner, i = float("-inf"), -1, place
        while i:
            if self.value[i] > best:
                best, owner = self.value[i], self.owner[i]
            i -= i & -i
        return best, owner


def chains(x: list[int], y: list[int], k: int = K, gap: float = GAP, least: int = LEAST_SEEDS) -> list[list[int]]:
    """Chains of matches, as lists of places in ``x`` and ``y``, which are sorted by x.

    A chain rises in both and has at least ``least`` matches.
    """
    score, previous = [0.0] * len(x), [-1] * len(x)
    i = 0
    if all(map(lt, x, x[1:])) and all(map(lt, y, y[1:])):
        # all rise, as in most copies: score + gap * (x + y) rises as well, so the match just before is the best before
        best = float("-inf")
        for i, far in enumerate(gap * (p + q) for p, q in zip(x, y)):
            gain = best - far
            score[i], previous[i] = (k + gain, i - 1) if gain > 0 else (float(k), -1)
            best = score[i] + far
        i = len(x)
    levels = sorted(set(y)) if i < len(x) else []
    tree = Best(len(levels))
    while i < len(x):
        same = i
        while same < len(x) and x[same] == x[i]:    # matches of one place don't follow each other
            same += 1
        for m in range(i, same):
            best, owner = tree.before(bisect_left(levels, y[m]))
            gain = best - gap * (x[m] + y[m])
            score[m], previous[m] = (k + gain, owner) if gain > 0 else (float(k), -1)
        for m in range(i, same):
            tree.put(bisect_left(levels, y[m]), score[m] + gap * (x[m] + y[m]), m)
        i = same
    used, out = [False] * len(x), []
    for m in sorted(range(len(x)), key=lambda m: (-score[m], m)):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = previous[m]
        if len(chain) >= max(least, 1):
            out.append(chain[::-1])
    return out


def _common(a: np.ndarray, b: np.ndarray, bits: int = GAP_BITS) -> int:
    """Length of the longest common subsequence, a column of it at a time as bits of one number.

    Rows go in blocks of ``bits``, and what a block carries in each column goes on to the next: the places
    of a word are a number as long as its block, so memory grows with the words of a gap, not with their square.
    """
    if len(a) == len(b) and (a == b).all():
        return len(a)
    other, carry, same = b.tolist(), bytearray(len(b)), 0
    for start in range(0, len(a), bits):
        block, at = a[start:start + bits].tolist(), {}
        for i, word in enumerate(block):
            at[word] = at.get(word, 0) | 1 << i
        full = (1 << len(block)) - 1
        row = full
        for j, word in enumerate(other):
            hit = row & at.get(word, 0)
            total = row + hit + carry[j]
            carry[j] = total > full
            row = (total | (row - hit)) & full
        same += len(block) - row.bit_count()
    return same


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """How many words both begin with."""
    n = min(len(a), len(b))
    step, done = 64, 0
    while done < n:
        other = np.nonzero(a[done:min(done + step, n)] != b[done:min(done + step, n)])[0]
        if len(other):
            return done + int(other[0])
        done, step = min(done + step, n), step * 4
    return n


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Words of a and of b that begin alike, small changes included, and how many of them are equal.

    An equal word gains 1 and a changed one costs as much as ``IDENTITY`` allows; the best end counts.
    """
    i = j = same = score = _run(a, b)
    best, top = (i, j, same), score
    while i < len(a) and j < len(b):
        p, q = a[i:i + 2 * SKIP].tolist(), b[j:j + 2 * SKIP].tolist()
        step = next((s for s in _STEPS if p[s[0]:s[0] + 2] == q[s[1]:s[1] + 2] and len(p) > s[0] + 1), None)
        if step is None:
            break
        n = _run(a[i + step[0]:], b[j + step[1]:])
        i, j, same = i + step[0] + n, j + step[1] + n, same + n
        score += n - CHANGE * max(step)
        if score > top:
            best, top = (i, j, same), score
        elif score < top - DROP:
            break
    return best


def _equal_gaps(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether both have the same words from one match of a chain to the next."""
    straight = np.diff(x) == np.diff(y)
    out = straight.copy()
    # matches at one distance are compared in one go
    ends = [-1, *np.nonzero(~straight)[0].tolist(), len(x) - 1]
    for first, last in zip(ends, ends[1:]):
        at = x[first + 1:last + 1]
        if len(at) > 1:
            other = int(y[first + 1])
            differ = a[at[0]:at[-1]] != b[other:other + at[-1] - at[0]]
            out[first + 1:last] = ~np.logical_or.reduceat(differ, at[:-1] - at[0])
    return out


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int = K,
          identity: float = IDENTITY) -> list[tuple[int, int, int, int, float]]:
    """Start and end in both documents of the parts of a chain, after alignment, and the share of words that agree.

    A chain is cut at gaps of over ``LENGTH`` words of which less than half agree. A part that
    agrees too little is cut at the gap that loses most words, until all parts agree or have no gap.
    """
    x, y = np.asarray(x, int), np.asarray(y, int)
    # by gap: equal words from one seed to the next, words that differ, whether it is no part
    kept, n = np.diff(x), np.maximum(np.diff(x), np.diff(y))
    for g in np.nonzero(~_equal_gaps(a, b, x, y))[0].tolist():
        kept[g] = _common(a[x[g]:x[g + 1]], b[y[g]:y[g + 1]])
    lost = n - kept
    ends = [-1, *np.nonzero((n - k > LENGTH) & (2 * (kept - k) < n - k))[0].tolist(), len(x) - 1]
    todo, out = [(p + 1, q) for p, q in zip(ends[-2::-1], ends[:0:-1])], []
    while todo:
        first, last = todo.pop()
        left, other_left, same_left = _extend(a[:x[first]][::-1], b[:y[first]][::-1])
        right, other_right, same_right = _extend(a[x[last] + k:], b[y[last] + k:])
        begin, end = int(x[first]) - left, int(x[last]) + k + right
        other, other_end = int(y[first]) - other_left, int(y[last]) + k + other_right
        share = (same_left + int(kept[first:last].sum()) + k + same_right) / max(end - begin, other_end - other)
        if share >= identity or first == last or not lost[first:last].any():
            out.append((begin, end, other, other_end, share))
        else:
            worst = first + int(lost[first:last].argmax())
            todo += [(worst + 1, last), (first, worst)]
    return out


def stretches_of(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], k: int = K, least: int = 1,
                 stretch: int = STRETCH, identity: float = IDENTITY) -> list[tuple[int, int, int, int, float]]:
    """The aligned parts of two documents with matches at ``x`` and ``y``, best chains first.
    Chains that lie within a part found before are left out."""
    out = []
    for chain in chains(x, y, k, GAP, least):
        own, other = [x[m] for m in chain], [y[m] for m in chain]
        if any(p[0] <= own[0] and own[-1] + k <= p[1] and p[2] <= other[0] and other[-1] + k <= p[3] for p in out):
            continue
        out += [p for p in align(a, b, own, other, k, identity) if p[4] >= identity and p[1] - p[0] >= stretch]
    return out


def _rows(docs: DataFrame, doc_id: str, text: str, k: int, window: int) -> DataFrame:
    """row, doc_id, and the words and seeds of each row."""

    @F.pandas_udf(SEEDED)
    def seeded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                words, place, seed = seeds(t, k, window)
                out.append((words.tobytes(), place, seed))
            yield pd.DataFrame(out, columns=["words", "pos", "seed"])

    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                               seeded(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("s")), "seeded")


def _matches(rows: DataFrame, part: int | None = None) -> DataFrame:
    """row, other and m: the places of both that share a seed, one of all or of a part of the seeds."""
    mine = F.lit(True) if part is None else F.pmod("seed", F.lit(PARTS)) == part
    # dealt out by seed once: the anchors and their join with the entries read the same exchange
    entries = rows.select("row", F.explode(F.arrays_zip(
        F.col("s.pos").alias("pos"), F.col("s.seed").alias("seed"))).alias("e")).select("row", "e.*").where(mine).repartition("seed")
    anchors = (entries.groupBy("seed").agg(
        F.min("row").alias("first"), F.min_by("pos", "row").alias("first_pos"),
        F.max("row").alias("last"), F.max_by("pos", "row").alias("last_pos")).where("first < last"))
    own = F.col("row") == F.col("first")
    return (entries.join(anchors, "seed")
            .select("row", "pos", F.when(own, F.col("last")).otherwise(F.col("first")).alias("other"),
                    F.when(own, F.col("last_pos")).otherwise(F.col("first_pos")).alias("other_pos"))
            .groupBy("row", "other").agg(F.array_sort(F.collect_list(F.struct("pos", "other_pos"))).alias("m")))


def _written_matches(rows: DataFrame) -> DataFrame:
    """The same of all seeds, a row for each part that has some; every seed is in one part."""
    return reduce(DataFrame.unionByName, [written(_matches(rows, part), "matches") for part in range(PARTS)])


def sides_of(parts: list[tuple[int, int, int, int, float]], bridge: int) -> list[tuple[bool, int, int]]:
    """What the parts of two documents cover in the first and in the other, joined over gaps of ``bridge`` words:
    a row of one word or a phrase said over and over has a part for each of its seeds."""
    out = []
    for own, at in ((True, 0), (False, 2)):
        spans = sorted((p[at], p[at + 1]) for p in parts)
        begin, end = spans[0] if spans else (0, 0)
        for start, stop in spans[1:]:
            if start > end + bridge:
                out.append((own, begin, end))
                begin, end = start, stop
            end = max(end, stop)
        if spans:
            out.append((own, begin, end))
    return out


def _compared(rows: DataFrame, matches: DataFrame, least: int, compare: Callable[..., Column]) -> DataFrame:
    """row, doc_id, other, other_id and what ``compare`` makes of the words and matches of each pair of documents."""
    own = rows.select("row", "doc_id", F.col("s.words").alias("words"))
    anchor = rows.select(F.col("row").alias("other"), F.col("doc_id").alias("other_id"), F.col("s.words").alias("other_words"))

    def part(n):
        # by row once, for the places of a pair and for its words
        pairs = (matches.where(F.pmod(F.xxhash64("other"), F.lit(PARTS)) == n).repartition("row")
                 .groupBy("row", "other").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
                 .where(F.size("m") >= least))
        return (pairs.join(own, "row").join(anchor, "other")
                .select("row", "doc_id", "other", "other_id",
                        F.explode(compare("words", "other_words", F.col("m.pos"), F.col("m.other_pos"))).alias("a"))
                .select("row", "doc_id", "other", "other_id", "a.*"))

    return reduce(DataFrame.unionByName, [written(part(n), "stretches") for n in range(PARTS)])


def _comparison(fields: str, parts_of: Callable[..., list[tuple]]) -> Callable[..., Column]:
    """``parts_of`` as a function of Spark on words and places of both, a list of ``fields`` for each pair."""
    names = [f.split(":")[0].strip() for f in fields.split(",")]

    @F.pandas_udf(f"array<struct<{fields}>>")
    def compare(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for a, b, xs, ys in batches:
            yield pd.Series([[dict(zip(names, part)) for part in parts_of(
                np.frombuffer(p, "<u2"), np.frombuffer(q, "<u2"), x.tolist(), y.tolist())]
                for p, q, x, y in zip(a, b, xs, ys)], dtype=object)

    return compare


def _stretches(rows: DataFrame, matches: DataFrame, k: int, least: int, stretch: int, identity: float) -> DataFrame:
    return _compared(rows, matches, least, _comparison(
        "start: int, end: int, other_start: int, other_end: int, identity: double",
        lambda *pair: stretches_of(*pair, k, 1, stretch, identity)))


def _sides(rows: DataFrame, matches: DataFrame, k: int, least: int, stretch: int, identity: float, bridge: int) -> DataFrame:
    """row, doc_id, start, end, other and other_id: what stretches cover in either document, joined by pair of documents."""
    found = _compared(rows, matches, least, _comparison(
        "own: boolean, start: int, end: int",
        lambda *pair: sides_of(stretches_of(*pair, k, 1, stretch, identity), bridge)))
    here = lambda own, other: F.when(F.col("own"), F.col(own)).otherwise(F.col(other))
    return found.select(here("row", "other").alias("row"), here("doc_id", "other_id").alias("doc_id"), "start", "end",
                        here("other", "row").alias("other"), here("other_id", "doc_id").alias("other_id"))


def stretches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW,
              least: int = LEAST_SEEDS, stretch: int = STRETCH, identity: float = IDENTITY) -> DataFrame:
    """Aligned parts of chains: row, doc_id, start and end (in words, from 0, end exclusive)
    and the same of the anchor document (other_*), with the share of equal words."""
    with settings(docs.sparkSession, DROPPED | BOUNDED):
        rows = _rows(docs, doc_id, text, k, window)
        return _stretches(rows, _written_matches(rows), k, least, stretch, identity)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` words in a row, from those of 1, 2, 4 and so on."""
    def mixed(h):
        h = h * _MIX
        return h ^ h >> np.uint64(29)

    n = len(words) - length + 1
    part, size = mixed(words.astype(np.uint64) + np.uint64(1)), 1
    key, done = np.zeros(n, np.uint64), 0
    while True:
        if length & size:
            key = mixed(mixed(key) ^ part[done:done + n])
            done += size
        if 2 * size > length:
            return key
        part = mixed(mixed(part[:-size]) ^ part[size:])
        size *= 2


def windows_of(words: np.ndarray, pos: list[int], repeated: list[int], found: list[tuple[int, int]], k: int = K,
               length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``length`` words whose seeds are all repeated, and whether
    no passage of ``found`` holds them. A window that another document has is one of these."""
    pos, again = np.asarray(pos, int), np.zeros(len(words), bool)
    again[np.asarray(repeated, int)] = True
    hit, same = again[pos], words[pos]
    for i in np.nonzero(~hit[1:] & (same[1:] == same[:-1]) & (same[1:] == words[pos[1:] - 1]))[0].tolist():
        # a row of one word may be longer than any other, so its later seeds count like its first
        hit[i + 1] = hit[i] and (words[pos[i]:pos[i + 1] + k] == words[pos[i]]).all()
    # a window that another document has holds no seed that isn't repeated, but for seeds so close
    # to its ends that the k-mers beyond decide whether they are kept
    bad = np.zeros(max(len(words), length) + 1, np.int64)
    bad[pos[~hit] + 1] = 1
    upto, every = np.cumsum(bad), np.arange(max(len(words) - length + 1, 0))
    edge = min(window, length - k + 1) - 1
    start = every[upto[np.maximum(every + length - k + 1 - edge, 0)] <= upto[every + edge]]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    key = window_hashes(words, length)[start]
    new = np.ones(len(start), bool)
    for begin, end in found:
        new &= (start < begin) | (start + length > end)
    return start, key.view(np.int64), new


def flag_bits(n: int) -> int:
    """Bits of a table of flags for ``n`` hashes."""
    least, most, spare = FLAGS
    return min(max(least, n.bit_length() + spare), most)


def flags_of(keys: DataFrame, bits: int) -> np.ndarray:
    """Flags of the column ``key``, eight in a byte."""
    cell = F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    # pieces of 2^15 flags, from 1
    pieces = keys.groupBy(F.bitmap_bucket_number(cell).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("b"))
    flags = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces.toLocalIterator():
        flags[(r.n - 1) << 12:r.n << 12] = np.frombuffer(r.b, np.uint8)
    return flags


def flagged(flags: np.ndarray, key: np.ndarray) -> np.ndarray:
    cell = key & (8 * len(flags) - 1)
    return (flags[cell >> 3] >> (cell & 7) & 1).astype(bool)


def _left_out(rows: DataFrame, matches: DataFrame, found: DataFrame, k: int, length: int, window: int) -> DataFrame | None:
    """Windows of ``length`` words that other documents have and no passage of ``found`` holds, as row,
    doc_id, start, end and other_id. Each is compared with the first and last row that have it."""
    repeated = matches.groupBy("row").agg(F.flatten(F.collect_list("m.pos")).alias("repeated"))
    known = found.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    open_rows = (rows.select("row", "doc_id", F.col("s.words").alias("words"), F.col("s.pos").alias("pos"))
                 .join(repeated, "row").join(known, "row", "left"))
    columns = ["words", "pos", "repeated", F.coalesce("starts", F.array().cast("array<int>")),
               F.coalesce("ends", F.array().cast("array<int>"))]

    @F.pandas_udf("struct<n: int, start: array<int>, key: array<long>>")
    def windows(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for words, pos, again, starts, ends in zip(*batch):
                start, key, new = windows_of(np.frombuffer(words, "<u2"), pos, again, list(zip(starts, ends)), k, length, window)
                order = np.argsort(~new, kind="stable")
                out.append((int(new.sum()), start[order].astype(np.int32), key[order]))
            yield pd.DataFrame(out, columns=["n", "start", "key"])

    # those that no passage holds come first, n of them; a document's words are looked through once
    made = written(open_rows.select("row", "doc_id", windows(*columns).alias("w")), "windows").select("row", "doc_id", "w.*")
    n = made.agg(F.sum("n")).first()[0]
    if not n:
        return None
    wanted = made.select("row", "doc_id", F.explode(F.arrays_zip(
        F.slice("start", 1, F.col("n")).alias("start"), F.slice("key", 1, F.col("n")).alias("key"))).alias("w")).select("row", "doc_id", "w.*")
    flags = rows.sparkSession.sparkContext.broadcast(flags_of(wanted, flag_bits(n)))

    @F.pandas_udf("array<long>")
    def like_wanted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Of the windows that a passage holds those that may equal one of the others."""
        for held, keys in batches:
            yield pd.Series([key[h:][flagged(flags.value, key[h:])] for h, key in zip(held, keys)], dtype=object)

    others = made.where(F.size("key") > F.col("n")).select("row", "doc_id", F.explode(like_wanted("n", "key")).alias("key"))
    holders = (wanted.drop("start").unionByName(others).groupBy("key").agg(
        F.min("row").alias("first"), F.min_by("doc_id", "row").alias("first_id"),
        F.max("row").alias("last"), F.max_by("doc_id", "row").alias("last_id")).where("first < last"))
    return wanted.join(holders, "key").select(
        "row", "doc_id", "start", (F.col("start") + length).alias("end"),
        F.when(F.col("row") == F.col("first"), F.col("last_id")).otherwise(F.col("first_id")).alias("other_id"),
        F.when(F.col("row") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("other"))


def _joined(parts: DataFrame, keys: list[str], bridge: int) -> DataFrame:
    """Parts of equal ``keys`` that meet, over ``bridge`` words at most, as one: keys, doc_id, start, end and the smallest other_id."""
    by_start = parts.groupBy(*keys, "start").agg(
        F.min("doc_id").alias("doc_id"), F.max("end").alias("end"), F.min("other_id").alias("other_id"))
    earlier = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") > F.max("end").over(earlier) + bridge, F.lit(True))
    return (by_start.withColumn("_fresh", fresh.cast("int")).withColumn("_island", F.sum("_fresh").over(upto))
            .groupBy(*keys, "_island").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"),
                                           F.max("end").alias("end"), F.min("other_id").alias("other_id")).drop("_island"))


def _islands(parts: DataFrame, length: int, bridge: int) -> DataFrame:
    """row, doc_id, start, end and the smallest other_id of passages. Stretches with one and the same
    other document are joined over short gaps and must make ``length`` words; what overlaps then is one passage."""
    long = _joined(parts, ["row", "other"], bridge).where(F.col("end") - F.col("start") >= length)
    return _joined(long, ["row"], 0)


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, bridge: int = BRIDGE,
             k: int = K, window: int = WINDOW, least: int = LEAST_SEEDS, stretch: int = STRETCH,
             identity: float = IDENTITY) -> DataFrame:
    """doc_id, start and end (in words, from 0, end exclusive) of each passage of at
    least ``length`` words that other documents have, and the smallest id of these
    that a stretch of it was aligned with, or that was compared with a window of it."""
    with settings(docs.sparkSession, DROPPED | BOUNDED):
        rows = _rows(docs, doc_id, text, k, window)
        matches = _written_matches(rows)
        parts = _sides(rows, matches, k, least, stretch, identity, bridge)
        first = written(_islands(parts, length, bridge), "passages")
        rest = _left_out(rows, matches, first, k, length, window)
        rest = None if rest is None else written(rest, "left-out")
    whole = first if rest is None else _islands(parts.unionByName(rest), length, bridge)
    return whole.select("doc_id", "start", "end", "other_id")
