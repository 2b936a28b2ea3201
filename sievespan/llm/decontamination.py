"""Benchmark decontamination: a prefix-filtered join of word shingles.

Item texts are cut into windows of ``window`` words (a shorter item is one
window). A document word is hit if it lies inside an occurrence of a window.
A window that occurs has all its shingles in the document, so it is enough to
look for one of them: the rarest over all documents, its prefix. Documents and
prefixes are joined on the shingle; the shingle's place in the window and the
document's length bound the candidates; what remains is compared word by word.

Before the join, documents drop the shingles that no benchmark item has: a
table of ``CELLS`` flags, of fixed size, tells which hashes may occur.

Only DataFrame functions are used. Words are runs of ASCII letters and digits
and of characters beyond ASCII, A-Z in lower case. Null and empty texts have no
words; such items occur nowhere. Items that repeat an id count as one, items
without an id mark words but are not counted. Each row of documents is judged
by itself, so repeated ids give repeated rows.
"""

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

WINDOW = 13
SHINGLE = 5
CELLS = 1 << 20
BITMAP = 1 << 15    # bits of one bitmap of bitmap_construct_agg
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOTHING = "array<struct<k: int, pos: int, gram: bigint, first: int, near: array<string>>>"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _gram(hashes: Column, start: Column, k: int) -> Column:
    """Hash of the k words from ``start`` on, given the words' hashes."""
    return F.xxhash64(F.lit(k), *[F.get(hashes, start + i) for i in range(k)])


def _grams(hashes: Column, k: int) -> Column:
    n = F.size(hashes)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(
        i.alias("pos"), _gram(hashes, i, k).alias("gram")))).otherwise(
            F.lit(None).cast("array<struct<pos: int, gram: bigint>>"))


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """item_id and ``window``, an array of words; items without words have none."""
    split = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("_words")).where("size(_words) > 0")
    length = F.least(F.lit(window), F.size("_words"))
    return split.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("_words") - length),
        lambda i: F.slice("_words", i + 1, length))).alias("window"))


def window_shingles(windows: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """window, k, pos and gram of each shingle; a window shorter than a shingle is one."""
    k = F.least(F.lit(shingle), F.size("window"))
    hashes = F.transform("window", lambda w: F.xxhash64(w))
    parts = F.coalesce(*[F.when(k == size, _grams(F.col("_hashes"), size)) for size in sizes]) if sizes else F.lit(
        None).cast("array<struct<pos: int, gram: bigint>>")
    return (windows.select("window").distinct().withColumn("_hashes", hashes)
            .select("window", k.alias("k"), F.explode(parts).alias("_g"))
            .select("window", "k", "_g.pos", "_g.gram"))


def _flags(shingles: DataFrame) -> bytes:
    """A byte for each cell: 1 if a shingle's hash falls into it. Not more than ``CELLS / BITMAP`` rows come here."""
    cell = F.pmod("gram", F.lit(CELLS)) + 1
    maps = shingles.groupBy(F.bitmap_bucket_number(cell).alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    flags = bytearray(CELLS)
    for row in maps:
        base = (row["at"] - 1) * BITMAP
        for i, byte in enumerate(row["bits"]):
            if byte:
                flags[base + 8 * i: base + 8 * i + 8] = bytes(byte >> b & 1 for b in range(8))
    return bytes(flags)


def _found(own: Column, sizes: list[int], flags: bytes, window: int) -> Column:
    """Shingles of a document that an item may have, with the words around."""
    def with_words(k):
        def near(g):
            first = F.greatest(g["pos"] - (window - k), F.lit(0))
            return F.struct(F.lit(k).alias("k"), g["pos"].alias("pos"), g["gram"].alias("gram"),
                            first.alias("first"), F.slice(own, first + 1, g["pos"] + window - first).alias("near"))
        return near

    def of(hashes):
        none = F.array().cast("array<struct<pos: int, gram: bigint>>")
        parts = [F.transform(F.filter(
            F.coalesce(_grams(hashes, k), none),
            lambda g: F.substring(F.lit(flags), F.pmod(g["gram"], F.lit(CELLS)).cast("int") + 1, 1) == F.lit(b"\x01")),
            with_words(k)) for k in sizes]
        return F.concat(*parts) if parts else F.array().cast(NOTHING)

    return _let(F.transform(own, lambda w: F.xxhash64(w)), of)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``_text`` (a hash of the text), ``n_words``,
    ``n_hit``, ``n_items`` and ``items``, the sorted ids (as strings) of the items with occurring windows."""
    windows = written(item_windows(benchmark, item_id, item_text, window), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least(F.lit(shingle), F.size("window"))).distinct().collect())
    shingles = written(window_shingles(windows, sizes, shingle), "shingles")
    flags = _flags(shingles)

    read = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_text"),
        _let(words(F.col(text)), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), _found(w, sizes, flags, window).alias("found"))).alias("_doc"))
    rows = written(read.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "_text",
                               F.col("_doc.n").alias("n_words"), F.col("_doc.found").alias("_found")), "shingled")
    found = rows.where("size(_found) > 0").select("_row", "n_words", F.explode("_found").alias("_f")).select(
        "_row", "n_words", "_f.*")

    seen = found.groupBy("gram").agg(F.count(F.lit(1)).alias("_seen"))
    # the rarest shingle of each window; a window with a shingle that no document has occurs nowhere
    prefixes = (shingles.join(seen, "gram").groupBy("window", "k")
                .agg(F.min(F.struct("_seen", "pos", "gram")).alias("_rarest"), F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") == F.size("window") - F.col("k") + 1)
                .select("window", F.col("_rarest.pos").alias("_at"), F.col("_rarest.gram").alias("gram")))
    start = F.col("pos") - F.col("_at")
    length = F.size("window")
    hits = written(
        found.join(prefixes, "gram")
        .where((start >= 0) & (start + length <= F.col("n_words")) & (start >= F.col("first")))
        .where(F.slice("near", start - F.col("first") + 1, length) == F.col("window"))
        .select("_row", start.alias("start"), (start + length).alias("end"), "window").distinct(), "hits")

    before = F.coalesce(F.max("end").over(Window.partitionBy("_row").orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    covered = (hits.select("_row", "start", "end").distinct()
               .select("_row", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0)).alias("_new"))
               .groupBy("_row").agg(F.sum("_new").cast("long").alias("n_hit")))
    items = (hits.select("_row", "window").distinct().join(windows.distinct(), "window")
             .groupBy("_row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    return (rows.drop("_found").join(covered.join(items, "_row", "left"), "_row", "left")
            .select("doc_id", "_text", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit, and one at least."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows."""
    gone = (contamination(docs, benchmark, doc_id, text).where(contaminated())
            .select(F.col("doc_id").alias("_gone"), "_text").distinct())
    same = docs[doc_id].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_text"])
    return docs.join(gone, same, "left_anti")
