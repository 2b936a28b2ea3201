"""Which patterns occur inside which texts."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.flags import flag_table, may_be_among
from ..functions.windows import BLOCK, blocks
from ..session import written

ANCHOR_WORDS = 4
GRAM = 8    # characters


def _phrase(words: int) -> str:
    """Regex for whole phrases of so many words with white space on either side.

    The phrase is looked ahead for, so overlapping ones are found too.
    """
    return r"\s(?=(" + r"\s".join([r"\S+"] * words) + r")\s)"


def _grams(text: Column, kind: int, words: int) -> Column:
    """Parts of a text that are looked up: kind 0 its phrases, any other kind all runs of so many characters."""
    part = _phrase(words) if kind == 0 else f"(?s)(?=(.{{{kind}}}))."
    return F.transform(F.regexp_extract_all(text, F.lit(part), F.lit(1)),
                       lambda g: F.concat(F.lit(f"{kind} "), g))


def contained_pairs(texts: DataFrame, text_id: str, text: str,
                    patterns: DataFrame, pattern_id: str, pattern: str,
                    anchor_words: int = ANCHOR_WORDS, gram: int = GRAM) -> DataFrame:
    """Pairs (text_id, pattern_id) where the text holds the pattern literally.

    Comparing every text with every pattern is a cross join. Instead a pattern is
    found by its anchor, one part that any text holding the pattern has too: a
    phrase of ``anchor_words`` whole words with white space around them, or, where
    it has none, a run of ``gram`` characters, or all of a shorter pattern. Of its
    parts the one that is rarest in the texts is the anchor, so a common phrase moves
    nothing, and a pattern of which some part occurs nowhere is not looked for.

    Texts are cut into blocks that overlap by the longest pattern. Parts of a block that no
    pattern has (for the counts), or that are no anchor (for the join), are dropped in
    place by a table of flags before anything moves. What is found is compared on the block.
    """
    if not patterns.where(F.length(pattern) == 0).isEmpty():
        raise ValueError("empty patterns occur in every text")
    first = F.regexp_extract("_pattern", _phrase(anchor_words), 1)
    known = written(
        patterns.where(F.col(pattern).isNotNull())
        .select(F.monotonically_increasing_id().alias("_no"), pattern_id, F.col(pattern).alias("_pattern"))
        .withColumn("_kind", F.when(first != "", 0).otherwise(F.least(F.length("_pattern"), F.lit(gram)))), "patterns")
    longest = known.agg(F.max(F.length("_pattern"))).first()[0] or 0
    kinds = sorted(r["_kind"] for r in known.select("_kind").distinct().collect())    # gram + 1 at most
    own = F.coalesce(*[F.when(F.col("_kind") == k, _grams(F.col("_pattern"), k, anchor_words)) for k in kinds],
                     F.array().cast("array<string>"))
    named = ["_no", pattern_id, "_pattern"]
    parts = written(known.select(*named, F.explode(F.array_distinct(own)).alias("_gram")), "parts")
    cut = blocks(texts, text_id, text, max(BLOCK, longest), max(longest - 1, 0))

    def found(flags: bytes, kinds: list[int]) -> Column:
        """The parts of a block that pass the table."""
        return F.array_distinct(F.concat(*[F.filter(_grams(F.col("_text"), k, anchor_words), lambda g: may_be_among(flags, g)) for k in kinds],
                                         F.array().cast("array<string>")))

    several = parts.groupBy("_no").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    choices = parts.join(several, "_no", "left_semi")
    anchors = parts.join(several, "_no", "left_anti")
    if not choices.isEmpty():
        # no pattern that is all of its one part has a choice
        seen = cut.select(F.explode(found(flag_table(choices, "_gram"), [k for k in kinds if k in (0, gram)])).alias("_gram"))
        counts = seen.groupBy("_gram").agg(F.count(F.lit(1)).alias("_seen"))
        rarest = (choices.join(counts, "_gram", "left").groupBy(*named)
                  .agg(F.min(F.struct(F.coalesce("_seen", F.lit(0)).alias("n"), "_gram")).alias("_least"))
                  .where("_least.n > 0").select(*named, F.col("_least._gram").alias("_gram")))
        anchors = anchors.unionByName(rarest)
    anchors = written(anchors.withColumn("_whole", F.concat(F.length("_pattern").cast("string"), F.lit(" "), F.col("_pattern"))
                                         == F.col("_gram")), "anchors")

    pairs = []
    for whole in (True, False):    # a part that is the whole pattern needs no second look, so its block stays where it is
        mine = anchors.where("_whole" if whole else "NOT _whole")
        if mine.isEmpty():
            continue
        flags = flag_table(mine, "_gram")
        sizes = [k for k in kinds if (k > 0 if whole else k in (0, gram))]
        spots = cut.select(text_id, *([] if whole else ["_text"]), F.explode(found(flags, sizes)).alias("_gram"))
        hits = (spots.distinct() if whole else spots).join(mine.select(pattern_id, "_pattern", "_gram"), "_gram")
        pairs.append((hits if whole else hits.where(F.contains("_text", "_pattern"))).select(text_id, pattern_id))
    if not pairs:
        return texts.sparkSession.createDataFrame([], StructType([texts.schema[text_id], patterns.schema[pattern_id]]))
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out.distinct()
