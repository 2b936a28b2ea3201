import random

import pytest

from conftest import rows
from sievespan.operators import coverage as cov
from sievespan.operators.containment import contained_pairs
from sievespan.operators.latest import latest_per_key
from sievespan.operators.numbering import batch_number, dense_position, rank_ascending

PAIRS = [("a", "P1", "3.0"), ("a", "P1", "4.0"), ("a", "P2", "10"), ("a", "P3", "-"), ("a", "P4", ""), ("a", "P5", None),
         ("b", "P1", "9.99"), ("b", "P6", "1"), ("c", "P7", "50"), ("d", "P8", "2")]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "id string, peptide string, pct string")


def roster(spark):
    return spark.createDataFrame([(i,) for i in "abcdef"], "id string")


def test_count_takes_the_cutoff_in_and_bridge_leaves_it_out(spark):
    got = rows(cov.binder_count(roster(spark), pairs(spark), "id", "pct"))
    assert got == {("a", 3), ("b", 2), ("c", 0), ("d", 1), ("e", 0), ("f", 0)}
    bridge = rows(cov.binders(pairs(spark), "id", "peptide", "pct"))
    assert bridge == {("P1", "a"), ("P1", "b"), ("P6", "b"), ("P8", "d")}


def test_coverage(spark):
    scores = spark.createDataFrame([("P1", 50.0), ("P1", 43.0), ("P6", 42.99), ("P9", 1.0)], "peptide string, score double")
    bridge = cov.binders(pairs(spark), "id", "peptide", "pct")
    rolled = cov.coverage(bridge, scores, "id", "peptide", "score")
    got = {r["id"]: tuple(r)[1:] for r in rolled.collect()}
    assert got == {
        "a": (2, 43.0, 0, "tested", True),           # both scores of a peptide count; 43 itself is no risk
        "b": (3, 42.99, 1, "tested", False),
        "d": (0, None, 0, "incomplete", None),       # no score is not a pass
    }
    screened = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    full = {r["id"]: (r["status"], r["verdict"]) for r in
            cov.screened_coverage(roster(spark), screened, rolled, "id").collect()}
    assert full["c"] == ("tested", True)             # screened, nothing to flag
    assert full["e"] == ("not_screened", None)
    assert full["d"] == ("incomplete", None)
    assert len(full) == 6


def test_derived_scores(spark):
    df = spark.createDataFrame([(82.4106, 26.0, 0.54, 0.0, -0.5), (1.0, 1.0, 0.3, 0.0, -0.5)],
                               "imm double, med double, ml double, pos double, neg double")
    got = [tuple(r) for r in df.select(cov.combined_score("imm", "med"), cov.hybrid_score("ml", "pos", "neg")).collect()]
    assert got[0] == (pytest.approx(48.56424), pytest.approx(0.04))
    assert got[1][1] == 0.0


def test_latest_does_not_depend_on_arrival(spark):
    data = [("k", 1, "x"), ("k", 3, "b"), ("k", 3, "a"), ("j", 2, None), ("j", 1, "y")]
    for seed in range(4):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "key string, n int, v string").repartition(3)
        assert rows(latest_per_key(df, ["key"], ["n"])) == {("k", 3, "b"), ("j", 2, None)}


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 300 + ["b"] * 20 + ["c"] * 3 + [None] * 4
    data = [(k, rng.randrange(10), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "key string, v int, n int").repartition(5)
    got = rows(dense_position(df, ["key"], ["v", "n"]))
    want = set()
    for k in set(keys):
        mine = sorted(((v, n) for key, v, n in data if key == k))
        want |= {(k, v, n, i) for i, (v, n) in enumerate(mine, 1)}
    assert got == want
    overall = rows(dense_position(df.select("n"), [], ["n"]))
    assert overall == {(n, n + 1) for n in range(len(keys))}


def test_rank_and_batches(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, 5), (4, 1)], "pos long, n int")
    ranked = rows(rank_ascending(df, [], ["n", "pos"]))
    assert {(p, r) for p, _, r in ranked} == {(2, 1), (4, 2), (1, 3), (3, 4)}
    numbers = spark.range(1, 102).select(batch_number("id", 50).alias("b")).groupBy("b").count()
    assert rows(numbers) == {(1, 50), (2, 50), (3, 1)}


def test_containment_against_plain_search(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "b", "ca", "cab", "x.", "ab,"]
    texts = [(i, rng.choice(["", " "]).join([""]) + rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 30))))
             for i in range(60)]
    patterns = []
    for i in range(40):
        source = rng.choice(texts)[1]
        begin = rng.randrange(len(source))
        patterns.append((i, source[begin:begin + rng.randrange(1, 40)]))
    patterns += [(100, "zzz"), (101, "ab ab ab ab ab ab ab ab zz")]
    got = rows(contained_pairs(spark.createDataFrame(texts, "doc int, text string"), "doc", "text",
                               spark.createDataFrame(patterns, "item int, text string"), "item", "text"))
    assert got == {(d, p) for d, t in texts for p, s in patterns if s in t}


def test_containment_of_long_patterns_only(spark):
    texts = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "two three four")], "d int, t string")
    patterns = spark.createDataFrame([(7, "ne two three four five six se"), (8, "ne two three four five six sx")], "p int, s string")
    assert rows(contained_pairs(texts, "d", "t", patterns, "p", "s")) == {(1, 7)}
    with pytest.raises(ValueError):
        contained_pairs(texts, "d", "t", spark.createDataFrame([(1, "")], "p int, s string"), "p", "s")


def test_containment_of_short_patterns_only(spark):
    texts = spark.createDataFrame([(1, "xaby"), (2, "ab"), (3, "b a")], "d int, t string")
    patterns = spark.createDataFrame([(7, "ab"), (8, "b")], "p int, s string")
    assert rows(contained_pairs(texts, "d", "t", patterns, "p", "s")) == {(1, 7), (2, 7), (1, 8), (2, 8), (3, 8)}


def _generated(plan):
    """Rows that the plan's generators made."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _generated(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _generated(plan.plan())
    children = plan.children()
    below = [n for i in range(children.size()) for n in _generated(children.apply(i))]
    return ([plan.metrics().apply("numOutputRows").value()] if name == "GenerateExec" else []) + below


def test_a_common_phrase_moves_no_more_than_a_rare_one(spark):
    """Patterns that begin with a phrase of a third of all texts are found by their rarest phrase."""
    made = {}
    for opening in ("all rights are reserved here", "an odd phrase of mine"):
        texts = [(i, f"x {'all rights are reserved here' if i % 3 == 0 else 'nothing of that kind'} w{i} v{i} u{i} t{i} s{i} r{i} end") for i in range(300)]
        texts += [(1000 + i, f"y {opening} a{i} b{i} c{i} d{i} e{i} f{i} z") for i in range(5)]
        patterns = [(i, f"{opening} a{i} b{i} c{i} d{i} e{i}") for i in range(7)]
        got = contained_pairs(spark.createDataFrame(texts, "d int, t string"), "d", "t",
                              spark.createDataFrame(patterns, "p int, s string"), "p", "s")
        assert rows(got) == {(1000 + i, i) for i in range(5)}
        made[opening] = min(_generated(got._jdf.queryExecution().executedPlan()))
    assert set(made.values()) == {5}


def test_patterns_of_all_lengths_and_repeated_ids(spark):
    """Against a plain search; texts longer than a block, patterns of one id with different texts."""
    import random
    draw = random.Random(2)
    texts = [(d, "".join(draw.choices("ab \né", k=n))) for d, n in enumerate((0, 1, 5, 30, 300, 9000))] + [(9, None)]
    cuts = [(p, t[at:at + n]) for p, n in enumerate((1, 2, 3, 7, 8, 9, 12, 40, 4500)) for t in (texts[-2][1],) for at in (draw.randrange(4000),)]
    patterns = cuts + [(3, "ab a"), (3, "zz"), (77, None), (78, "q" * 20)]
    got = rows(contained_pairs(spark.createDataFrame(texts, "d int, t string"), "d", "t",
                               spark.createDataFrame(patterns, "p int, s string"), "p", "s"))
    assert got == {(d, p) for d, t in texts for p, s in patterns if t is not None and s is not None and s in t}
