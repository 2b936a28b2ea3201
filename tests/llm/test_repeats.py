import random
import tracemalloc

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sievespan.llm import repeats
from sievespan.llm.words import word_list

DOCS = "doc_id long, text string"


def prose(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n)]


def text(*parts):
    return " ".join(w for p in parts for w in p)


def found(spark, rows, **how):
    got = repeats.passages(spark.createDataFrame(rows, DOCS), **how).collect()
    return {(r.doc_id, r.start, r.end): r.other_id for r in got}


def test_exact_passages_have_exact_ends(spark):
    shared, short = prose(1, 60), prose(2, 40)
    rows = [(1, text(prose(3, 100), shared, prose(4, 80))), (2, text(shared, prose(5, 200))),
            (3, text(prose(6, 150), short)), (4, text(short, prose(7, 100))), (5, text(prose(8, 300)))]
    assert found(spark, rows) == {(1, 100, 160): 2, (2, 0, 60): 1}


def test_fuzzy_passages(spark):
    shared = prose(1, 200)
    changed = shared[:50] + ["new", "words"] + shared[52:100] + shared[103:150] + ["more"] + shared[150:]
    rows = [(1, text(prose(2, 70), shared)), (2, text(changed, prose(3, 70)))]
    assert found(spark, rows) == {(1, 70, 270): 2, (2, 0, len(changed)): 1}
    half = [w if i % 3 else w + "x" for i, w in enumerate(shared)]
    assert found(spark, [(1, text(shared)), (2, text(half))]) == {}


def test_parts_with_different_anchors_are_one_passage(spark):
    whole = prose(1, 80)
    rows = [(0, text(whole[:40], prose(2, 60))), (1, text(prose(3, 50), whole[40:])), (5, text(prose(4, 20), whole)),
            (9, text(whole, prose(5, 30)))]
    got = found(spark, rows)
    assert {(5, 20, 100), (9, 0, 80)} <= set(got) and all(k[0] in (5, 9) for k in got)


def test_many_copies_give_one_row_each(spark):
    shared = prose(1, 120)
    rows = [(i, text(shared)) for i in range(300)] + [(1000 + i, text(prose(i + 2, 30), shared)) for i in range(20)]
    edges = repeats.stretches(spark.createDataFrame(rows, DOCS))
    assert 319 <= edges.count() < 340
    got = found(spark, rows)
    assert len(got) == 320 and got[0, 0, 120] == 1 and got[7, 0, 120] == 0 and got[1003, 30, 150] == 0


def test_repeats_within_a_document_dont_count(spark):
    shared = prose(1, 70)
    assert found(spark, [(1, text(shared, prose(2, 20), shared)), (2, text(prose(3, 90)))]) == {}
    got = found(spark, [(1, "of " * 200), (2, "a b c " + "of " * 100)])
    assert {k[0] for k in got} == {1, 2}


def test_odd_rows(spark, odd_docs, no_docs):
    got = repeats.passages(odd_docs.where("doc_id < 7")).collect()
    assert got == []
    assert repeats.passages(no_docs).count() == 0
    shared = text(prose(1, 60))
    assert found(spark, [(1, shared), (1, shared), (None, shared)]).keys() == {(1, 0, 60), (None, 0, 60)}


def test_shared_runs_share_a_seed():
    draw = random.Random(3)
    for _ in range(50):
        shared = prose(draw.random(), repeats.K + repeats.WINDOW - 1)
        a, b = (repeats.seeds(text(prose(draw.random(), draw.randint(0, 40)), shared, prose(draw.random(), 30)).encode())[2] for _ in "ab")
        assert set(a.tolist()) & set(b.tolist())


def test_seeds_of_short_texts_and_rows_of_equal_words():
    assert len(repeats.seeds(b"one two three")[1]) == 0 and len(repeats.seeds(b"a b c d e")[1]) == 1
    words, place, seed = repeats.seeds(b"of " * 1000)
    assert len(words) == 1000 and len(set(seed.tolist())) == len(seed) <= 70


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
def test_best_chain_is_the_best(matches):
    """The first chain scores as much as the best found by trying every match before every other."""
    matches.sort()
    x, y = [m[0] for m in matches], [m[1] for m in matches]
    score = []
    for i, (a, b) in enumerate(matches):
        score.append(5 + max([0, *(score[j] - 0.1 * (a - x[j] + b - y[j]) for j in range(i) if x[j] < a and y[j] < b)]))
    chain = repeats.chains(x, y, 5, 0.1, 1)[0]
    assert all(x[p] < x[q] and y[p] < y[q] for p, q in zip(chain, chain[1:]))
    got = 5 * len(chain) - 0.1 * (x[chain[-1]] - x[chain[0]] + y[chain[-1]] - y[chain[0]])
    assert abs(got - max(score)) < 1e-6


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_common_words(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, v in enumerate(a):
        for j, w in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if v == w else max(table[i][j + 1], table[i + 1][j])
    assert repeats._common(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_words_are_those_of_the_contract():
    assert word_list("It's é-Ü 12%猫\x00B".encode()) == ["it".encode(), b"s", "é".encode(), "Ü".encode(), "12".encode(), "猫".encode(), b"b"]


def test_two_passages_with_other_text_between(spark):
    for n, own in ((60, 40), (60, 80), (200, 200)):
        head, foot = prose(1, n), prose(2, n)
        rows = [(d, text(prose(10 + d, 30), head, prose(20 + d, own), foot, prose(30 + d, 30))) for d in (1, 2)]
        assert found(spark, rows) == {(d, s, s + n): 3 - d for d in (1, 2) for s in (30, 30 + n + own)}


def test_a_passage_that_one_document_has_twice(spark):
    shared = prose(1, 60)
    once, twice = text(prose(2, 50), shared, prose(3, 50)), text(shared, prose(4, 90), shared, prose(5, 30))
    expected = {(1, 50, 110): 2, (2, 0, 60): 1, (2, 150, 210): 1}
    assert found(spark, [(1, once), (2, twice)]) == expected
    assert found(spark, [(2, twice), (1, once)]) == expected


def test_a_passage_whose_parts_were_first_seen_elsewhere(spark):
    """Every exact window is found, though each of its lines has another anchor document."""
    shared = [prose(100 + i, 10) for i in range(6)]
    rows = [(i, text(prose(200 + i, 40), line, prose(300 + i, 40))) for i, line in enumerate(shared)]
    rows += [(10, text(prose(1, 30), *shared, prose(2, 30))), (11, text(*shared, prose(3, 70)))]
    assert found(spark, rows) == {(10, 30, 90): 11, (11, 0, 60): 10}


def test_windows_are_all_found(spark):
    """Texts of lines from a small stock: each window of 50 words of two documents lies in a passage."""
    draw = random.Random(9)
    lines = [prose(i, draw.choice([3, 7, 10, 12])) for i in range(40)] + [["of"] * 30, ["a", "b"] * 20]
    blocks = [[w for i in draw.choices(range(42), k=6) for w in lines[i]] for _ in range(12)]
    docs = {d: [w for _ in range(4) for w in draw.choice([*blocks, lines[draw.randrange(42)], prose(500 + d, 20)])] for d in range(40)}
    holders = {}
    for d, words in docs.items():
        for s in range(len(words) - 49):
            holders.setdefault(tuple(words[s:s + 50]), set()).add(d)
    got = found(spark, [(d, " ".join(words)) for d, words in docs.items()])
    missing = [(d, s) for d, words in docs.items() for s in range(len(words) - 49) if len(holders[tuple(words[s:s + 50])]) > 1
               and not any(k[0] == d and k[1] <= s and s + 50 <= k[2] for k in got)]
    assert missing == []


def test_short_fuzzy_passages(spark):
    """60 words of which every tenth is another one."""
    rows = []
    for i in range(20):
        shared = prose(1000 + i, 60)
        changed = [w if j % 10 != 5 else w + "x" for j, w in enumerate(shared)]
        rows += [(2 * i, text(prose(2000 + i, 60), shared, prose(3000 + i, 60))), (2 * i + 1, text(prose(4000 + i, 60), changed, prose(5000 + i, 60)))]
    assert sorted(k[0] for k in found(spark, rows)) == list(range(40))


def test_short_phrases_of_several_documents_are_no_passage(spark):
    """Three phrases of 22 words, each from another document, with 15 own words between."""
    draw = random.Random(8)
    word = lambda: f"w{draw.randrange(10**6)}"
    phrases = [[word() for _ in range(22)] for _ in range(3)]
    rows = [(i, " ".join([word() for _ in range(60)] + p + [word() for _ in range(60)])) for i, p in enumerate(phrases, 1)]
    mixed = [w for p in phrases for w in [word() for _ in range(15)] + p]
    rows.append((9, " ".join([word() for _ in range(70)] + mixed + [word() for _ in range(70)])))
    assert repeats.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_seeds_are_dealt_out_once(spark):
    same = prose(1, 80)
    rows = repeats._rows(spark.createDataFrame([(1, text(same)), (2, text(prose(2, 9), same))], DOCS), "doc_id", "text", repeats.K, repeats.WINDOW)
    matches = repeats._matches(rows)
    dealt = [l for l in matches._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(seed" in l]
    assert dealt and all("REPARTITION_BY_COL" in l for l in dealt)


def test_parts_of_the_seeds_make_all_matches(spark):
    shared = [prose(i, 70) for i in range(6)]
    docs = spark.createDataFrame([(i, text(prose(50 + i, 30), shared[i % 6], prose(80 + i, 9), shared[i % 5])) for i in range(24)], DOCS)
    rows = repeats._rows(docs, "doc_id", "text", repeats.K, repeats.WINDOW)

    def places(matches):
        return sorted((r.row, r.other, m.pos, m.other_pos) for r in matches.collect() for m in r.m)

    parts = [places(repeats._matches(rows, n)) for n in range(repeats.PARTS)]
    assert all(parts) and len(parts) > 1
    assert places(repeats._written_matches(rows)) == sorted(p for part in parts for p in part) == places(repeats._matches(rows))


def test_exchanges_are_off_the_disk_when_their_table_is_written(spark, monkeypatch):
    """Spark drops them, as long as the setting holds; it is as before in the end."""
    name, = repeats.DROPPED
    before, seen = spark.conf.get(name), []
    write = repeats.written

    def watched(df, label):
        seen.append((label, spark.conf.get(name)))
        return write(df, label)

    monkeypatch.setattr(repeats, "written", watched)
    same = prose(1, 80)
    got = repeats.passages(spark.createDataFrame([(1, text(same)), (2, text(prose(2, 9), same))], DOCS))
    assert {(r.doc_id, r.start, r.end) for r in got.collect()} == {(1, 0, 80), (2, 9, 89)}
    assert [label for label, _ in seen].count("matches") == [label for label, _ in seen].count("stretches") == repeats.PARTS
    assert {on for _, on in seen} == {"true"} and spark.conf.get(name) == before


def test_flags_grow_with_the_windows(spark):
    """Few hashes that aren't there are flagged, however many are, and all that are there."""
    key = np.random.default_rng(7).integers(-2**63, 2**63, 600_000)
    bits = repeats.flag_bits(len(key) // 2)
    flags = repeats.flags_of(spark.createDataFrame([(int(k),) for k in key[:3000]] + [(0,), (-1,)], "key long"), bits)
    assert repeats.flagged(flags, np.append(key[:3000], [0, -1])).all()
    assert repeats.flagged(flags, key[3000:]).mean() < 0.001
    assert len(np.unique(key[:300_000] & ((1 << bits) - 1))) / (1 << bits) < 1 / 20
    assert repeats.flag_bits(1) == 20 and repeats.flag_bits(1 << 40) == 28


def test_a_phrase_said_over_and_over_is_no_stretch_per_word(spark, monkeypatch):
    """The table of stretches has a row or two for each side of a pair, however often a document says a phrase."""
    kept, write = [], repeats.written

    def watched(df, label):
        kept.append((label, write(df, label)))
        return kept[-1][1]

    monkeypatch.setattr(repeats, "written", watched)
    rows = [(i, text(prose(i, 40), ["of", "the"] * (100 + i), prose(50 + i, 40))) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.start, r.end) for r in repeats.passages(docs).collect()}
    # ends may run on by a word of the same hash
    assert {(d, s // 10, e // 10) for d, s, e in got} == {(i, 4, (240 + 2 * min(i, 6)) // 10) for i in range(8)}
    made = sum(t.count() for label, t in kept if label == "stretches")
    assert 14 <= made <= 32 and repeats.stretches(docs).count() > 10 * made


def test_joined_sides_make_the_passages_that_all_stretches_make(spark):
    draw = random.Random(4)
    lines = [prose(i, draw.choice([7, 12, 30])) for i in range(20)] + [["a", "b"] * 30, ["of"] * 40]
    docs = spark.createDataFrame([(d, text(*(draw.choice(lines) for _ in range(9)), prose(90 + d, 30))) for d in range(30)], DOCS)
    rows = repeats._rows(docs, "doc_id", "text", repeats.K, repeats.WINDOW)
    matches, how = repeats._written_matches(rows), (repeats.K, repeats.LEAST_SEEDS, repeats.STRETCH, repeats.IDENTITY)
    raw = [r.asDict() for r in repeats._stretches(rows, matches, *how).collect()]
    sides = [(r["row"], r["doc_id"], r["start"], r["end"], r["other"], r["other_id"]) for r in raw]
    sides += [(r["other"], r["other_id"], r["other_start"], r["other_end"], r["row"], r["doc_id"]) for r in raw]
    schema = "row long, doc_id long, start int, end int, other long, other_id long"
    each = repeats._islands(spark.createDataFrame(sides, schema), repeats.LENGTH, repeats.BRIDGE)
    joined = repeats._sides(rows, matches, *how, repeats.BRIDGE)
    assert joined.count() < len(sides)
    assert sorted(map(tuple, repeats._islands(joined, repeats.LENGTH, repeats.BRIDGE).select(each.columns).collect())) == sorted(map(tuple, each.collect()))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1, max_size=20), st.sets(st.integers(0, 300), min_size=1, max_size=20))
def test_rising_matches_make_the_best_chain(x, y):
    """The same as with a match beside them that doesn't rise, which takes the way through the tree."""
    n = min(len(x), len(y))
    x, y = sorted(x)[:n], sorted(y)[:n]
    far = 10**6
    got = repeats.chains(x, y, 5, 0.1, 1)
    assert got == [c for c in repeats.chains([*x, far, far], [*y, far, far], 5, 0.1, 1) if c[0] < n]


@given(st.lists(st.integers(0, 1), min_size=40, max_size=40), st.lists(st.integers(0, 1), min_size=40, max_size=40),
       st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=6))
def test_gaps_that_are_equal(a, b, steps):
    a, b = np.array(a), np.array(b)
    x, y = np.cumsum([0, *(s[0] for s in steps)]), np.cumsum([0, *(s[1] for s in steps)])
    expected = [np.array_equal(a[i:p], b[j:q]) for i, p, j, q in zip(x, x[1:], y, y[1:])]
    assert repeats._equal_gaps(a, b, x, y).tolist() == expected


@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(1, 12))
def test_hashes_of_windows_and_least_values(words, length):
    length = min(length, len(words))
    windows = [tuple(words[i:i + length]) for i in range(len(words) - length + 1)]
    key = repeats.window_hashes(np.array(words, "<u2"), length).tolist()
    assert len(key) == len(windows) and len(set(zip(key, windows))) == len(set(key)) == len(set(windows))
    assert repeats._least(np.array(words, np.uint64), length).tolist() == [i + w.index(min(w)) for i, w in enumerate(windows)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40), st.integers(1, 9))
def test_common_words_in_blocks(a, b, bits):
    a, b = np.array(a, int), np.array(b, int)
    assert repeats._common(a, b, bits) == repeats._common(a, b, 64)


def test_a_long_gap_is_held_once_and_not_squared():
    draw = np.random.default_rng(1)
    a = draw.permutation(40_000).astype("<u2")
    b = np.append(a[20_000:], a[:20_000])
    tracemalloc.start()
    try:
        assert repeats._common(a, b) >= 20_000
        assert tracemalloc.get_traced_memory()[1] < 16e6    # 100 MB with the places of every word in one number
    finally:
        tracemalloc.stop()


def test_what_goes_to_python_is_bounded_in_bytes(spark):
    @F.pandas_udf("int")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    docs = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("a"), 1_000_000).alias("text"))
    with repeats.settings(spark, repeats.BOUNDED):
        assert max(r[0] for r in docs.select(together("text")).collect()) <= 8
