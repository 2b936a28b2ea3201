import random

import numpy as np
import xxhash

from sievespan.llm import simhash
from sievespan.llm.components import connected_components
from sievespan.llm.queries import op6_simhash

FOLDER = "/root/testdata/sf0.001"


def plain_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def plain_components(items, linked):
    """{id: smallest id reachable} by comparing everything with everything."""
    label = {i: i for i, _ in items}
    changed = True
    while changed:
        changed = False
        for a, x in items:
            for b, y in items:
                if label[b] < label[a] and linked(x, y):
                    label[a], changed = label[b], True
    return label


def near(x, y):
    return (x ^ y).bit_count() <= 3


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, plain_print(r.text)) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    label = plain_components(docs, near)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op6_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in docs}
    assert len(set(label.values())) < len(label)


def test_links_lose_nothing_in_small_tiles(spark):
    draw = random.Random(1)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        prints |= {p ^ sum(1 << b for b in draw.sample(range(64), n)) for n in (1, 2, 3, 4)}
    prints = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for tile in (4, 1024):
        edges = simhash.links(spark.createDataFrame(prints, "print long"), tile=tile)
        got = {r.node: r.component for r in connected_components(edges).collect()}
        want = plain_components([(p, p & (1 << 64) - 1) for p, in prints], near)
        assert {p: got.get(p, p) for p in want} == want


def test_forest_spans_strips():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 62, 5)
    prints = np.unique(np.concatenate([base ^ (1 << i) for i in range(20)] + [base]))
    label = simhash.forest(prints, 3, strip=7)
    assert len(set(label.tolist())) == 5


def test_chain_of_links_is_one_component(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (None, 5), (2000, 1999), (2000, 1999)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1999: 1999, 2000: 1999}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    empty = [r for r in got if r.doc_id in (0, 1, 2, 3)]
    assert {(r.fingerprint, r.component_id) for r in empty} == {("0" * 16, 0)} and len(empty) == 5
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_document_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    found = {r.component_id for r in simhash.near_duplicates(odd_docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(i for i in found if i is not None)
    assert ids.count(None) == 2
    assert simhash.keep_first(no_docs).count() == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.simhash(text.encode()) & (1 << 64) - 1 == plain_print(text)


def test_one_row_of_each_component_stays(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away from the old house near the river"
    b = "eine ganz andere Sache ist es wenn man am Morgen aufsteht und die Zeitung nicht im Kasten liegt"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "z"), (None, a, "x"), (None, "c d e f g", "x"), (None, "c d e f g", "y"),
            (7, None, "x"), (7, "", "y"), (8, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n string").selectExpr("*", "1 AS _gone", "2 AS _of")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == sorted(
        [(1, a), (5, b), (None, a), (None, "c d e f g"), (None, "c d e f g"), (7, "")], key=repr)
