import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from sievespan.llm import periodic
from sievespan.llm.queries import op11_periodic

from .odd import ODD

FOLDER = "/root/testdata/sf0.001"


def plain_runs(w):
    """All runs, by looking at every period of the whole sequence."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            run = w[i:j + q]
            if len(run) >= max(6, 4 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((i, len(run), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ")
            .replace("\r", " ").split(" ") if w]


def planted(doc, text):
    w = words_of(text)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(doc, text):
    w = planted(doc, text)
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    held = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            digest(" ".join(x for i, x in enumerate(w) if i not in held)))


pieces = st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=5), st.integers(1, 7)), max_size=12)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_runs_are_those_of_a_plain_search(parts):
    w = [x for word, times in parts for x in word * times]
    assert periodic.periodic_runs([str(x) for x in w]) == plain_runs(w)


def test_nested_runs_and_rows_of_one_word():
    a = [1, 2] * 4 + [3]
    for w in (a * 5, [1] * 5, [1] * 6, [1, 1, 1, 2] * 9, ([7] * 9 + [1, 2, 3] * 5) * 4, [1, 2] * 3 + [1]):
        assert periodic.periodic_runs(list(map(str, w))) == plain_runs(w)
    n = 200_000
    assert periodic.periodic_runs(["x"] * n) == [(0, n, 1)]
    rng = random.Random(1)
    block = [str(rng.randrange(20)) for _ in range(10_000)]
    assert periodic.periodic_runs(block * 6) == [(0, 60_000, 10_000)] or (0, 60_000, 10_000) in periodic.periodic_runs(block * 6)


def test_splitting_keeps_all_runs_and_leaves_little():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 3000, 6000)
    w[1000:1400] = np.tile(rng.integers(0, 3000, 40), 10)
    left = periodic.segments(w)
    assert any(a <= 1000 and b >= 1400 for a, b in left)
    assert sum(b - a for a, b in left) < 1500
    for a, b in left:
        assert min(np.unique(w[a:b], return_counts=True)[1]) >= periodic.EXPONENT


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in op11_periodic(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    short = [d for d in docs if len(words_of(d.text)) < 3000]    # the plain search is quadratic
    assert len(short) > 150 and any(got[d.doc_id][1] for d in short)
    assert [d.doc_id for d in short if got[d.doc_id] != wanted(d.doc_id, d.text)] == []


def test_odd_rows(spark, odd_docs, no_docs):
    assert periodic.add_runs(no_docs).count() == 0 and periodic.collapsed(no_docs).count() == 0
    kept = odd_docs.withColumn("periodic", odd_docs["row"])
    got = periodic.collapsed(kept)
    assert got.columns == kept.columns and got.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in got.where("doc_id <> 2 AND doc_id is not null").collect()}
    assert texts[8] == "word" and all(texts[i] == t for i, t in enumerate(ODD) if i not in (2, 8))
    assert periodic.with_planted_runs(odd_docs).count() == odd_docs.count()


def test_planted_runs(spark):
    text = "a b  c\td e f g\nh i j k l m n o p q r s t"
    rows = spark.createDataFrame([(doc, text) for doc in range(400)], "doc_id long, text string")
    chosen = [r for r in periodic.with_planted_runs(rows).collect() if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    assert len(chosen) > 20
    assert all(r.text == " ".join(planted(r.doc_id, text)) for r in chosen)
