import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from sievespan.llm import packing
from sievespan.llm.queries import END_ID, RANKS, op3_packing

from .odd import ODD

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path(RANKS), "rb") as f:
        return f.read()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_rows_are_those_of_a_plain_search(sizes):
    """Best-fit decreasing by looking at every row."""
    free, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(free)) if free[r] >= sizes[i]]
        if fits:
            best = min(free[r] for r in fits)
            want[[r for r in fits if free[r] == best][-1]].append(i)
            free[[r for r in fits if free[r] == best][-1]] -= sizes[i]
        else:
            want.append([i])
            free.append(40 - sizes[i])
    got = packing.best_fit_decreasing(np.array(sizes, int), 40)
    assert sorted(map(sum, ([sizes[i] for i in r] for r in got))) == sorted(map(sum, ([sizes[i] for i in r] for r in want)))
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 40 for r in got)


def check_rows(rows, length, end_id):
    for r in rows:
        ids, places = np.frombuffer(r.token_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert len(r.doc_ids) == len(r.pieces) == len(r.cu_seqlens) - 1
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert a < b and (places[a:b] == np.arange(b - a)).all()
        assert (ids[r.n_tokens:] == end_id).all() and not places[r.n_tokens:].any()


def test_query_loses_nothing(spark, ranks):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op3_packing(spark, FOLDER)
    check_rows(rows.collect(), packing.LENGTH, END_ID)
    own = packing.encoding(ranks, public_tokenizers.PATTERN)
    got = {r.doc_id: np.frombuffer(r.token_ids, "<u2").tolist() for r in packing.unpacked(rows).collect()}
    assert got == {i: [*own.encode_ordinary(t or ""), END_ID] for i, t in docs.items()}


def test_odd_texts_in_short_rows_and_many_shards(spark, ranks):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = packing.pack(docs, ranks, public_tokenizers.PATTERN, END_ID, length=16, shard_bytes=1000)
    check_rows(rows.collect(), 16, END_ID)
    assert rows.select("shard").distinct().count() > 5
    own = packing.encoding(ranks, public_tokenizers.PATTERN)
    got = {r.doc_id: np.frombuffer(r.token_ids, "<u2").tolist() for r in packing.unpacked(rows).collect()}
    assert got == {i: [*own.encode_ordinary(t or ""), END_ID] for i, t in enumerate(ODD)}


def test_long_white_space(ranks):
    own = packing.encoding(ranks, public_tokenizers.PATTERN)
    for text in (" " * 5000, "a" + " " * 2000 + "b", "\n" * 1500 + "x", " \t" * 900 + "\n", "a " * 2000):
        assert packing.tokens(own, text).tolist() == own.encode_ordinary(text)
    assert len(packing.tokens(own, "x" + " " * 2_000_000 + "y")) > 1000


def test_no_documents_and_clashing_columns(spark, ranks, no_docs, odd_docs):
    assert packing.pack(no_docs, ranks, public_tokenizers.PATTERN, END_ID).count() == 0
    rows = packing.pack(odd_docs, ranks, public_tokenizers.PATTERN, END_ID)
    assert sum(len(r.doc_ids) for r in rows.collect()) >= odd_docs.count()


def test_written_rows_are_read_again(spark, ranks, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    rows = packing.pack(docs, ranks, public_tokenizers.PATTERN, END_ID, length=8)
    packing.write_packed(rows, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).collect() == rows.collect()


def test_ids_stay_exact_and_rows_apart(spark, ranks):
    """Null ids beside large ones, ids that are texts, and equal rows."""
    own = packing.encoding(ranks, public_tokenizers.PATTERN)
    big = [(2**60 + 1, "one two"), (2**60 + 3, "one two"), (None, "three"), (None, None), (7, "x y"), (7, "x y"), (7, "z")]
    for rows, kind in ((big, "long"), ([(None if i is None else f"id {i}", t) for i, t in big], "string")):
        packed = packing.pack(spark.createDataFrame(rows, f"doc_id {kind}, text string"), ranks, public_tokenizers.PATTERN, END_ID,
                              length=4, shard_bytes=4)
        got = [(r.doc_id, np.frombuffer(r.token_ids, "<u2").tolist()) for r in packing.unpacked(packed).collect()]
        assert sorted(got, key=repr) == sorted(((i, [*own.encode_ordinary(t or ""), END_ID]) for i, t in rows), key=repr)
