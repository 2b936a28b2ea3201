import math
import random

import pytest
from hypothesis import given, settings, strategies as st

from conftest import rows
from sievespan.operators.segments import find_runs, run_summary, run_text


def plain_runs(values, threshold, least):
    """The runs of one track, found by walking along it."""
    found, begin = [], None
    for place, value in enumerate([*values, -math.inf], start=1):
        if value > threshold:
            begin = begin or place
        elif begin:
            if place - begin >= least:
                found.append((begin, place - 1, place - begin, max(values[begin - 1:place - 1])))
            begin = None
    return found


def track(spark, tracks):
    data = [(k, i, float(v)) for k, vs in tracks.items() for i, v in enumerate(vs, 1)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "id string, res int, agg double")


EDGES = {
    "four": [9, 9, 9, 9, 0], "five": [0, 9, 9, 9, 9, 9, 0], "at": [5, 5, 5, 5, 5, 5], "start": [6] * 5 + [0],
    "end": [0] + [6] * 5, "all": [7] * 12, "two": [8] * 5 + [5.0] + [9, 8, 7, 6, 5.1, 5.2], "none": [1] * 8,
    "nan": [9, 9, 9, math.nan, 9, 9, 9],
}


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 1 << 16])
def test_edges(spark, chunk):
    got = rows(find_runs(track(spark, EDGES), "id", "res", "agg", chunk_rows=chunk))
    want = {(k, *r) for k, v in EDGES.items() for r in plain_runs(v, 5.0, 5)}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.lists(st.sampled_from([0, 5, 6, 9]), min_size=1, max_size=60), min_size=1),
       st.integers(1, 9), st.integers(1, 4))
def test_against_a_walk(spark, tracks, chunk, least):
    got = rows(find_runs(track(spark, tracks), "id", "res", "agg", 5.0, least, chunk_rows=chunk))
    assert got == {(k, *r) for k, v in tracks.items() for r in plain_runs(v, 5.0, least)}


def test_summary_and_text(spark):
    tracks = track(spark, EDGES)
    roster = spark.createDataFrame([(k,) for k in [*EDGES, "untracked"]], "id string")
    runs = find_runs(tracks, "id", "res", "agg")
    got = {r["id"]: r for r in run_summary(roster, tracks, runs, "id", "agg").collect()}
    assert len(got) == len(EDGES) + 1
    assert (got["two"]["n_runs"], got["two"]["status"], got["two"]["longest_run"]) == (2, "FAIL", 6)
    assert (got["four"]["n_runs"], got["four"]["status"], got["four"]["score_total"]) == (0, "PASS", 36.0)
    assert (got["untracked"]["status"], got["untracked"]["score_total"]) == ("PASS", 0.0)
    strict = run_summary(roster, tracks, runs, "id", "agg", empty_track="no_track")
    assert strict.where("id = 'untracked'").first()["status"] == "no_track"
    text = dict((r[0], r[2]) for r in run_text(runs, "id").collect())
    assert text["two"] == "res1-5(len=5,max=8.0%); res7-12(len=6,max=9.0%)"


def test_long_text_goes_over_lines(spark):
    runs = find_runs(track(spark, {"a": ([9] * 5 + [0]) * 4}), "id", "res", "agg")
    lines = sorted(tuple(r) for r in run_text(runs, "id", per_line=12).collect())
    assert [l[1] for l in lines] == [0, 1]
    assert "; ".join(l[2] for l in lines) == "; ".join(
        f"res{s}-{s + 4}(len=5,max=9.0%)" for s in (1, 7, 13, 19))
