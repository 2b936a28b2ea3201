from itertools import permutations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sievespan.operators.gates import Gate, add_gate_flags, in_ranges, require_all, split_by_gate
from sievespan.plans import funnel

ROSTER = [(i,) for i in "abcdefgh"]


def gates(spark, on_missing="fail"):
    one = spark.createDataFrame([("a", "yes"), ("b", "no"), ("c", "yes"), ("d", "yes"), ("e", "Yes"),
                                 ("f", None), ("z", "yes")], "id string, verdict string")
    two = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0), ("e", 1)], "id string, flag int")
    three = spark.createDataFrame([("a", 5.0), ("c", 1.0), ("d", 9.0)], "id string, score double")
    return [Gate("s1", F.col("verdict") == "yes", one),
            Gate("s2", F.col("flag") == 1, two, on_missing=on_missing),
            Gate("s3", F.col("score") > 2, three)]


def roster(spark):
    return spark.createDataFrame(ROSTER, "id string")


def test_missing_evidence_fails_by_default(spark):
    flags = add_gate_flags(roster(spark), gates(spark))
    got = {r["id"]: (r["s1_pass"], r["s2_pass"], r["s3_pass"]) for r in flags.collect()}
    assert got["a"] == (True, True, True)
    assert got["e"] == (False, True, False)      # texts are compared exactly
    assert got["f"] == (False, False, False)     # NULL verdict
    assert got["h"] == (False, False, False)     # no row anywhere
    assert len(got) == len(ROSTER)               # ids outside the roster do not appear


@pytest.mark.parametrize("rule, passed, pending", [("fail", False, False), ("pending", False, True), ("pass", True, False)])
def test_rules_for_missing_evidence(spark, rule, passed, pending):
    flags = add_gate_flags(roster(spark), gates(spark, rule))
    d = flags.where("id = 'd'").first()
    assert (d["s2_pass"], d["s2_pending"]) == (passed, pending)
    c = flags.where("id = 'c'").first()           # a failing row is no missing row
    assert (c["s2_pass"], c["s2_pending"]) == (False, False)


def test_last_row_of_a_repeated_id_counts(spark):
    twice = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 5, 1), ("b", 6, 0)], "id string, n int, ok int")
    flags = add_gate_flags(roster(spark), [Gate("g", F.col("ok") == 1, twice, order=("n",))])
    assert flags.count() == len(ROSTER)
    assert {r["id"] for r in flags.where("g_pass").collect()} == {"a"}


def test_survivors_and_eliminated_make_up_the_roster(spark):
    flags = add_gate_flags(roster(spark), gates(spark))
    kept, out = split_by_gate(flags, "s1")
    kept, out = rows(kept.select("id")), rows(out.select("id"))
    assert kept == {("a",), ("c",), ("d",)}
    assert not kept & out and kept | out == set(ROSTER)


def test_every_order_retains_the_same_set(spark):
    base = add_gate_flags(roster(spark), gates(spark)).cache()
    stages = {}
    for order in permutations(["s1", "s2", "s3"]):
        frame = funnel.add_outcome(base, list(order))
        assert rows(frame.where("outcome = 'retained'").select("id")) == {("a",)}
        stages[order] = dict(rows(funnel.funnel_audit(frame)))
    assert stages[("s1", "s2", "s3")]["c"] == "s2"
    assert stages[("s3", "s2", "s1")]["c"] == "s3"   # the stage depends on the order


def test_loop_over_stages_gives_the_same_audit(spark):
    order = ["s3", "s1", "s2"]
    flags = {r["id"]: r for r in add_gate_flags(roster(spark), gates(spark)).collect()}
    alive, audit, counts = [i for (i,) in ROSTER], {}, []
    for n, stage in enumerate(order):
        kept = [i for i in alive if flags[i][f"{stage}_pass"]]
        audit |= {i: stage for i in alive if i not in kept}
        counts.append((n + 1, stage, len(alive), len(kept), len(alive) - len(kept), 0))
        alive = kept
    frame = funnel.run_funnel(roster(spark), gates(spark), order)
    assert dict(rows(funnel.funnel_audit(frame))) == audit
    assert [tuple(r) for r in funnel.funnel_counts(frame, order).orderBy("stage_no").collect()] == counts


def test_pending_stops_a_candidate_only_where_it_arrives(spark):
    frame = funnel.run_funnel(roster(spark), gates(spark, "pending"), ["s1", "s2", "s3"])
    got = {r["id"]: (r["outcome"], r["at_stage"]) for r in frame.collect()}
    assert got["d"] == ("pending", "s2")
    assert got["f"] == ("eliminated", "s1")        # out before it would have to wait
    counts = {r["stage"]: r["pending_count"] for r in funnel.funnel_counts(frame, ["s1", "s2", "s3"]).collect()}
    assert counts == {"s1": 0, "s2": 1, "s3": 0}
    replayed = funnel.run_funnel(roster(spark), gates(spark, "pending"), replay=True)
    assert replayed.where("outcome = 'pending'").isEmpty()


def test_resume_equals_the_full_run(spark):
    order = ["s1", "s2", "s3"]
    full = funnel.run_funnel(roster(spark), gates(spark), order)
    alive = funnel.alive_after(full, order, "s1")
    rest = funnel.resume_after(roster(spark), gates(spark), order, "s1", alive)
    want = full.where("s1_pass").select("id", "outcome", "at_stage")
    assert rows(rest.select("id", "outcome", "at_stage")) == rows(want)
    done = funnel.resume_after(roster(spark), gates(spark), order, "s3",
                               funnel.alive_after(full, order, "s3"))
    assert rows(done.select("id", "outcome")) == {("a", "retained")}


def test_unknown_stage_and_repeated_stage(spark):
    with pytest.raises(ValueError, match="unknown"):
        funnel.run_funnel(roster(spark), gates(spark), ["s1", "s9"])
    with pytest.raises(ValueError, match="twice"):
        add_gate_flags(roster(spark), gates(spark)[:1] * 2)
    with pytest.raises(ValueError, match="on_missing"):
        Gate("x", F.lit(True), on_missing="maybe")


def test_gates_on_one_table_share_a_join(spark):
    labels = spark.createDataFrame([("a", 1, 0)], "id string, q int, t int")
    flags = add_gate_flags(roster(spark), [Gate("q", F.col("q") == 1, labels), Gate("t", F.col("t") == 0, labels)])
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_required_keys(spark):
    long = spark.createDataFrame(
        [("a", "k1", 1), ("a", "k2", 1), ("a", "k3", 0), ("b", "k1", 1), ("c", "k1", 1), ("c", "k2", 0), ("d", "k3", 1)],
        "id string, key string, ok int")
    got = rows(require_all(long, "id", "key", "ok", ["k1", "k2"], roster(spark).where("id < 'f'")))
    assert got == {("a", True), ("b", False), ("c", False), ("d", False), ("e", False)}
    assert dict(rows(require_all(long, "id", "key", "ok", ["k1", "k2"])))["d"] is False


def test_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0), (3.0, 6.1), (0.9, 1.0)], "a double, b double")
    assert rows(df.where(in_ranges({"a": 1.0}, {"b": 6.0}))) == {(1.0, 5.0), (2.0, 6.0)}


def test_gates_from_a_table(spark):
    from sievespan.operators.gates import GATES, gates_from
    roster = spark.createDataFrame([("a", 1), ("b", 9), ("c", 1), ("d", 2)], "id string, size int")
    proof = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("c", 1, True)], "id string, seen int, ok boolean")
    given = [("big", None, "size < 5", None, None), ("proof", "proof", "ok", "pending", ["seen"])]
    gates = gates_from(spark.createDataFrame(given, GATES), {"proof": proof}, roster)
    frame = funnel.run_funnel(roster, gates, ["big", "proof"])
    assert rows(frame.select("id", "outcome", "at_stage")) == {
        ("a", "eliminated", "proof"), ("b", "eliminated", "big"), ("c", "retained", None), ("d", "pending", "proof")}
    wrong = [("big", None, "weight < 5", None, None), ("odd", "absent", "ok", None, None), ("sum", "proof", "seen + 1", None, None),
             ("typo", "proof", "ok = (", "perhaps", None), ("last", "proof", "ok", None, ["at"])]
    with pytest.raises(ValueError) as error:
        gates_from(spark.createDataFrame(wrong, GATES), {"proof": proof}, roster)
    for text in ("`weight`", "no evidence 'absent'", "seen + 1 is no condition but int", "'perhaps'", "proof has no column at", "typo: ok = ("):
        assert text in str(error.value)
