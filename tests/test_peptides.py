"""The whole triage on small invented evidence."""

import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sievespan import constants as C
from sievespan.plans import funnel, peptides, pose

ATOMS = "id string, receptor string, chain string, resnum int, x double, y double, z double"


def receptor(structure, length, seed):
    rng = random.Random(seed)
    return [(*structure, "A", r, rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(-40, 40))
            for r in range(1, length + 1)]


def place(atoms, structure, chain, res, near, off):
    x, y, z = next(a[4:] for a in atoms if a[:4] == (*structure, "A", near))
    atoms.append((*structure, chain, res, x + off, y, z))


def plain_pose(atoms):
    """The check spelled out for one structure, all pairs compared."""
    got = {}
    for s in {a[:2] for a in atoms}:
        mine = {(a[2], a[3]): a[4:] for a in atoms if a[:2] == s}
        chain = next((c for c in "LB" if any(k[0] == c for k in mine)), None)
        bounds = {b[0]: b[1:] for b in C.REGION_BOUNDARIES}.get(sum(k[0] == "A" for k in mine))
        if not chain or not bounds:
            continue
        ecd_end, tm1, deep, tmd_end = bounds

        def points(c, first, past):
            return [mine[c, r] for r in range(first, past) if (c, r) in mine]

        def least(p, q):
            return min((math.dist(u, v) for u in p for v in q), default=999.0)

        n = least(points(chain, 1, 14), points("A", tm1, tmd_end))
        d = least(points(chain, 26, 38), points("A", deep, ecd_end + 1))
        got[s] = (n, d, n <= 8, d <= 8, n <= 8 and d <= 8)
    return got


def test_pose_check(spark):
    atoms = []
    for n, (length, last) in enumerate([(474, 400), (461, 400), (450, 376), (438, 376)]):
        s = (f"p_{n}", "CTR")
        mine = receptor(s, length, n)
        place(mine, s, "L", 1, last, 8.0)            # exactly the cutoff, at the last TMD residue
        place(mine, s, "L", 26, {474: 131, 461: 129, 450: 107, 438: 106}[length], 3.0)
        place(mine, s, "B", 2, last - 5, 0.5)        # a second protein, not the peptide
        atoms += mine
    past = ("past", "CTR")
    mine = receptor(past, 474, 9)
    far = [(*a[:4], a[4] + 1000, a[5], a[6]) if a[3] != 401 else (*a[:4], 0.0, 0.0, 0.0) for a in mine]
    far.append((*past, "L", 13, 0.0, 0.0, 1.0))       # touches residue 401, just outside the region
    atoms += far
    only_b, odd, bare = ("only_b", "CTR"), ("odd", "CTR"), ("bare", "CTR")
    mine = receptor(only_b, 474, 10)
    place(mine, only_b, "B", 13, 200, 1.0)
    place(mine, only_b, "B", 37, 100, 1.0)
    atoms += mine + receptor(odd, 470, 11) + [(*odd, "L", 1, 0.0, 0.0, 0.0)] + receptor(bare, 474, 12)

    got = {(r["id"], r["receptor"]): (r["d_nterm_tmd"], r["d_cterm_deep"], r["nterm_pass"], r["deep_pass"], r["pose_pass"])
           for r in pose.pose_check(spark.createDataFrame(atoms, ATOMS)).collect()}
    want = plain_pose(atoms)
    assert got.keys() == want.keys() and len(want) == 6
    for s, w in want.items():
        assert got[s][:2] == (pytest.approx(w[0], rel=1e-12), pytest.approx(w[1], rel=1e-12))
        assert got[s][2:] == w[2:]
    assert got[("past", "CTR")][0] > 8 and got[("past", "CTR")][1] == 999.0
    assert got[("only_b", "CTR")][4]


IDS = ["n_1", "n_2", "n_3", "n_4", "n_5"]



def test_pose_results(spark):
    checked = spark.createDataFrame(
        [("b", "CTR", 1.005, 999.0, True, False, False), ("a", "CTR", 2.675, 8.0, True, True, True),
         ("a", C.RECEPTORS[0], 0.125, 3.0, True, True, True), ("a", "other", 1.0, 1.0, True, True, True)],
        "id string, receptor string, d_nterm_tmd double, d_cterm_deep double, nterm_pass boolean, deep_pass boolean, pose_pass boolean")
    got = [tuple(r) for r in pose.pose_results(checked).collect()]
    assert got == [("a", C.RECEPTORS[0], f"{0.125:.2f}", "3.00", 1, 1, 1), ("a", "CTR", f"{2.675:.2f}", "8.00", 1, 1, 1),
                   ("b", "CTR", f"{1.005:.2f}", "999.00", 1, 0, 0)]
    ids = spark.createDataFrame([("b", 1), ("a", 2)], "id string, roster_pos int")
    assert [r["id"] for r in pose.pose_results(checked, ids, ["CTR"]).collect()] == ["b", "a"]


def evidence(spark):
    def verdicts(**passed):
        return spark.createDataFrame(list(passed.items()), "id string, passed boolean")

    docked = [(i, r, 1) for i in ("n_1", "n_2", "n_3") for r in C.REQUIRED_RECEPTORS]
    docked += [("n_4", "AMY1R", 1), ("n_4", "AMY2R", 1), ("n_4", "CTR", 1), ("n_1", "CGRP", 0)]
    return peptides.Evidence(
        aggregation=verdicts(n_1=True, n_2=True, n_3=False, n_4=True),
        allergenicity=verdicts(n_1=True, n_2=True, n_3=True, n_4=True),
        toxicity=verdicts(n_1=True, n_2=True, n_3=False, n_4=True, n_5=True),
        pose=spark.createDataFrame(docked, "id string, receptor string, pose_pass int"),
        coverage=spark.createDataFrame([("n_2", 0), ("n_4", None)], "id string, cd4_pass int"))


def roster(spark):
    return spark.createDataFrame([(i, "AA", C.PEPTIDE_PREFIX + "AA", *[0.5] * 7) for i in IDS],
                                 ["id", "seq_24aa", "full_37aa", *C.RECEPTORS])


def test_integrated_report(spark):
    report = peptides.integrated_report(roster(spark), evidence(spark)).cache()
    assert report.columns == [
        "id", "seq_24aa", "full_37aa", "pose_AMY1R", "pose_AMY2R", "pose_AMY3R", "pose_CTR", "pose_CGRP", "pose_AM1R",
        "pose_AM2R", "tango_pass", "tox3_pass", "aller_pass", "cd4_pass", "amy_pose_pass", "safety_pass", "final_pass",
        "eliminated_at_stage"]
    got = {r["id"]: r for r in report.collect()}
    assert len(got) == 5
    assert {i: r["eliminated_at_stage"] for i, r in got.items()} == {
        "n_1": "", "n_2": "", "n_3": "03_aggregation", "n_4": "01_pose_check", "n_5": "03_aggregation"}
    assert {i for i, r in got.items() if r["final_pass"]} == {"n_1", "n_2"}
    assert (got["n_4"]["pose_CTR"], got["n_4"]["pose_AMY3R"], got["n_5"]["pose_AMY1R"]) == (1, 0, 0)
    assert [got[i]["cd4_pass"] for i in IDS] == [True, False, True, None, True]
    assert rows(peptides.final_panel(report).select("id", "final_status")) == {("n_1", "retained")}
    assert "eliminated_at_stage" not in peptides.integrated_report(roster(spark), evidence(spark), with_stage=False).columns


def test_all_24_orders_agree(spark):
    e = evidence(spark)
    base = peptides.triage(roster(spark), e).drop("outcome", "at_stage").cache()
    for order in permutations(C.DEFAULT_ORDER):
        frame = funnel.add_outcome(base, list(order))
        assert rows(frame.where("outcome = 'retained'").select("id")) == {("n_1",), ("n_2",)}


def test_counts_per_stage(spark):
    frame = peptides.triage(roster(spark), evidence(spark))
    counts = [(r["stage"], r["input_count"], r["pass_count"], r["fail_count"])
              for r in funnel.funnel_counts(frame, C.DEFAULT_ORDER).orderBy("stage_no").collect()]
    assert counts == [("03", 5, 3, 2), ("04", 3, 3, 0), ("05", 3, 3, 0), ("01", 3, 2, 1)]
    waiting = peptides.triage(roster(spark), evidence(spark), ["04", "03", "05", "01"], replay=False)
    assert rows(waiting.where("outcome = 'pending'").select("id")) == {("n_5",)}


def test_preselection(spark):
    df = roster(spark).withColumn("CTR", F.when(F.col("id") == "n_2", 0.4).otherwise(F.col("CTR")))
    kept = peptides.preselect(df, {"AMY1R": 0.5}, {"CTR": 0.4})
    assert rows(kept.select("id")) == {("n_2",)}


def test_aggregation_table(spark):
    tracks = [("n_1", r, "K", 0.5) for r in range(1, 39)]
    tracks += [("n_2", r, "K", 31.25 if 25 <= r <= 30 else 1.0) for r in range(1, 39)]
    table = peptides.aggregation_results(roster(spark), spark.createDataFrame(tracks, "id string, res int, aa string, agg double"))
    got = {r["id"]: (r["AGG_total"], r["n_APR"], r["APR_detail"], r["TANGO_pass"]) for r in table.collect()}
    assert got["n_1"] == ("19.0000", 0, "none", "PASS")
    assert got["n_2"] == ("219.5000", 1, "res25-30(len=6,max=31.2%)", "FAIL")   # 31.25 rounds to even
    assert got["n_5"] == ("0.0000", 0, "none", "PASS")


def test_toxicity_table(spark):
    raw = spark.createDataFrame([("n_1", "0.04", "Non-Toxin", "0.0"), ("other", "0.5", "Toxin", None)],
                                ["Subject", "Hybrid Score", "Prediction", "PPV"])
    got = rows(peptides.toxicity_results(raw, roster(spark)))
    assert got == {("n_1", C.PEPTIDE_PREFIX + "AA", "0.040", "0.0", "Non-Toxin", "PASS"),
                   ("other", "", "0.500", None, "Toxin", "FAIL")}
    other = spark.createDataFrame([("n_1", "0.1", "Toxin")], ["ID", "ML Score", "Prediction"])
    assert peptides.toxicity_results(other, roster(spark)).first()["toxin_pass"] == "FAIL"
