import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sievespan import constants as C
from sievespan.operators import jobs, subsets
from sievespan.operators.gates import Gate
from sievespan.plans import funnel, pose, runs, table_queries
from sievespan.sinks import writers
from sievespan.sources import alignments, documents, evidence, structures, tracks


def put(path, text, age=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if age:
        os.utime(path, (path.stat().st_mtime - age,) * 2)
    return str(path)


def lines_of(folder):
    return [l for f in sorted(folder.rglob("part-*")) for l in f.read_text().splitlines()]


def test_roster_keeps_file_order(spark, tmp_path):
    path = put(tmp_path / "r.csv", "id,seq_24aa,full_37aa,AMY1R,AMY2R\nz,AA,KAA,0.7,0.1\na,BB,KBB,0.5,\n")
    got = evidence.read_roster(spark, path).orderBy("roster_pos")
    assert [(r["id"], r["AMY1R"], r["AMY2R"], r["CTR"]) for r in got.collect()] == [
        ("z", 0.7, 0.1, None), ("a", 0.5, None, None)]


def test_ids_are_trimmed_and_repeats_stay(spark, tmp_path):
    path = put(tmp_path / "ids.txt", "b \n\n\ta\n   \nb\n")
    assert sorted(r[0] for r in evidence.read_ids(spark, path).collect()) == ["a", "b", "b"]


def test_allergenicity_takes_the_newest_file(spark, tmp_path):
    put(tmp_path / "al_1.csv", "Protein,Result\na,no evidence\nb,weak evidence\n,no evidence\n", age=100)
    put(tmp_path / "al_2.csv", "Protein,Result\na,strong evidence\nc,No Evidence\n")
    got = rows(evidence.read_allergenicity(spark, str(tmp_path / "al_*.csv")))
    assert got == {("a", False), ("b", False), ("c", False)}
    put(tmp_path / "al_3.csv", "Protein,Result\nb,no evidence\n", age=-100)
    assert ("b", True) in rows(evidence.read_allergenicity(spark, str(tmp_path / "al_*.csv")))


def test_toxicity_headers(spark, tmp_path):
    a = put(tmp_path / "a.csv", "Subject,Prediction\nx,Non-Toxin\ny,Toxin\nx,Toxin\n")
    b = put(tmp_path / "b.csv", "id,Prediction\nx,Non-Toxin\n")
    c = put(tmp_path / "c.csv", "Subject,id,Prediction\n,w,Non-Toxin\nv,w2,non-toxin\n")
    assert rows(evidence.read_toxicity(spark, a)) == {("x", False), ("y", False)}   # last row counts
    assert rows(evidence.read_toxicity(spark, b)) == {("x", True)}
    assert rows(evidence.read_toxicity(spark, c)) == {("w", True), ("v", False)}


def test_other_evidence(spark, tmp_path):
    path = put(tmp_path / "t.csv", 'id,APR_detail,TANGO_pass\na,"res1-5(len=5,max=9.0%); res9-20(len=12,max=6.1%)",FAIL\nb,none,PASS\n')
    assert rows(evidence.read_aggregation(spark, path)) == {("a", False), ("b", True)}
    path = put(tmp_path / "p.csv", "id,receptor,source,pose_pass\na,CTR,s,0\na,CTR,s,1\na,AMY1R,s,0\n")
    assert rows(evidence.read_pose(spark, path)) == {("a", "CTR", 1), ("a", "AMY1R", 0)}
    assert evidence.read_coverage_summary(spark, str(tmp_path / "absent.csv")).isEmpty()
    assert evidence.read_binder_summary(spark, str(tmp_path / "absent.csv")).isEmpty()
    path = put(tmp_path / "c.csv", "id,n_peptides_scored,min_combined_score,n_below_43,status,cd4_pass\na,3,40.1,2,tested,0\na,3,44.1,0,tested,1\nb,0,,0,incomplete,\n")
    assert evidence.read_coverage_summary(spark, path).count() == 2
    assert {(r["id"], r["cd4_pass"]) for r in evidence.read_coverage_summary(spark, path).collect()} == {("a", 1), ("b", None)}
    path = put(tmp_path / "s.csv", "Peptide,Combined Score,HLA-DRB1:03:01\nPEP,48.5,1\nPEP,40.0,2\n")
    assert rows(evidence.read_peptide_scores(spark, path)) == {("PEP", 48.5), ("PEP", 40.0)}
    path = put(tmp_path / "m.csv", "old_id,new_id\na,a1\n")
    assert rows(evidence.read_id_map(spark, path)) == {("a", "a1")}


def test_tracks(spark, tmp_path):
    put(tmp_path / "GX_1.txt", "res\taa\tBeta\tTurn\tHelix\tAggregation\tConc\n01\t  K\t  0.8\t0.0\t0.0\t 5.5\t1.0\n02\t C\t1\t2\t3\t6.5\n03\tA\t1\n")
    put(tmp_path / "GX_2.v2.txt", "res\taa\tBeta\tTurn\tHelix\tAggregation\n01 U 0 0 0 0.25\n")
    got = rows(tracks.read_tracks(spark, str(tmp_path / "*.txt")))
    assert got == {("GX_1", 1, "K", 5.5), ("GX_1", 2, "C", 6.5), ("GX_2.v2", 1, "U", 0.25)}


def atom(chain, res, x, name="CA", kind="ATOM"):
    return f"{kind} 1 C {name} . GLY {chain} 1 {res} ? {x} 0.0 0.0 1.0 50.0"


def test_structures(spark, tmp_path):
    put(tmp_path / "pep_1" / "CTR" / "pep_1_CTR_model.cif", "\n".join([
        "data_x", atom("A", 1, 1.0), atom("A", 1, 2.0), atom("A", 2, "bad"), atom("A", "x", 1.0), atom("A", 3, 9.0, name="CB"),
        atom("A", 4, 9.0, kind="HETATM"), "ATOM 1 C CA . GLY A 1 5", atom("L", 1, 7.5)]))
    put(tmp_path / "pep_0" / "CGRP" / "pep_0_CGRP_model.cif", atom("B", 1, 3.0))
    put(tmp_path / "pep_0" / "CGRP" / "other_model.cif", atom("B", 9, 3.0))
    put(tmp_path / "pep_0" / "CGRP" / "seed-1_sample-0" / "model.cif", atom("B", 8, 3.0))
    put(tmp_path / "pep_2" / "CTR" / "notes.txt", "no model")
    got = rows(structures.read_ca_atoms(spark, str(tmp_path)))
    assert got == {("pep_1", "CTR", "A", 1, 2.0, 0.0, 0.0), ("pep_1", "CTR", "L", 1, 7.5, 0.0, 0.0),
                   ("pep_0", "CGRP", "B", 1, 3.0, 0.0, 0.0)}
    assert [r[0] for r in structures.folder_ids(spark, str(tmp_path)).collect()] == ["pep_0", "pep_1"]
    assert rows(structures.done_jobs(spark, str(tmp_path))) == {("pep_0", "CGRP"), ("pep_1", "CTR")}


A3M = ">query\nKCNT\n>hit one > with mark\nK-NTa\n\n>hit two\n--NT\n"


def test_alignments(spark, tmp_path):
    full = C.PEPTIDE_PREFIX + "AC"
    put(tmp_path / "p1.a3m", A3M.replace("KCNT\n", full + "\n"))
    put(tmp_path / "p2.a3m", ">query\nOTHER\n")
    got = alignments.read_alignments(spark, str(tmp_path / "*.a3m"))
    p1 = [tuple(r) for r in got.where("id = 'p1'").orderBy("at").select("is_query", "header", "row").collect()]
    assert p1 == [(True, "query", full), (False, "hit one > with mark", "K-NTa"), (False, "hit two", "--NT")]
    peptides = spark.createDataFrame([("p1", full), ("p2", full)], "id string, full string")
    assert rows(jobs.query_mismatch(got, peptides, "id", "full")) == {("p2",)}
    text = jobs.alignment_text(jobs.add_cap_column(got), "id").where("id = 'p1'")
    msa = text.first()["msa"]
    assert msa == f">query\n{full}X\n>hit one > with mark\nK-NTa-\n>hit two\n--NT-\n"
    assert text.select(jobs.alignment_depth("msa")).first()[0] == 4


def test_alignments_with_odd_beginnings(spark, tmp_path):
    put(tmp_path / "q1.a3m", "\n>query\r\nAC\r\n>>odd\r\nA-\r\n")
    put(tmp_path / "q2.a3m", "")
    got = alignments.read_alignments(spark, str(tmp_path / "*.a3m"))
    assert [tuple(r) for r in got.orderBy("at").select("id", "is_query", "header", "row").collect()] == [
        ("q1", True, "query", "AC"), ("q1", False, ">odd", "A-")]
    peptides = spark.createDataFrame([("q1", "ZZ"), ("q3", "AC")], "id string, full string")
    assert rows(jobs.query_mismatch(got, peptides, "id", "full")) == {("q1",)}
    headless = got.withColumn("is_query", F.lit(False))
    assert rows(jobs.query_mismatch(headless, peptides.withColumn("full", F.lit("AC")), "id", "full")) == {("q1",)}


@pytest.mark.parametrize("entity", [{"id": "A", "sequence": "MM", "modifications": []}, {"id": ["A", "B"], "sequence": "é\"\n"}])
@pytest.mark.parametrize("more", [{}, {"modelSeeds": [1, 2], "x": {"y": [None, 1.50, "z"]}, "bonds": None}])
def test_job_documents_keep_every_field(spark, tmp_path, entity, more):
    body = {"name": "t", "sequences": [{"protein": entity}, {"ligand": {"id": "Z", "ccdCodes": ["X"]}}], **more}
    put(tmp_path / "CTR" / "X_ag" / "X_data.json", json.dumps(body, indent=1))
    templates = documents.read_templates(spark, str(tmp_path / "*" / "*_ag" / "*_data.json"))
    assert templates.count() == 1 and jobs.templates_with_chain(templates, "receptor").isEmpty()
    assert jobs.templates_with_chain(templates, "receptor", "A").count() == 1
    todo = spark.createDataFrame([("CTR", 'j"1', "ACX", ">q\nACX\n")], "receptor string, job string, s string, m string")
    doc = json.loads(jobs.job_documents(todo, templates, "receptor", "s", "m", seed=5).first()["document"])
    want = {**body, "name": 'j"1', "modelSeeds": [5]}
    want["sequences"] = [*body["sequences"], {"protein": {
        "id": "L", "sequence": "ACX", "modifications": [{"ptmType": "NH2", "ptmPosition": 3}], "unpairedMsa": ">q\nACX\n",
        "pairedMsa": "", "templates": []}}]
    assert doc == want
    kept = json.loads(jobs.job_documents(todo, templates, "receptor", "s", "m").first()["document"])
    assert kept.get("modelSeeds") == body.get("modelSeeds")


def test_templates_and_job_documents(spark, tmp_path):
    body = {"dialect": "d", "version": 1, "name": "t", "modelSeeds": [1],
            "sequences": [{"protein": {"id": "A", "sequence": "MM", "modifications": [{"ptmType": "P", "ptmPosition": 1}],
                                       "unpairedMsa": "", "pairedMsa": "", "templates": ["t1"]}}]}
    for receptor, chain in (("CTR", "A"), ("AMY1R", "L")):
        body["sequences"][0]["protein"]["id"] = chain
        put(tmp_path / receptor / "X_ag" / "X_data.json", json.dumps(body, indent=1))
    templates = documents.read_templates(spark, str(tmp_path / "*" / "*_ag" / "*_data.json"))
    wanted = spark.createDataFrame([("CTR",), ("CGRP",)], "receptor string")
    assert rows(documents.repeated_templates(templates, wanted)) == {("CGRP", 0)}
    assert rows(jobs.templates_with_chain(templates, "receptor")) == {("AMY1R",)}

    ids = spark.createDataFrame([("pep_1", "AAC")], "id string, seq string")
    finished = spark.createDataFrame([("pep_1", "CGRP"), ("pep_1", "XX"), ("q", "CTR")], "id string, receptor string")
    todo = jobs.job_matrix(ids, "id", ["CTR", "CGRP"], "receptor", finished)
    assert rows(todo) == {("pep_1", "AAC", "CTR", "pep_1_CTR")}
    assert jobs.job_matrix(ids, "id", ["CGRP"], "receptor", finished).isEmpty()
    assert jobs.job_matrix(ids, "id", ["CTR", "CGRP"], "receptor").count() == 2
    full = todo.select("receptor", "job", jobs.folding_sequence("seq").alias("sequence"),
                                       jobs.query_only_alignment("seq").alias("msa"))
    made = jobs.job_documents(full, templates, "receptor", "sequence", "msa", seed=9)
    writers.write_job_documents(made, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
    writers.write_job_documents(made, str(tmp_path / "jobs"), files=True)
    doc = json.loads("\n".join(lines_of(tmp_path / "jobs" / "job=pep_1_CTR")))
    sequence = C.PEPTIDE_PREFIX + "AACX"
    assert (doc["name"], doc["modelSeeds"], doc["dialect"], doc["version"]) == ("pep_1_CTR", [9], "d", 1)
    assert doc["sequences"][0]["protein"]["templates"] == ["t1"]
    assert doc["sequences"][1]["protein"] == {
        "id": "L", "sequence": sequence, "modifications": [{"ptmType": "NH2", "ptmPosition": len(sequence)}],
        "unpairedMsa": f">query\n{sequence}\n", "pairedMsa": "", "templates": []}


def test_result_tables(spark):
    body = json.dumps({"table_columns": [{"name": "n"}, {"name": "pct"}], "table_data": [[1, "0.5"], [2, None]]})
    df = spark.createDataFrame([(body,)], "body string")
    got = documents.result_rows(df, [], "body", ["pct", "n", "other"])
    assert rows(got) == {("0.5", "1", None), (None, "2", None)}
    with pytest.raises(ValueError, match="unknown number: 2"):
        documents.by_position(got.select("n"), spark.createDataFrame([("a", 1)], "id string, pos long"), "n", "pos")
    named = documents.by_position(got.select("n", "pct"), spark.createDataFrame([("a", 1), ("b", 2)], "id string, pos long"), "n", "pos")
    assert rows(named) == {("1", "0.5", "a"), ("2", None, "b")}


def test_writers(spark, tmp_path):
    report = spark.createDataFrame([("b", True, None), ("a", False, 2.5)], "id string, ok boolean, score double")
    for _ in range(2):
        writers.write_report(report, str(tmp_path / "csv"), "csv")
    assert sorted(set(lines_of(tmp_path / "csv"))) == ["a,0,2.5", "b,1,", "id,ok,score"]
    writers.write_report(report, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).columns == report.columns

    staged = report.withColumn("status", F.when(F.col("ok"), "PASS").otherwise("FAIL"))
    writers.write_stage_results(staged, str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 2
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "stage" / "status=PASS")).collect()] == ["b"]

    writers.write_ids(spark.createDataFrame([("b",), ("c",), ("a",)], "id string"), str(tmp_path / "ids"))
    assert lines_of(tmp_path / "ids") == ["a", "b", "c"]
    assert rows(evidence.read_ids(spark, str(tmp_path / "ids"))) == {("a",), ("b",), ("c",)}

    audit = spark.createDataFrame([("a", "one"), ("b", "one")], "id string, eliminated_at_stage string")
    writers.append_audit(audit, str(tmp_path / "audit"))
    later = audit.where("id = 'a'").withColumn("eliminated_at_stage", F.lit("two"))
    writers.append_audit(later, str(tmp_path / "audit"))
    assert rows(writers.read_audit(spark, str(tmp_path / "audit"))) == {("a", "two"), ("b", "one")}


@pytest.mark.parametrize("n, sizes", [(50, [50]), (51, [50, 1]), (3, [3])])
def test_fasta(spark, tmp_path, n, sizes):
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("pos_in"), F.format_string("p_%03d", "id").alias("id"),
                               F.when(F.col("id") > 0, F.lit("ACD")).alias("seq"))
    writers.write_fasta(writers.fasta_batches(df, "id", "seq", ["pos_in"]), str(tmp_path / "fa"), files=True)
    writers.write_fasta(writers.fasta_batches(df, "id", "seq", ["pos_in"]), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == len(sizes)
    want = [(f"p_{i:03d}", "ACD" if i else "") for i in reversed(range(n))]
    for batch, size in enumerate(sizes, 1):
        files = list((tmp_path / "fa" / f"batch={batch}").glob("part-*"))
        assert len(files) == 1
        part, want = want[:size], want[size:]
        assert files[0].read_text() == "".join(f">{i}\n{s}\n" for i, s in part)
    assert not want


def test_subsets(spark):
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    wanted = subsets.ids_from_list(spark, "c, x ,a,,a")
    extra = subsets.ids_from_list(spark, "amylin,a")
    assert rows(subsets.resolve_ids(universe, wanted, extra)) == {("a",), ("c",), ("amylin",)}
    assert rows(subsets.resolve_ids(None, wanted)) == {("a",), ("c",), ("x",)}
    assert rows(subsets.resolve_ids(universe)) == {("a",), ("b",), ("c",)}
    assert subsets.resolve_ids(None).isEmpty() and rows(subsets.resolve_ids(None, None, extra)) == {("amylin",), ("a",)}
    numbered = spark.createDataFrame([("b", 1), ("c", 2), ("a", 3), ("c", 4)], "id string, pos long")
    picked = spark.createDataFrame([("a", 1), ("b", 2)], "id string, pos long")
    more = spark.createDataFrame([("amylin", 1), ("a", 2)], "id string, pos long")
    ordered = [r["id"] for r in subsets.ordered_ids(numbered, picked, more).orderBy("part", "pos").collect()]
    assert ordered == ["b", "a", "amylin"]
    assert [r["id"] for r in subsets.ordered_ids(None, numbered).orderBy("part", "pos").collect()] == ["b", "c", "a"]
    assert subsets.ordered_ids(None).isEmpty()
    report = spark.createDataFrame([("a", True), ("b", False)], "id string, final_pass boolean")
    assert rows(subsets.pick_targets(report, F.col("final_pass"))) == {("a", True)}
    assert rows(subsets.pick_targets(report, F.col("final_pass"), subsets.ids_from_list(spark, "b,z"))) == {("b", False)}
    mapping = spark.createDataFrame([("a", "n"), ("a", "m")], "old_id string, new_id string")
    assert rows(subsets.remap_ids(report, mapping, "id", "old_id", "new_id")) == {("n", True), ("b", False)}


def test_integrity(spark):
    good = C.PEPTIDE_PREFIX + "AA"
    table = spark.createDataFrame([("a", "AA", good), ("b", "AC", good), ("c", None, good)], "id string, seq string, full string")
    assert rows(jobs.sequence_mismatch(table, "id", "seq", "full")) == {("b",), ("c",)}
    asked = spark.createDataFrame([("a",), ("q",)], "id string")
    missing = subsets.missing_ids(asked, table, "id")
    assert rows(missing) == {("q",)}
    subsets.require_none(missing.limit(0), "ids")
    with pytest.raises(ValueError, match="unknown ids: q"):
        subsets.require_none(missing, "unknown ids")
    broken = subsets.violations(table, "id", {"has seq": F.col("seq").isNotNull(), "seq AA": F.col("seq") == "AA"})
    assert rows(broken) == {("b", "seq AA"), ("c", "has seq"), ("c", "seq AA")}


def test_pending_batch_comes_in_and_resolves(spark, tmp_path):
    roster = spark.createDataFrame([("a", "AC"), ("b", "AD"), ("c", "AE")], "id string, seq string")
    put(tmp_path / "al_1.csv", "Protein,Result\na,no evidence\n")

    def run():
        table = evidence.read_allergenicity(spark, str(tmp_path / "al_*.csv"))
        return funnel.run_funnel(roster, [Gate("04", F.col("passed"), table, on_missing="pending")])

    waiting = run().where("outcome = 'pending'")
    assert rows(waiting.select("id")) == {("b",), ("c",)}
    put(tmp_path / "al_2.csv", "Protein,Result\nb,no evidence\nc,weak evidence\n")
    assert rows(run().select("id", "outcome")) == {("a", "retained"), ("b", "retained"), ("c", "eliminated")}


def _scans(plan):
    """The file scans of a plan that has run."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _scans(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _scans(plan.plan())
    own = [plan] if plan.getClass().getSimpleName() == "FileSourceScanExec" else []
    children = plan.children()
    return own + [s for i in range(children.size()) for s in _scans(children.apply(i))]


def test_only_survivors_files_are_read(spark, tmp_path):
    line = "ATOM  1  C  CA  .  ALA  A  1  {}  ?  1.0  2.0  3.0\n"
    for layout in ("id={}/receptor={}", "{}/{}"):
        for i in ("007", "b", "c", "d"):
            for receptor in ("CTR", "CGRP"):
                folder = tmp_path / ("keyed" if "=" in layout else "plain") / layout.format(i, receptor)
                folder.mkdir(parents=True)
                (folder / f"{i}_{receptor}_model.cif").write_text(line.format(1) + line.format(2))
    alive = spark.createDataFrame([("007",), ("c",), ("gone",)], "id string")
    for read, path in ((structures.read_keyed_ca_atoms, "keyed"), (structures.read_ca_atoms, "plain")):
        every = read(spark, str(tmp_path / path))
        assert every.count() == 16
        left = read(spark, str(tmp_path / path), alive)
        assert rows(left) == rows(every.where("id IN ('007', 'c')"))
        pair = read(spark, str(tmp_path / path), spark.createDataFrame([("c", "CTR")], "id string, receptor string"))
        assert rows(pair) == rows(every.where("id = 'c' AND receptor = 'CTR'"))
        for frame, files in ((left, 4), (pair, 1)):
            frame.collect()
            scans = _scans(frame._jdf.queryExecution().executedPlan())
            texts = [s for s in scans if "text" in s.toString()]
            assert [s.metrics().apply("numFiles").value() for s in texts] == [files]
            assert path == "plain" or "dynamicpruning" in frame._jdf.queryExecution().executedPlan().toString()
        assert read(spark, str(tmp_path / path), spark.createDataFrame([], "id string")).isEmpty()


def test_done_jobs_are_noted_as_they_come(spark, tmp_path):
    def arrive(i, receptor, name=None):
        folder = tmp_path / "models" / i / receptor
        folder.mkdir(parents=True, exist_ok=True)
        (folder / (name or f"{i}_{receptor}_model.cif")).write_text("#\n")

    noted, checkpoint = str(tmp_path / "noted"), str(tmp_path / "check")
    assert structures.noted_jobs(spark, noted).isEmpty()
    arrive("a", "CTR")
    arrive("a", "CGRP", "a_CGRP_seed_model.cif")    # of a folder, but not its structure
    structures.note_done(spark, str(tmp_path / "models"), noted, checkpoint)
    assert rows(structures.noted_jobs(spark, noted)) == {("a", "CTR")}
    arrive("b", "CTR")
    arrive("a", "CGRP")
    for _ in range(2):
        structures.note_done(spark, str(tmp_path / "models"), noted, checkpoint)
        assert rows(structures.noted_jobs(spark, noted)) == {("a", "CTR"), ("b", "CTR"), ("a", "CGRP")}
    assert rows(spark.read.parquet(f"{noted}/batch=1")) == {("b", "CTR"), ("a", "CGRP")}
    assert not (tmp_path / "noted" / "batch=2").exists()


def test_packed_models_read_as_their_files(spark, tmp_path):
    ids = [f"p{n}" for n in range(40)]
    for n, i in enumerate(ids):
        put(tmp_path / "models" / i / "CTR" / f"{i}_CTR_model.cif", "\n".join([
            "data_x", atom("A", 1, 1.0), atom("A", 1, n), atom("A", 2, "bad"), atom("A", 3, 9.0, name="CB"), atom("L", 1, 7.5)]))
    every, packed = structures.model_texts(spark, str(tmp_path / "models")), str(tmp_path / "packed")
    structures.pack_models(every, packed)
    structures.pack_models(every.where("id = 'p3'"), packed)       # a model that is there already changes nothing
    want = structures.read_ca_atoms(spark, str(tmp_path / "models"))
    assert want.count() == 80 and rows(structures.read_packed_ca_atoms(spark, packed)) == rows(want)
    alive = spark.createDataFrame([("p7", "CTR"), ("p8", "CGRP"), ("gone", "CTR")], "id string, receptor string")
    left = structures.read_packed_ca_atoms(spark, packed, alive)
    assert rows(left) == rows(want.where("id = 'p7'"))
    scans = [s for s in _scans(left._jdf.queryExecution().executedPlan()) if "packed" in s.toString()]
    assert [s.metrics().apply("numFiles").value() for s in scans] == [len(
        {r[0] for r in spark.read.parquet(packed).where("bucket IN (SELECT DISTINCT pmod(xxhash64(id), 64) FROM {a})".format(
            a="VALUES ('p7'), ('p8'), ('gone') AS t(id)")).select("_metadata.file_path").collect()})]


def test_the_number_of_structure_files_does_not_follow_the_structures(spark, tmp_path):
    texts = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("CTR").alias("receptor"), F.lit("m").alias("path"),
                                     F.lit(atom("A", 1, 1.0)).alias("value"))
    structures.pack_models(texts, str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").rglob("*.parquet"))) <= structures.BUCKETS
    assert structures.read_packed_ca_atoms(spark, str(tmp_path / "packed")).count() == 2000


def test_packed_structures_are_noted_as_they_come(spark, tmp_path):
    packed, noted, checkpoint = (str(tmp_path / n) for n in ("packed", "noted", "check"))

    def arrive(*pairs):
        structures.pack_models(spark.createDataFrame([(*p, "m", "#") for p in pairs], "id string, receptor string, path string, value string"), packed)
        structures.note_packed(spark, packed, noted, checkpoint)

    arrive(("a", "CTR"), ("a b", "CGRP"))
    assert rows(structures.noted_jobs(spark, noted)) == {("a", "CTR"), ("a b", "CGRP")}
    arrive(("a", "CGRP"))
    structures.note_packed(spark, packed, noted, checkpoint)
    assert rows(spark.read.parquet(f"{noted}/batch=1")) == {("a", "CGRP")}
    assert rows(structures.noted_jobs(spark, noted)) == {("a", "CTR"), ("a b", "CGRP"), ("a", "CGRP")}
    assert not (tmp_path / "noted" / "batch=2").exists()


def test_order_lines_are_dealt_out_once_for_their_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(o, o % 9, o % 4, 1 + o % 7, 1.0, 0.02, 0.03, "ARN"[o % 3]) for o in range(300)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, "
                          "l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    taken = []

    def pack(models, table, **how):
        taken.append(models._jdf.queryExecution().executedPlan().toString())
        structures.pack_models(models, table, **how)

    monkeypatch.setattr(table_queries, "pack_models", pack)
    path = table_queries._structure_files(spark, str(tmp_path))
    assert taken[0].count("Exchange rangepartitioning") == 1 and taken[0].count("Exchange") == 1
    texts = spark.read.parquet(path).collect()
    assert {(r.id, r.receptor): r.value.count("HETATM") for r in texts} == {(str(i), f): 25 for i in range(4) for f in "ARN"}
    assert {r.bucket for r in texts} == {r[0] for r in spark.createDataFrame([(str(i),) for i in range(4)], "id string").select(
        structures.bucket_of("id")).collect()}


def test_the_pose_check_parses_each_structure_once(spark, tmp_path):
    put(tmp_path / "p" / "CTR" / "p_CTR_model.cif", "\n".join([atom("L", 1, 1.0), *[atom("A", n, n) for n in range(1, 9)]]))
    boundaries = spark.createDataFrame([(8, 3, 4, 2, 7)], "chain_length long, ecd_end int, tm1_start int, deep_start int, tmd_end int")
    checked = pose.pose_check(structures.read_ca_atoms(spark, str(tmp_path)), 1.5, boundaries)
    assert [tuple(r) for r in checked.select("id", "receptor", "d_nterm_tmd", "d_cterm_deep").collect()] == [("p", "CTR", 3.0, 999.0)]
    assert "Scan text" not in checked._jdf.queryExecution().executedPlan().toString()


def test_a_cache_of_alignments_is_a_few_files(spark, tmp_path):
    cache = str(tmp_path / "cache")
    assert alignments.read_cached(spark, cache).isEmpty()
    texts = spark.range(1, 500).select(F.concat(F.lit("n"), "id").alias("id"), F.lit(A3M).alias("msa"))
    odd = spark.createDataFrame([("q1", "\n>query\r\nAC\r\n>>odd\r\nA-\r\n"), ("q2", ""), ("a/b", ">q\nAC")], "id string, msa string")
    writers.write_alignments(texts.unionByName(odd), cache)
    assert len(list((tmp_path / "cache").rglob("*.parquet"))) < 20

    def cached(i):
        got = alignments.read_cached(spark, cache).where(F.col("id") == i).orderBy("at")
        return [tuple(r) for r in got.select("is_query", "header", "row").collect()]

    assert cached("n7") == [(True, "query", "KCNT"), (False, "hit one > with mark", "K-NTa"), (False, "hit two", "--NT")]
    assert cached("q1") == [(True, "query", "AC"), (False, ">odd", "A-")]
    assert cached("q2") == [] and cached("a/b") == [(True, "q", "AC")]
    results = spark.createDataFrame([(i, json.dumps({"sequences": [{"protein": {"unpairedMsa": ">new\nGG\n"}}]})) for i in ("n7", "q2", "z")],
                                    "id string, document string")
    runs.fill_cache(spark, results, cache)                  # what has an alignment is left as it is
    assert [cached(i)[0][1] for i in ("n7", "q2", "z")] == ["query", "new", "new"]
    writers.write_alignments(texts.limit(1).withColumn("msa", F.lit(">again\nA\n")), cache)
    assert cached("n1") == [(True, "again", "A")]           # replaced
