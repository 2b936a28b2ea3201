import random

from pyspark.sql import functions as F, types as T

from conftest import rows
from sievespan.operators.gates import Gate
from sievespan.plans import funnel
from sievespan.streaming import decisions, intake

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("seen", T.LongType()),
                       T.StructField("passed", T.BooleanType())])
ORDER = ["a", "b", "c"]
RULES = {"a": "pending", "b": "fail", "c": "pass"}


def arrive(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").json(folder)


def test_state_holds_the_last_row_and_logs_changes_only(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "check"))
    assert intake.latest_state(spark, checkpoint, SCHEMA, ["id"], ["seen"]).isEmpty()

    def run():
        intake.keep_latest(intake.evidence_stream(spark, source, SCHEMA, "json", files_per_batch=1), log, checkpoint, ["id"], ["seen"])
        return rows(intake.latest_state(spark, checkpoint, SCHEMA, ["id"], ["seen"]))

    def logged(batch):
        return rows(spark.read.parquet(f"{log}/batch={batch}"))

    arrive(spark, source, [("a", 1, False), ("b", 5, True), ("a", 2, True), (None, 1, None)])
    assert run() == {("a", 2, True), ("b", 5, True), (None, 1, None)} == logged(0)
    arrive(spark, source, [("b", 4, False), ("c", 9, False)])       # late, and new
    want = {("a", 2, True), ("b", 5, True), ("c", 9, False), (None, 1, None)}
    assert run() == want and logged(1) == {("c", 9, False)}
    arrive(spark, source, [("a", 2, True), ("b", 5, True), ("c", 9, False)])    # repeated
    assert run() == want and logged(2) == set()
    assert run() == want                                            # nothing new
    arrive(spark, source, [("c", 9, True)])                         # a tie is settled by the other columns
    assert run() == want - {("c", 9, False)} | {("c", 9, True)} and logged(3) == {("c", 9, True)}


def full(spark, roster, evidence):
    """Decisions from whole tables."""
    tables = {s: spark.createDataFrame([(i, seen, ok) for (i, seen), ok in own.items()], SCHEMA)
              for s, own in evidence.items()}
    gates = [Gate(s, F.col("passed"), tables[s], RULES[s], ("seen",)) for s in ORDER]
    frame = funnel.run_funnel(spark.createDataFrame([(i,) for i in sorted(roster)], "id string"), gates, ORDER)
    return frame


def test_decisions_equal_those_of_a_full_run(spark, tmp_path):
    """Random batches of new ids and of new, late and contradicting evidence of three stages."""
    draw = random.Random(5)
    logs = {s: str(tmp_path / s) for s in (*ORDER, "roster")}
    out, counts, checkpoint = (str(tmp_path / n) for n in ("out", "counts", "check"))
    roster, evidence, seen = set(), {s: {} for s in ORDER}, 0
    batch_schema = T.StructType([*SCHEMA.fields, T.StructField("batch", T.LongType())])
    assert decisions.last_counts(spark, counts, checkpoint).isEmpty()
    for number in range(3):
        touched = set()
        for s in ORDER:
            own = {}
            for _ in range(4):
                seen += 1
                own[f"n{draw.randrange(12)}"] = (seen, draw.random() < 0.6)
            evidence[s] |= {(i, at): ok for i, (at, ok) in own.items()}
            touched |= set(own)
            spark.createDataFrame([(i, at, ok) for i, (at, ok) in own.items()], SCHEMA).write.parquet(f"{logs[s]}/batch={number}")
        new = {f"n{draw.randrange(12)}" for _ in range(4)}
        roster |= new
        spark.createDataFrame([(i, 0, True) for i in new], SCHEMA).write.parquet(f"{logs['roster']}/batch={number}")

        streams = {s: intake.evidence_stream(spark, logs[s], batch_schema, "parquet") for s in logs}
        changes = decisions.verdicts(streams["roster"], [], ORDER, roster=True)
        for s in ORDER:
            changes = changes.unionByName(decisions.verdicts(streams[s], [Gate(s, F.col("passed"))], ORDER))
        decisions.follow(changes, ORDER, RULES, out, counts, checkpoint)

        want = full(spark, roster, evidence)
        flags = [c for s in ORDER for c in (f"{s}_pass",)]
        got = decisions.current_decisions(spark, checkpoint, ORDER, RULES)
        assert rows(got.select("id", "outcome", "at_stage", *flags)) == rows(want.select("id", "outcome", "at_stage", *flags))
        assert sorted(decisions.stage_counts(decisions.last_counts(spark, counts, checkpoint), ORDER).collect()) == \
            sorted(funnel.funnel_counts(want, ORDER).collect())
        logged = {r.id for r in spark.read.parquet(f"{out}/batch={number}").collect()}
        assert logged <= touched | new      # others are not looked at


def test_state_rows_are_buckets_of_ids(spark, tmp_path, monkeypatch):
    """A call of Python per bucket, not per id; whole numbers keep their digits beside a null."""
    monkeypatch.setattr(decisions, "BUCKETS", 16)
    log, out, counts, checkpoint = (str(tmp_path / n) for n in ("log", "out", "counts", "check"))
    big = 2 ** 60 + 1
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "size", "batch")])

    def arrive(number, ids):
        ids.write.parquet(f"{log}/batch={number}")
        rows_of = intake.evidence_stream(spark, log, schema, "parquet")
        decisions.follow(decisions.verdicts(rows_of, [Gate("a", F.col("size") < 10)], ["a"], roster=True), ["a"], {}, out, counts, checkpoint)
        return decisions.current_decisions(spark, checkpoint, ["a"], {})

    first = spark.range(500).select("id", F.col("id").alias("size")).unionByName(spark.createDataFrame([(big, 1), (None, 1)], "id long, size long"))
    got = arrive(0, first)
    assert got.schema["id"].dataType == T.LongType()
    assert spark.read.format("statestore").load(checkpoint).count() == 16
    want = {(i, i < 10) for i in range(500)} | {(big, True), (None, True)}
    assert rows(got.select("id", "a_pass")) == want
    got = arrive(1, spark.createDataFrame([(7, 99), (big, 99), (499, 500)], "id long, size long"))
    assert rows(got.select("id", "a_pass")) == want - {(7, True), (big, True)} | {(7, False), (big, False)}
    assert {r.id for r in spark.read.parquet(f"{out}/batch=1").collect()} == {7, big}    # 499 is decided as before
