from pyspark.sql import types as T

from conftest import rows
from sievespan.streaming import intake

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("seen", T.LongType()),
                       T.StructField("passed", T.BooleanType())])


def arrive(spark, folder, name, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def test_evidence_arrives_in_pieces(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "check"))

    def run():
        stream = intake.evidence_stream(spark, source, SCHEMA, "json", files_per_batch=1, recursiveFileLookup=True)
        intake.take_in(stream, log, checkpoint, ["id"], ["seen"])
        return rows(intake.current_evidence(spark, log, SCHEMA, ["id"], ["seen"]))

    arrive(spark, source, "one", [("a", 1, False), ("b", 5, True), ("a", 2, True)])
    arrive(spark, source, "two", [("c", 1, True)])
    assert intake.current_evidence(spark, log, SCHEMA, ["id"], ["seen"]).isEmpty()    # before a first batch
    assert run() == {("a", 2, True), ("b", 5, True), ("c", 1, True)}
    # a late row does not replace a newer one; a newer one does
    arrive(spark, source, "three", [("b", 4, False), ("c", 9, False)])
    want = {("a", 2, True), ("b", 5, True), ("c", 9, False)}
    assert run() == want
    assert run() == want                              # nothing new, nothing twice

    target = str(tmp_path / "compacted")
    intake.compact(spark, log, target, SCHEMA, ["id"], ["seen"])
    assert rows(intake.current_evidence(spark, target, SCHEMA, ["id"], ["seen"])) == want
    assert spark.read.parquet(target).count() == 3
