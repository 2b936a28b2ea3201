import pytest
from pyspark.sql import functions as F

from conftest import rows
from sievespan.functions import text as tx
from sievespan.functions.windows import sliding_windows


def one(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column).first()[0]


@pytest.mark.parametrize("value", [2.675, 0.125, 0.375, 1.005, 178.453, 0.0, 1234567.891, -3.14159, 5.25, 31.35])
@pytest.mark.parametrize("places", [1, 2, 3, 4])
def test_decimals_as_the_report_writes_them(spark, value, places):
    assert one(spark, tx.fixed_decimals("v", places), v=value) == f"{value:.{places}f}"


def test_lists_and_words(spark):
    assert one(spark, tx.listed_ids("v"), v=" a, b,,\tc ,") == ["a", "b", "c"]
    assert one(spark, tx.tokens("v"), v="  01\t K  0.8 ") == ["01", "K", "0.8"]
    assert one(spark, tx.tokens("v"), v="   ") == [""]


@pytest.mark.parametrize("line, want", [
    ("AGG 1.5 AMYLO 2", {"AGG": 1.5, "AMYLO": 2.0}),
    ("AGG 1.5 AMYLO", {"AGG": 1.5}),
    ("AGG 1.5 AMYLO x", {}),
    ("AGG 1 B 2 AGG 3", {"AGG": 3.0, "B": 2.0}),
    ("AGG", {}), ("", {}),
])
def test_pairs(spark, line, want):
    assert one(spark, tx.token_pairs("v"), v=line) == want


def test_job_names_are_split_at_the_last_underscore(spark):
    df = spark.createDataFrame([("pep_1_x", "CTR")], "id string, receptor string")
    job = df.select(tx.job_name("id", "receptor").alias("job"))
    assert rows(job.select("job", tx.job_id("job"), tx.job_key("job"))) == {("pep_1_x_CTR", "pep_1_x", "CTR")}


@pytest.mark.parametrize("n", [0, 1, 14, 15, 16, 36, 37, 4095, 4096, 4110, 4111, 9000])
def test_windows(spark, n):
    text = "".join(chr(0x41 + (i * 7) % 26) if i % 5 else "é" for i in range(n))
    df = spark.createDataFrame([("a", text)], "id string, seq string")
    got = sorted((r["pos"], r["window"]) for r in sliding_windows(df, "id", "seq", 15).collect())
    assert got == [(i + 1, text[i:i + 15]) for i in range(n - 14)]


def test_windows_count_characters_beyond_the_basic_plane(spark):
    text = "a😀b\nc😀"
    df = spark.createDataFrame([("a", text)], "id string, seq string")
    got = sorted((r["pos"], r["window"]) for r in sliding_windows(df, "id", "seq", 2).collect())
    assert got == [(i + 1, text[i:i + 2]) for i in range(len(text) - 1)]
