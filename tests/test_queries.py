import os
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from sievespan import session  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")
def test_queries_match_sql(spark):
    assert {n: d for n, d in compare(spark, FOLDER).items() if d} == {}


def test_the_entry_works_without_a_library_of_the_operators():
    code = ("import sys; sys.modules['tiktoken'] = None\n"
            "import __spark_entry__ as e\n"
            "assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())\n"
            "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_every_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables here")
def test_entry(spark):
    df = entry(spark)
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_tables_are_dropped(spark):
    from pathlib import Path
    root = Path(session.shared_folder(spark)) / "sievespan"
    before = set(root.glob("*")) if root.exists() else set()
    with session.scratch(spark):
        kept = queries()["run_segments"](spark, FOLDER).count()
    assert kept >= 0 and set(root.glob("*")) == before
