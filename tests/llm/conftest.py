import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from sievespan.llm.workers import prepare  # noqa: E402

from .odd import ODD  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"



@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, long and repeated texts, repeated and null ids, and columns with names that operators use."""
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "src", 1) for i, t in enumerate(ODD)]
    rows += [(2, " ", "en", "src", None), (None, "a", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS row", "2 AS words", "3 AS quality", "4 AS _n")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
