"""What Python workers need: this package, and batches of bounded size."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_ROWS = 500    # texts handed to a Python worker at once

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Hand the package to all executors with addPyFile, once per application,
    and keep Arrow batches small: a batch holds whole texts.

    Not needed where the package is installed on the executors.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    # a file of the driver's; executors fetch it from the driver
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
