"""What a session needs before it runs the library: its code on the workers, and small Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Bytes of a batch between Spark and a Python worker; by rows alone, a batch of long texts could fill the memory of both.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Send the package to all workers, once an application; Spark serves the file to every executor."""
    sc, given = spark.sparkContext, spark.conf.getAll
    for key, value in BATCH.items():
        if key not in given:
            spark.conf.set(key, value)
    if sc.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lectern-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file from here as long as the driver lives
    archive = Path(folder) / "lectern_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _sent.add(sc.applicationId)
