"""The package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers of this application, once, unless they run on this machine and find it by themselves.

    The archive is served by the driver; workers import from it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.master.startswith("local") and any(p and Path(p).resolve() == ROOT for p in paths):
        return
    archive = Path(tempfile.mkdtemp(prefix="teleloom-")) / "teleloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "teleloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(archive))
