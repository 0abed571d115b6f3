"""Getting the package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a session, unless they find it by PYTHONPATH or the working folder."""
    context = spark.sparkContext
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if context.applicationId in _shipped or any(p and Path(p).resolve() == ROOT for p in found):
        return
    name = Path(tempfile.mkdtemp(prefix="rankspark-")) / "rankspark.zip"
    with zipfile.ZipFile(name, "w") as archive:
        for p in sorted((ROOT / "rankspark").rglob("*.py")):
            archive.write(p, p.relative_to(ROOT))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)
