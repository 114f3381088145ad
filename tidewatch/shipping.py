"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to all executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="tidewatch-ship-"), "tidewatch_package.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "tidewatch").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
