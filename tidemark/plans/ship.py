"""The package itself on the executors, whose Python workers run some of its functions."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to all present and future executors, once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for module in sorted(root.rglob("*.py")):
            z.write(module, str(Path(root.name) / module.relative_to(root)))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
