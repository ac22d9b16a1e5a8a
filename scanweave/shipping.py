"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package to the executors once for each application; a no-op where PYTHONPATH already names it."""
    root = Path(__file__).resolve().parent
    if not root.is_dir() or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="scanweave-")) / "scanweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
