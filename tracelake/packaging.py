"""Makes the package importable in the Python workers of executors, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="tracelake-")) / "tracelake.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(home.rglob("*.py")):
                out.write(path, path.relative_to(home.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark
