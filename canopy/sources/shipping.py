"""Python code of this package, sent to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application; the driver serves it, so no folder need be shared."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        at = Path(tempfile.mkdtemp()) / "canopy_code.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        spark.sparkContext.addPyFile(str(at))
        _shipped.add(app)
    return spark
