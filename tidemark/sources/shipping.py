"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark's file server, once for a context; executors fetch it from there."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_ROOT.rglob("*.py")):
            out.write(path, path.relative_to(_ROOT.parent))
    sc.addPyFile(str(archive))
    sc._tidemark_shipped = True
