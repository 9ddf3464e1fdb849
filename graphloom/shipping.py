"""The package on the executors' side."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="graphloom-package-")) / "graphloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))  # from here on Spark's own file server hands it out
    sc._graphloom_shipped = True


def shipped(df: DataFrame) -> DataFrame:
    """The same rows, on executors that can import this package: for whatever applies a Python function to them."""
    ship(df.sparkSession)
    return df
