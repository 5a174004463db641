"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session: the package as a zip that Spark serves to every executor, later ones too."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp(prefix="quire-ship-")) / "quire_package.zip"
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("quire") / p.relative_to(root))
    context.addPyFile(str(where))
    _sent.add(context.applicationId)
