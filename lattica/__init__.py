"""Spark-native analytics over node, edge, event and finding tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Lets Python workers import this package: nothing to do where PYTHONPATH has it, else the
    package goes to the executors once through the driver's own file server."""
    root = Path(__file__).resolve().parent
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="lattica-")) / "lattica.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for p in sorted(root.rglob("*.py")):
            archive.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
