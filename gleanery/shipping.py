"""Make the package importable for Python workers that were not started beside it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a session, unless PYTHONPATH or the working folder already leads there."""
    context = spark.sparkContext
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if context.applicationId in _done or str(ROOT) in map(os.path.abspath, filter(None, known)):
        return
    _done.add(context.applicationId)
    if context.master.startswith("local[") or context.master == "local":
        held = context.environment.get("PYTHONPATH")
        context.environment["PYTHONPATH"] = f"{ROOT}{os.pathsep}{held}" if held else str(ROOT)
        return
    target = Path(tempfile.mkdtemp(prefix="gleanery-")) / "gleanery.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted((ROOT / "gleanery").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    context.addPyFile(str(target))
