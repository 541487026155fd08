"""Makes this package importable in Python workers that don't start in its folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Add the package as a zip to the session's Python files, unless the working folder or PYTHONPATH has it."""
    home = str(_ROOT.parent)
    known = [os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    app = spark.sparkContext.applicationId
    if os.path.realpath(home) in known or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file until then
    target = Path(folder) / "maskwright_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in _ROOT.rglob("*.py"):
            z.write(source, source.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(target))
