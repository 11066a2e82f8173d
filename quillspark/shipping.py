"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Ships the package to the workers, once for each application, unless their PYTHONPATH has it already."""
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(ROOT) in known or context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="quillspark-code-")
    archive = Path(folder, "quillspark_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((ROOT / "quillspark").rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                out.write(path, path.relative_to(ROOT))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
