"""Gives the executors' Python this package, for functions that run there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext

_shipped: set[str] = set()


def ship(context: SparkContext) -> None:
    """Add the package's source to the application, once."""
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp()) / f"{package.name}-source.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
