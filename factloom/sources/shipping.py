"""This package for Python workers that don't find it on their own path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext

PACKAGE = Path(__file__).resolve().parent.parent


def ship(context: SparkContext) -> None:
    """Send the package's modules to the workers, once for each context."""
    if getattr(context, "_factloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="factloom-modules-")) / "factloom_modules.zip"
    with zipfile.ZipFile(path, "w") as z:
        for module in sorted(PACKAGE.rglob("*.py")):
            z.write(module, module.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context._factloom_shipped = True
