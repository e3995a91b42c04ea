"""Give the Python workers of a session this package."""

from __future__ import annotations

import functools
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_PACKAGES = ("reviewmill", "checks")


@functools.cache
def _ship(context: SparkContext) -> None:
    folder = Path(tempfile.mkdtemp(prefix="reviewmill-package-"))
    for package in _PACKAGES:
        if (_ROOT / package).is_dir():
            shutil.copytree(_ROOT / package, folder / "code" / package,
                            ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / "reviewmill"), "zip", folder / "code"))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark context."""
    _ship(spark.sparkContext)
