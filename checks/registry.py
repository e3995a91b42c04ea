"""All checks in one place."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession

from checks import corpus, model, pages, spam, synth
from reviewmill.sources.ship import ship


def ready(spark: SparkSession) -> None:
    """The package on the executors and, on a local master, a folder for staged tables."""
    ship(spark)
    context = spark.sparkContext
    unset = not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir())
    if unset and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="reviewmill-"))


def with_package(run):
    @functools.wraps(run)
    def shipped(spark, sf_dir):
        ready(spark)
        return run(spark, sf_dir)
    return shipped


_CHECKS = {**spam.CHECKS, **corpus.CHECKS, **synth.CHECKS, **pages.CHECKS, **model.CHECKS}

QUERIES = {name: with_package(run) for name, (run, _) in _CHECKS.items()}
SQL = {name: sql for name, (_, sql) in _CHECKS.items() if sql}
