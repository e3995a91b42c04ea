"""Corpus jobs: ingest raw sources by category, refresh one label of the corpus."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from reviewmill import schemas
from reviewmill.operators import corpus
from reviewmill.sources import files


def ingest_csv(spark: SparkSession, sources: Mapping[str, str], output: str) -> None:
    """Read one raw CSV per category and write the corpus partitioned by category."""
    raw = {name: files.read_csv(spark, path, schemas.SOURCE_REVIEW, multi_line=True)
           for name, path in sources.items()}
    corpus.write_by_category(corpus.ingest_categories(raw), output)


def refresh_label(old: DataFrame, fresh: DataFrame, label: int, output: str) -> None:
    """Write the corpus with one label's rows replaced by a fresh set."""
    files.write_csv(corpus.replace_label_slice(old, fresh, label), output)


def refresh_label_in_place(spark: SparkSession, path: str, fresh: DataFrame, label: int) -> None:
    """Replace one label of a corpus kept by label; the files of all other labels, and of none, stay as they are.

    A fresh set without rows leaves no row of the label.  Readers take `mergeSchema` where it has new columns.
    """
    rows = corpus.stamped(fresh, label)
    files.replace_partitions(rows, path, "label")
    if rows.isEmpty():
        files.delete(spark, f"{path}/label={label}")
