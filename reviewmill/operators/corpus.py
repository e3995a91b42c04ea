"""Building one review corpus out of several sources."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from reviewmill import fixed
from reviewmill.operators import quality


def normalize_source(df: DataFrame, category: str) -> DataFrame:
    """Project a raw source, stamp its category, rename, and fill missing text."""
    quality.require_columns(df, fixed.SOURCE_COLUMNS)
    return (
        df.select(*fixed.SOURCE_COLUMNS)
        .withColumnsRenamed(fixed.SOURCE_RENAMES)
        .withColumns({"category": F.lit(category), "text": F.coalesce("text", F.lit(""))})
    )


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Union all by name; a column missing on one side becomes null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ingest_categories(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Normalise one raw source per category into one table."""
    return union_sources(normalize_source(df, name) for name, df in sources.items())


def write_by_category(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by category, so that readers of one category skip the others."""
    df.write.mode(mode).partitionBy("category").parquet(path)


def without_label(df: DataFrame, label: int) -> DataFrame:
    """Rows whose label is not `label`; rows without a label stay."""
    return df.where(~F.col("label").eqNullSafe(F.lit(label)))


def replace_label_slice(
    old: DataFrame, fresh: DataFrame, label: int, drop: tuple[str, ...] = ("reviewer_name",)
) -> DataFrame:
    """Swap every row of one label for a fresh set stamped with that label."""
    return union_sources([without_label(old, label).drop(*drop), stamped(fresh, label, drop)])


def stamped(fresh: DataFrame, label: int, drop: tuple[str, ...] = ("reviewer_name",)) -> DataFrame:
    """A fresh set with its label, in the columns of the corpus."""
    return fresh.withColumn("label", F.lit(label)).drop(*drop)


def write_by_label(df: DataFrame, path: str, drop: tuple[str, ...] = ("reviewer_name",)) -> None:
    """The corpus with a folder for each label, so that one label can be replaced alone."""
    df.drop(*drop).write.mode("overwrite").partitionBy("label").parquet(path)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column; a missing value counts as one."""
    return df.select(column).distinct()
