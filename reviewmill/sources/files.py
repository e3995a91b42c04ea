"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reviewmill import fixed
from reviewmill.operators import quality

_CSV = {"header": True, "quote": '"', "escape": '"'}


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _cell(name: str, dtype: T.DataType) -> Column:
    """A CSV cell as its type; a missing or unreadable cell is null."""
    cell = F.when(~F.col(name).isin(*fixed.NA_TOKENS), F.col(name))
    if isinstance(dtype, T.IntegralType):
        # Whole numbers are often written "4.0" where other cells are missing; "4.7" is none.
        number = cell.try_cast("double")
        return F.when(number == F.floor(number), F.coalesce(cell.try_cast(dtype), number.try_cast(dtype)))
    return cell.try_cast(dtype)


def read_csv(
    spark: SparkSession, path: str, schema: str, *, multi_line: bool
) -> DataFrame:
    """The named columns of CSV files with a header, in any order, others left out.

    Quoted commas and quotes are part of a cell; the usual words for "missing" are
    null, and so is a cell that is not of its column's type.  All files must have
    the same header: a file that deviates fails the query.  With `multi_line`, line
    breaks in quotes are part of a cell and a file is read by one task, so large
    inputs should come as many files; without, files are split and no cell
    may hold a break.
    """
    reader = spark.read.options(**_CSV, multiLine=multi_line)
    header = reader.csv(path).columns
    raw = reader.schema(", ".join(f"`{c}` string" for c in header)).option(
        "enforceSchema", False).csv(path)
    fields = T.StructType.fromDDL(schema).fields
    quality.require_columns(raw, [f.name for f in fields])
    return raw.select(*(_cell(f.name, f.dataType).alias(f.name) for f in fields))


def number_rows(df: DataFrame, column: str = "review_id") -> DataFrame:
    """Number the rows of files from 0 in file order.

    `df` must be a scan or a projection of one.  The rows of each input split
    are numbered where they are; the split sizes, one small row for every split,
    are written and summed up in file order, and the planner, which knows
    their size, chooses how rows meet them.
    """
    from reviewmill.operators import numbering

    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_place"),
    )
    splits = placed.groupBy("_path", "_from").agg(
        F.count("*").alias("_n"), F.min("_place").alias("_first"))
    splits = stage(numbering.numbered(splits, "_path", "_from", out="_before", weight=F.col("_n")), "splits")
    return (
        placed.join(splits, ["_path", "_from"])
        .withColumn(column, F.col("_before") + F.col("_place") - F.col("_first"))
        .select(column, *df.columns)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV directory with a header in each part; padding in cells is kept.

    `mode="append"` adds parts to what is there, each with its own header.
    """
    df.write.mode(mode).options(
        **_CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_csv_batch(df: DataFrame, path: str, batch: str) -> None:
    """The rows of one batch as `path/batch=<name>`, in place of what a first try left there.

    A batch that is written again leaves the same rows once; other batches are
    not touched.  Each part has its own header.  `read_csv` reads the batches as one table.
    """
    write_csv(df, f"{path}/batch={batch}")


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Parquet parted by the columns: parts that `df` has rows of are replaced, all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array (or object); one row per element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def explode_json_array(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Array documents held in a column: one row per element, in place of the column."""
    body = F.from_json(F.col(column), f"array<struct<{schema}>>")
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(body).alias("_row")).select(*rest, "_row.*")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8; characters are written as they are, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    system, there = _file_system(spark, path)
    return system.exists(there)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    system, there = _file_system(spark, path)
    system.delete(there, True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that the session names.

    That is `spark.checkpoint.dir`, or else what `setCheckpointDir` was given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no recomputation, and gives
    the planner a known size to choose a join by.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return read_parquet(df.sparkSession, path, df.schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Arrow batches of at most so many rows, for what is run inside; texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_staged(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the folders of staged tables that are no longer read."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            delete(spark, folder)
