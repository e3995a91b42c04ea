"""What the operators of this folder share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reviewmill.sources import files
from reviewmill.sources.files import small_batches  # noqa: F401
from reviewmill.sources.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back.

    A session on a local master that names no folder gets one of its own.
    """
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="reviewmill-"))
    return files.stage(df, name)


def free(df: DataFrame, name: str) -> str:
    """The name, made longer until no column of the table has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def struct(*fields: tuple[str, str | T.DataType]) -> T.StructType:
    kinds = ((n, T.DataType.fromDDL(k) if isinstance(k, str) else k) for n, k in fields)
    return T.StructType([T.StructField(n, k) for n, k in kinds])


def binary(column: pa.Array) -> list:
    """UTF-8 bytes of each text; a missing text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_rows(df: DataFrame, schema: T.StructType, run: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Arrow batches through `run`, which gives the columns of its result by name."""
    ship(df.sparkSession)
    kinds = {f.name: f.dataType for f in schema.fields}

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in source:
            columns = run(batch)
            arrays = [
                x if isinstance(x := columns[n], pa.Array) else pa.array(x, to_arrow_type(k))
                for n, k in kinds.items()
            ]
            yield pa.RecordBatch.from_arrays(arrays, list(kinds))

    return df.mapInArrow(batches, schema)


def id_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def literal_long(value: int):
    """A 64-bit word, given as an unsigned number."""
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def literal_longs(values: list[int]):
    """An array column of 64-bit words, each given as an unsigned number."""
    return F.array(*map(literal_long, values))
