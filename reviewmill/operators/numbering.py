"""Numbers in a total order, without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.sources import files


def numbered(df: DataFrame, *order: Column | str, out: str = "number",
             weight: Column | None = None) -> DataFrame:
    """Add the number of rows, or the sum of their weights, before each row in the order.

    Rows are dealt out by ranges of the order and written; the driver sees one sum
    for each range.  `order` must tell the rows apart.
    """
    weight = F.lit(1) if weight is None else weight
    dealt = files.stage(
        df.withColumn("_weight", weight.cast("bigint")).repartitionByRange(*order)
        .withColumn("_range", F.spark_partition_id()), "ranges")
    before, sums = [], dealt.groupBy("_range").agg(F.sum("_weight").alias("n")).collect()
    so_far = 0
    for row in sorted(sums, key=lambda r: r["_range"]):
        before.append((row["_range"], so_far))
        so_far += row["n"]
    starts = df.sparkSession.createDataFrame(before, "_range int, _start bigint")
    in_range = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("_weight").over(in_range), F.lit(0))
    return (
        dealt.withColumn("_within", within).join(starts, "_range")
        .withColumn(out, F.col("_start") + F.col("_within"))
        .select(*df.columns, out)
    )
