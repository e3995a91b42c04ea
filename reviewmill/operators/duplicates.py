"""Duplicate detection that survives hot keys.

Groups are found by a map-side combined aggregate over (digest, row id), never by
a window that would buffer a whole group of copies in one task.  The groups held by most rows are
broadcast, as many as there are shuffle partitions; their rows are dealt out one by one.  No other group
has more rows than one partition's share of them all, so the rest meet their groups by key,
each group once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def group_facts(df: DataFrame, key: Column, row_id: str = "review_id", **more: Column) -> DataFrame:
    """(dup_key, first_id, copies, ...) of every key; `more` are aggregates over the columns of `df`."""
    return df.groupBy(key.alias("dup_key")).agg(
        F.min(row_id).alias("first_id"), F.count("*").alias("copies"),
        *(c.alias(name) for name, c in more.items()))


def duplicate_groups(df: DataFrame, key: Column, row_id: str = "review_id") -> DataFrame:
    """(dup_key, first_id, copies) for every key held by more than one row.

    The groups get a shuffle of their own after the unique keys are dropped, so
    that adaptive execution sees how many are left before any review is moved.
    The result can also be written to a table and passed back to the flagging
    operators: Spark then knows its size beforehand.
    """
    return group_facts(df, key, row_id).where("copies > 1").hint("rebalance")


def heaviest(groups: DataFrame, most: int) -> DataFrame:
    """The `most` groups with the most copies; each task keeps no more than that many."""
    return groups.orderBy(F.desc("copies"), "dup_key").limit(most)


def attach_groups(
    df: DataFrame, groups: DataFrame, key: str, row_id: str = "review_id", most: int | None = None,
) -> DataFrame:
    """Add `_first_id` and `_copies` (null for unique rows) to every row of `df`.

    Rows of the `most` heaviest groups, by default one for each shuffle partition, take their facts from a
    broadcast of that many rows, and a place of their own in the join with the other groups.
    Reviews move only after the groups are complete, and not at all if those turn out small.
    """
    if most is None:
        most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(heaviest(groups, most).select(
        F.col("dup_key").alias("_hot_key"), F.struct("first_id", "copies").alias("_hot")))
    cold = groups.select(F.col("dup_key").alias("_own_key"), F.struct("first_id", "copies").alias("_cold"))
    kept = [c for c in df.columns if c != key]
    keyed = df.withColumnsRenamed({key: "_dup_key"})
    keyed = keyed.join(hot, F.col("_dup_key") == F.col("_hot_key"), "left")
    # Longer than any digest, so equal to none.
    alone = F.concat("_dup_key", F.encode(F.col(row_id).cast("string"), "utf-8"))
    own = F.when(F.col("_hot").isNull(), F.col("_dup_key")).otherwise(F.coalesce(alone, F.lit(b"")))
    found = keyed.withColumn("_own_key", own).join(cold, "_own_key", "left")
    facts = F.coalesce("_hot", "_cold")
    return found.select(*kept, facts["first_id"].alias("_first_id"), facts["copies"].alias("_copies"))
