"""First reviews of duplicate groups across the micro-batches of a stream, in event time.

Each micro-batch is first combined to one row for each of its groups, however many copies it
holds.  These rows are a stream of their own, whose state processor keeps the first
review of every group in Spark's state store, so that a micro-batch costs as much as it has groups, whatever the
state holds.  A group is forgotten when its newest copy is more than `keep` behind the newest
review of the batches before; its next copy is then a first review again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reviewmill.sources import files
from reviewmill.sources.ship import ship

_GROUPS = "dup_key binary, first_id bigint, copies bigint, seen_at timestamp, batch bigint"
_EARLIER = "batch bigint, dup_key binary, earlier_id bigint"


@dataclass(frozen=True)
class EarlierCopies:
    """Look for copies in earlier micro-batches too.

    `event_time` names the column of the reviews that says when they were written; `keep` is how long a group is
    remembered behind the newest review, as an interval; `path` is a shared folder for the groups and their state, one
    for each stream.
    """

    event_time: str
    keep: str
    path: str


def _first_reviews(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The batches of a group that has an earlier first review, with its id."""
    if state.hasTimedOut:
        state.remove()
        return
    # Plain numbers: most groups have one row, for which building a frame costs most of the time.
    rows = sorted(row for part in parts for row in zip(
        part["batch"].tolist(), part["first_id"].tolist(), part["seen_ms"].tolist()))
    known, newest = state.get if state.exists else (None, 0)
    found = []
    for batch, first_id, seen_ms in rows:
        if known is None:
            known = int(first_id)
        else:
            found.append((int(batch), key[0], known))
        newest = max(newest, int(seen_ms))
    state.update((known, newest))
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1))
    if found:
        yield pd.DataFrame(found, columns=["batch", "dup_key", "earlier_id"])


def with_earlier(groups: DataFrame, copies: EarlierCopies, batch_id: int) -> DataFrame:
    """(dup_key, first_id, copies) of the groups of a micro-batch that have a copy in it or in an earlier one.

    `groups` has (dup_key, first_id, copies, seen_at).  Groups that are all late, or have no time, are
    looked for inside their micro-batch only.  A micro-batch that runs again finds its groups written
    and the state ahead of it, and gets the same result.
    """
    spark = groups.sparkSession
    ship(spark)
    own, found = (f"{copies.path}/{name}" for name in ("groups", "earlier"))
    if not files.exists(spark, f"{own}/batch={batch_id}/_SUCCESS"):
        groups.write.mode("overwrite").parquet(f"{own}/batch={batch_id}")

    def write(rows: DataFrame, part: int) -> None:
        rows.drop("batch").write.mode("overwrite").parquet(f"{found}/batch={batch_id}/part={part}")

    firsts = (
        spark.readStream.schema(_GROUPS).parquet(own).where("seen_at IS NOT NULL").drop("copies")
        .withColumn("seen_ms", F.unix_millis("seen_at")).withWatermark("seen_at", copies.keep).groupBy("dup_key")
        .applyInPandasWithState(_first_reviews, _EARLIER, "first_id bigint, newest bigint", "append",
                                GroupStateTimeout.EventTimeTimeout)
    )
    firsts.writeStream.foreachBatch(write).outputMode("append").option(
        "checkpointLocation", f"{copies.path}/state").trigger(availableNow=True).start().awaitTermination()

    groups = spark.read.parquet(f"{own}/batch={batch_id}")
    place = f"{found}/batch={batch_id}"
    if files.exists(spark, place):
        earlier = spark.read.schema("dup_key binary, earlier_id bigint").parquet(place).drop("part")
        earlier = earlier.withColumnRenamed("dup_key", "_earlier_key")
        groups = groups.join(earlier, F.col("dup_key") == F.col("_earlier_key"), "left")
    else:
        groups = groups.withColumn("earlier_id", F.lit(None).cast("bigint"))
    return groups.where("copies > 1 OR earlier_id IS NOT NULL").select(
        "dup_key", F.coalesce("earlier_id", "first_id").alias("first_id"), "copies")


def forget(groups: DataFrame, copies: EarlierCopies, batch_id: int) -> None:
    """Delete what the micro-batch before the given one left; the state does not need it."""
    for name in ("groups", "earlier"):
        files.delete(groups.sparkSession, f"{copies.path}/{name}/batch={batch_id - 1}")
