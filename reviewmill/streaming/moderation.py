"""Live moderation with Structured Streaming: the batch rules on every micro-batch of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewmill.operators import spam_reasons
from reviewmill.streaming import earlier


def moderate_stream(
    reviews: DataFrame, output: str, checkpoint: str,
    rules: spam_reasons.ReasonRules = spam_reasons.ReasonRules(),
    trigger: dict | None = None, copies: earlier.EarlierCopies | None = None,
) -> StreamingQuery:
    """Flag a stream of reviews and write one Parquet folder per micro-batch.

    Duplicates are looked for inside a micro-batch, as they are inside one call
    of the batch operator; with `copies` also among the reviews of earlier micro-batches, of which
    later copies then name the first.  A batch that runs again after a failure overwrites
    its own folder, so every review is written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read by the groups and by the rules
        groups = None
        if copies:
            seen_at = F.max(F.col(copies.event_time).cast("timestamp"))
            groups = earlier.with_earlier(
                spam_reasons.group_facts(batch, rules, seen_at=seen_at), copies, batch_id)
        flagged = spam_reasons.flag_reviews(batch, rules, groups)
        flagged.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        batch.unpersist()
        if copies:
            earlier.forget(batch, copies, batch_id)

    return (
        reviews.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
