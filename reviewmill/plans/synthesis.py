"""Synthetic review jobs: one writes the requests, the other takes in the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reviewmill import fixed
from reviewmill.operators import quality, synthesis
from reviewmill.sources import files


def write_requests(reviews: DataFrame, output: str) -> None:
    """The request table of a corpus: who to write about, which policy, the prompt."""
    quality.require_columns(reviews, fixed.EXTENDED_COLUMNS)
    work = synthesis.work_list(synthesis.company_plan(reviews))
    prompt = synthesis.prompt_text(
        work["company_name"], work["category"], work["violation_type"], work["samples"])
    work.withColumn("prompt", prompt).drop("samples").write.mode("overwrite").parquet(output)


def ingest_responses(
    requests: DataFrame, responses: DataFrame, output: str, rejected: str, as_of: int, batch: str,
) -> DataFrame:
    """Add accepted answers as reviews, set the others aside, return the summary of the batch.

    `responses` has (request_id, raw).  Each batch of answers has a folder of its own under both paths,
    so that a batch that is taken in again after a failure replaces itself.
    """
    parsed = files.stage(synthesis.parse_responses(responses), "parsed-responses")
    synthesis.quarantine(parsed).write.mode("overwrite").parquet(f"{rejected}/batch={batch}")
    reviews = files.stage(
        synthesis.synthetic_reviews(requests, parsed, as_of), "synthetic-reviews")
    files.write_csv_batch(reviews, output, batch)
    return synthesis.violation_summary(reviews)
