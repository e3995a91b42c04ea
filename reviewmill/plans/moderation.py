"""Spam jobs: read reviews, flag them, write them, report statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewmill import schemas
from reviewmill.operators import spam_flags, spam_reasons
from reviewmill.sources import files


def _numbered(spark: SparkSession, source: str, schema: str) -> DataFrame:
    """Reviews of a CSV; rows without an id of their own are numbered in file order."""
    reviews = files.read_csv(spark, source, schema, multi_line=True)
    if "review_id" not in reviews.columns:
        reviews = files.number_rows(reviews)
    return files.stage(reviews, "reviews")  # parsed once, read by groups and rules


def flag_csv(
    spark: SparkSession, source: str, output: str,
    rules: spam_flags.FlagRules = spam_flags.FlagRules(), schema: str = schemas.RAW_REVIEW,
) -> None:
    """Write every review with its four boolean flags."""
    files.write_csv(spam_flags.mark_spam(_numbered(spark, source, schema), rules), output)


def moderate_csv(
    spark: SparkSession, source: str, output: str,
    rules: spam_reasons.ReasonRules = spam_reasons.ReasonRules(),
    export_type: str = "all", schema: str = schemas.RAW_REVIEW,
) -> DataFrame:
    """Write the selected reviews as CSV and return the statistics row.

    The duplicate groups are written first: the small table lets the planner
    choose the join.  The statistics of all reviews are counted while the
    selected ones are written, so that the rules are applied once and no flagged
    table is kept.
    """
    reviews = _numbered(spark, source, schema)
    groups = files.stage(spam_reasons.reason_groups(reviews, rules), "duplicate-groups")
    flagged, seen = spam_reasons.observed_statistics(spam_reasons.flag_reviews(reviews, rules, groups))
    files.write_csv(spam_reasons.select_export(flagged, export_type), output)
    return spam_reasons.statistics_of(spark, seen)
