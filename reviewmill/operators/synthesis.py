"""Planning synthetic policy-violating reviews and taking in the model's answers.

The model itself stands between the two halves: `prompts` writes the request
table, `parse_responses` reads the answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reviewmill import fixed
from reviewmill.functions import keys, ranges, text

def _named(df: DataFrame) -> DataFrame:
    return df.where(F.col("company_name").isNotNull())


def company_counts(df: DataFrame) -> DataFrame:
    """Reviews per company; rows without a company are left out."""
    return _named(df).groupBy("company_name").agg(F.count("*").alias("n_reviews"))


def quota(n_reviews: Column) -> Column:
    """Reviews to generate per policy: half the company's reviews, shared out."""
    return F.ceil(n_reviews / 2 / len(fixed.POLICIES)).cast("bigint")


def company_quotas(df: DataFrame) -> DataFrame:
    return company_counts(df).withColumn("quota", quota(F.col("n_reviews")))


def first_attributes(df: DataFrame) -> DataFrame:
    """Category and group of each company's first review, missing or not."""
    first = F.min_by(F.struct("category", "group"), "review_id")
    return _named(df).groupBy("company_name").agg(first.alias("_first")).select(
        "company_name", "_first.category", "_first.group"
    )


def company_samples(
    df: DataFrame, rows: int = fixed.SAMPLE_ROWS, chars: int = fixed.SAMPLE_CHARS
) -> DataFrame:
    """The first reviews of each company as quoted lines.

    The rank filter becomes a group limit before the shuffle: each map task
    sends at most `rows` short lines per company, however hot the company is.
    """
    in_order = Window.partitionBy("company_name").orderBy("review_id")
    line = F.concat(F.lit("- "), text.preview(F.coalesce("text", F.lit("")), chars, always=True))
    return (
        _named(df)
        .select("company_name", "review_id", line.alias("line"))
        .withColumn("position", F.row_number().over(in_order))
        .where(F.col("position") <= rows)
        .groupBy("company_name")
        .agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("_lines"))
        .select("company_name", F.array_join("_lines.line", "\n").alias("samples"))
    )


def company_plan(df: DataFrame) -> DataFrame:
    """One row per company: counts, quota, first attributes and sample lines."""
    first = F.min_by(F.struct("category", "group"), "review_id")
    facts = _named(df).groupBy("company_name").agg(
        F.count("*").alias("n_reviews"), first.alias("_first")
    ).select(
        "company_name", "n_reviews", quota(F.col("n_reviews")).alias("quota"),
        "_first.category", "_first.group",
    )
    return facts.join(company_samples(df), "company_name")


def policies(spark: SparkSession) -> DataFrame:
    """The policy dimension, in generation order."""
    rows = [(i, k, p["description"], p["example"])
            for i, (k, p) in enumerate(fixed.POLICIES.items())]
    return spark.createDataFrame(
        rows, "position int, violation_type string, description string, example string"
    )


def work_list(plan: DataFrame, chunk: int = ranges.CHUNK) -> DataFrame:
    """One row per review to generate: company x policy x 1..quota.

    The requests of a hot company are spread over all tasks.
    """
    asked = plan.withColumn("violation_type", F.explode(F.array(*map(F.lit, fixed.POLICIES))))
    numbered = ranges.explode_range(
        asked, "seq", F.col("quota"), 1, 1, ["company_name", "violation_type"], chunk)
    return numbered.withColumn(
        "request_id", F.md5(F.concat_ws("|", "violation_type", "seq", "company_name")))


def prompt_text(
    company: Column, category: Column, violation_type: Column, samples: Column
) -> Column:
    """The full prompt of one request; an unknown policy is written as a rant."""
    context = F.format_string(
        fixed.PROMPT_CONTEXT, company, F.coalesce(category, F.lit(fixed.NULL_TEXT)),
        samples, violation_type,
    )
    known = dict(fixed.PROMPT_POLICY)
    instruction = F.lit(known.pop("rant_without_visit"))
    for name, words in known.items():
        instruction = F.when(violation_type == name, F.lit(words)).otherwise(instruction)
    return F.concat_ws(
        "\n\n", F.lit(fixed.PROMPT_SYSTEM), context, instruction, F.lit(fixed.PROMPT_CLOSING)
    )


def prompts(work: DataFrame) -> DataFrame:
    """Request table for the model: (request_id, violation_type, prompt).

    The long fixed parts are literals added after the last shuffle.
    """
    prompt = prompt_text(*map(F.col, ("company_name", "category", "violation_type", "samples")))
    return work.select("request_id", "company_name", "violation_type", "seq",
                       prompt.alias("prompt"))


def reviewer_name(key: Column) -> Column:
    return F.concat_ws(" ", keys.pick(fixed.FIRST_NAMES, key, "first"),
                       keys.pick(fixed.LAST_NAMES, key, "last"))


def review_date(key: Column, as_of: int) -> Column:
    """A day in the two years before `as_of` (epoch seconds), uniform in seconds."""
    back = F.pmod(keys.hash_number(keys.seeded(key, "date")),
                  F.lit(fixed.DATE_WINDOW_SECONDS + 1))
    days = F.floor((F.lit(as_of).cast("bigint") - back) / 86_400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def with_attributes(work: DataFrame, as_of: int) -> DataFrame:
    """Add reviewer_name and review_date, seeded by the request and so repeatable."""
    request = F.col("request_id")
    return work.withColumns({
        "reviewer_name": reviewer_name(request), "review_date": review_date(request, as_of),
    })


def parse_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add review_text, star_rating and `rejection` (null for an accepted answer).

    Only JSON numbers rate; a rating is cut to a whole number and held to 1..5.
    """
    found = [F.regexp_extract(F.col(raw), f"(?sU){fixed.RESPONSE_PATTERN}", g) for g in (1, 2)]
    body = F.when(found[0] != "", found[0]).otherwise(found[1])
    parsed = F.from_json(
        F.col("_body"), "review_text string, star_rating double, _broken string",
        {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_broken"},
    )
    rating, words = F.col("_parsed.star_rating"), F.col("_parsed.review_text")
    number = rating.isNotNull() & ~F.isnan(rating) & (F.abs(rating) != float("inf"))
    rejection = (
        F.when(F.coalesce(text.strip(F.col(raw)), F.lit("")) == "", F.lit("empty response"))
        .when(F.col("_body") == "", F.lit("no JSON object"))
        .when(F.coalesce(words, F.lit("")) == "",
              F.when(F.try_parse_json("_body").isNull(), F.lit("not valid JSON"))
              .otherwise(F.lit("no review text")))
        .when(~F.coalesce(number, F.lit(False)), F.lit("no numeric rating"))
    )
    accepted = F.col("rejection").isNull()
    clean = text.strip(words)
    quoted = (clean.startswith('"') & clean.endswith('"')) | (
        clean.startswith("'") & clean.endswith("'"))
    unquoted = F.when(
        quoted, F.substring(clean, F.lit(2), F.greatest(F.length(clean) - 2, F.lit(0)))
    ).otherwise(clean)
    return (
        df.withColumn("_body", body)
        .withColumn("_parsed", parsed)
        .withColumn("rejection", rejection)
        .withColumns({
            "review_text": F.when(accepted, unquoted),
            "star_rating": F.when(
                accepted, F.floor(F.greatest(F.lit(1.0), F.least(F.lit(5.0), rating)))
            ).cast("int"),
        })
        .drop("_body", "_parsed")
    )


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("rejection").isNotNull())


def synthetic_reviews(work: DataFrame, parsed: DataFrame, as_of: int) -> DataFrame:
    """Accepted answers joined to their requests by the unique request id."""
    answers = parsed.where(F.col("rejection").isNull()).select(
        "request_id", "review_text", "star_rating"
    )
    asked = work.select("request_id", "company_name", "category", "group", "violation_type")
    return with_attributes(asked.join(answers, "request_id"), as_of).select(
        "company_name", "reviewer_name", "review_date",
        F.col("review_text").alias("text"), F.col("star_rating").alias("stars"),
        "category", F.lit("").alias("image_urls"), F.lit("").alias("image_captions"),
        "group", F.lit(True).alias("irrelevant"), "violation_type",
    )


def violation_summary(reviews: DataFrame) -> DataFrame:
    """Reviews per policy, policies without any kept at zero."""
    counts = reviews.groupBy("violation_type").agg(F.count("*").alias("n"))
    title = F.initcap(F.replace("violation_type", F.lit("_"), F.lit(" ")))
    return policies(reviews.sparkSession).join(counts, "violation_type", "left").select(
        "violation_type", title.alias("title"), F.coalesce("n", F.lit(0)).alias("n_reviews")
    )
