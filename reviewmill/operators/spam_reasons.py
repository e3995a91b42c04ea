"""Rule set B: spam flag with reasons, statistics, examples and export selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from reviewmill import fixed
from reviewmill.functions import keys, text
from reviewmill.operators import duplicates, quality


@dataclass(frozen=True)
class ReasonRules:
    min_words: int = fixed.REASON_MIN_WORDS
    min_chars: int = fixed.REASON_MIN_CHARS
    link_pattern: str = fixed.LINK_PATTERN
    promo_pattern: str = fixed.PROMO_PATTERN
    caps_min_chars: int = fixed.CAPS_MIN_CHARS
    caps_ratio: float = fixed.CAPS_RATIO
    max_exclamations: int = fixed.MAX_EXCLAMATIONS
    # Read a missing value as the text "nan", so that results equal those of a
    # table whose missing cells were turned into text.
    compat_null: bool = True


# Characters a match of the default patterns starts with.
_LEADING = {fixed.LINK_PATTERN: "hwbt", fixed.PROMO_PATTERN: "dpc%s"}


def _search(col: Column, pattern: str) -> Column:
    return text.matches(col, pattern, _LEADING.get(pattern, ""))


def _clean(df: DataFrame, column: str, rules: ReasonRules) -> Column:
    if column not in df.columns:
        return F.lit("")
    missing = fixed.NULL_TEXT if rules.compat_null else ""
    return text.strip(F.coalesce(F.col(column), F.lit(missing)))


def _with_key(df: DataFrame, rules: ReasonRules) -> DataFrame:
    """Trimmed text and the digest of `business:lower(text)`."""
    named = df.withColumn("_text", _clean(df, "text", rules))
    key = F.concat(_clean(df, "business_name", rules), F.lit(":"), F.lower("_text"))
    return named.withColumn("_key", keys.fingerprint(key))


def reason_groups(df: DataFrame, rules: ReasonRules = ReasonRules()) -> DataFrame:
    """Duplicate groups of rule B; see `duplicates.duplicate_groups`."""
    return duplicates.duplicate_groups(_with_key(df, rules), F.col("_key"))


def group_facts(df: DataFrame, rules: ReasonRules = ReasonRules(), **more: Column) -> DataFrame:
    """Every group of rule B, of one row too; see `duplicates.group_facts`."""
    return duplicates.group_facts(_with_key(df, rules), F.col("_key"), **more)


def measure(df: DataFrame, rules: ReasonRules = ReasonRules()) -> DataFrame:
    """word_count and char_count of the trimmed text."""
    return (
        df.withColumn("_text", _clean(df, "text", rules))
        .withColumns({"word_count": text.word_count(F.col("_text")),
                      "char_count": text.char_count(F.col("_text"))})
        .drop("_text")
    )


def flag_reviews(
    df: DataFrame, rules: ReasonRules = ReasonRules(), groups: DataFrame | None = None
) -> DataFrame:
    """Add is_spam, spam_reasons, word_count and char_count to every review.

    `review_id` must be unique and give the review order from 0: the first
    member of a duplicate group stays clean and the later ones name it.  All
    facts about the text are computed before the duplicate join; the text is
    shuffled only if it is selected from the result.  `groups` can name a first
    review from elsewhere, which then has any id: all others of the group name it.
    """
    quality.require_columns(df, ["review_id"])
    if groups is None:
        groups = reason_groups(df, rules)
    clean = F.col("_text")
    facts = _with_key(df, rules).withColumns({
        "word_count": text.word_count(clean),
        "char_count": text.char_count(clean),
        "_links": _search(clean, rules.link_pattern),
        "_promo": _search(clean, rules.promo_pattern),
        "_caps": F.when(
            F.length(clean) > rules.caps_min_chars,
            text.uppercase_count(clean) / F.length(clean) > rules.caps_ratio,
        ),
        "_shouts": text.occurrences(clean, "!") > rules.max_exclamations,
    }).drop("_text")
    grouped = duplicates.attach_groups(facts, groups, "_key")

    words, chars, first = F.col("word_count"), F.col("char_count"), F.col("_first_id")
    say = fixed.REASON_FORMATS
    reasons = (
        F.when(words < rules.min_words,
               F.format_string(say["words"], words, F.lit(rules.min_words))),
        F.when(chars < rules.min_chars,
               F.format_string(say["chars"], chars, F.lit(rules.min_chars))),
        F.when(F.col("_links"), F.lit(say["links"])),
        F.when(F.col("_promo"), F.lit(say["promo"])),
        F.when(first != F.col("review_id"), F.format_string(say["duplicate"], first + 1)),
        F.when(F.col("_caps"), F.lit(say["caps"])),
        F.when(F.col("_shouts"), F.lit(say["exclamations"])),
    )
    return (
        grouped.withColumn("spam_reasons", F.concat_ws(fixed.REASON_SEPARATOR, *reasons))
        .withColumn("is_spam", F.col("spam_reasons") != "")
        .select(*df.columns, "is_spam", "spam_reasons", "word_count", "char_count")
    )


def reason_list(col: str = "spam_reasons") -> Column:
    """The joined reasons as an array; empty for a clean review."""
    return F.array_remove(F.split(F.col(col), fixed.REASON_SEPARATOR), "")


def reason_counts(flagged: DataFrame) -> DataFrame:
    """Reviews per rule; the numbers inside a reason do not make new rules."""
    rule = F.regexp_replace(F.col("reason"), r" (\(\d+ < \d+\)|#\d+)$", "")
    return (
        flagged.where("is_spam")
        .select(F.explode(reason_list()).alias("reason"))
        .groupBy(rule.alias("reason"))
        .agg(F.count("*").alias("reviews"))
    )


def _one_decimal(col: Column) -> Column:
    return F.rint(col * 10) / 10


def statistics(flagged: DataFrame) -> DataFrame:
    """One row of counts, spam rate and mean lengths, halves rounded to even."""
    total, spam = F.count("*"), F.count_if("is_spam")
    return flagged.agg(
        total.alias("total_reviews"),
        spam.alias("spam_count"),
        (total - spam).alias("legitimate_count"),
        F.when(total > 0, _one_decimal(spam / F.nullif(total, F.lit(0)) * 100))
        .otherwise(0.0).alias("spam_rate"),
        _one_decimal(F.avg("word_count")).alias("avg_word_count"),
        _one_decimal(F.avg("char_count")).alias("avg_char_count"),
    )


def observed_statistics(flagged: DataFrame) -> tuple[DataFrame, Observation]:
    """The reviews as they are, counted as they pass: read the counts by `statistics_of` once they were written.

    The counting needs no pass of its own.  It stands where it is put: what is filtered out later counts.
    """
    seen = Observation("spam statistics")
    return flagged.observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_spam")).alias("spam"),
        F.sum(F.col("word_count").cast("bigint")).alias("words"),
        F.sum(F.col("char_count").cast("bigint")).alias("chars")), seen


def statistics_of(spark: SparkSession, seen: Observation) -> DataFrame:
    """The row of `statistics` from what was counted in passing."""
    counted = seen.get
    row = spark.createDataFrame(
        [tuple(counted.get(c) for c in ("total", "spam", "words", "chars"))],
        "total bigint, spam bigint, words bigint, chars bigint")
    total, spam = F.col("total"), F.col("spam")
    mean = lambda c: _one_decimal(F.col(c) / F.nullif(total, F.lit(0)))
    return row.select(
        total.alias("total_reviews"), spam.alias("spam_count"), (total - spam).alias("legitimate_count"),
        F.coalesce(_one_decimal(spam / F.nullif(total, F.lit(0)) * 100), F.lit(0.0)).alias("spam_rate"),
        mean("words").alias("avg_word_count"), mean("chars").alias("avg_char_count"))


def spam_examples(
    flagged: DataFrame, rows: int = fixed.EXAMPLE_ROWS, chars: int = fixed.EXAMPLE_CHARS
) -> DataFrame:
    """The first spam reviews in review order, long texts cut."""
    return (
        flagged.where("is_spam")
        .orderBy("review_id")
        .limit(rows)
        .select(
            "review_id", "business_name", "author_name",
            text.preview(F.coalesce("text", F.lit(fixed.NULL_TEXT)), chars).alias("review"),
            "spam_reasons",
        )
    )


def select_export(flagged: DataFrame, export_type: str = "all") -> DataFrame:
    """'spam', 'legitimate' or 'all'; any other word means 'all'."""
    if export_type == "spam":
        return flagged.where("is_spam")
    if export_type == "legitimate":
        return flagged.where("NOT is_spam")
    return flagged
