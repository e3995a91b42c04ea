"""Rule sets A and B."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import SQL_WS, SQL_WS_CLASS, VIEWS, cte, derived, table, view
from reviewmill import fixed
from reviewmill.functions import text
from reviewmill.operators import spam_flags, spam_reasons
from reviewmill.sources import files
from reviewmill.streaming import earlier, moderation

_CUSTOM = spam_reasons.ReasonRules(
    min_words=5, min_chars=20, link_pattern=r"(https?://|www\.)",
    promo_pattern=r"(coupon|\d{2}%)", compat_null=False,
)


def _flag_columns(df):
    return df.select("review_id", "spam_regex", "spam_length", "spam_duplicate", "is_spam")


def spam_a_regex(spark, sf_dir):
    return view(spark, sf_dir, "messy").select(
        "review_id", spam_flags.pattern_flag(F.col("text")).alias("spam_regex"))


def spam_a_regex_corrected(spark, sf_dir):
    flag = spam_flags.pattern_flag(F.col("text"), fixed.FLAG_PATTERNS_CORRECTED)
    return view(spark, sf_dir, "messy").select("review_id", flag.alias("spam_regex"))


def spam_a_length(spark, sf_dir):
    return view(spark, sf_dir, "messy").select(
        "review_id", spam_flags.length_flag(F.col("text")).alias("spam_length"))


def spam_a_duplicate(spark, sf_dir):
    return spam_flags.mark_duplicates(view(spark, sf_dir, "messy")).select(
        "review_id", "spam_duplicate")


def spam_a_flags(spark, sf_dir):
    return _flag_columns(spam_flags.mark_spam(view(spark, sf_dir, "messy")))


def _words(column):
    return f"len(list_filter(regexp_split_to_array({column}, '{SQL_WS_CLASS}+'), lambda w: w <> ''))"


def _a_sql(columns, patterns=fixed.FLAG_PATTERNS):
    hit = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in patterns)
    return f"""{cte('messy')}, f AS (SELECT *,
        coalesce({hit}, TRUE) AS spam_regex,
        coalesce({_words('text')} < 5 OR length(text) < 20, TRUE) AS spam_length,
        count(*) OVER (PARTITION BY business_name, text) > 1 AS spam_duplicate FROM messy)
    SELECT review_id, {columns} FROM f"""


def review_lengths(spark, sf_dir):
    return spam_reasons.measure(view(spark, sf_dir, "messy")).select(
        "review_id", "word_count", "char_count")


def _flagged(spark, sf_dir, rules=spam_reasons.ReasonRules(), name="messy"):
    return spam_reasons.flag_reviews(view(spark, sf_dir, name), rules)


_B_COLUMNS = ("review_id", "is_spam", "spam_reasons", "word_count", "char_count")


def spam_b_reasons(spark, sf_dir):
    return _flagged(spark, sf_dir).select(
        "review_id", "business_name", "text", *_B_COLUMNS[1:])


def spam_b_plain(spark, sf_dir):
    return _flagged(spark, sf_dir, name="reviews").select(*_B_COLUMNS)


def spam_b_custom(spark, sf_dir):
    return _flagged(spark, sf_dir, _CUSTOM).select(*_B_COLUMNS)


def spam_b_staged(spark, sf_dir):
    """The same rules with the duplicate groups written first."""
    reviews = view(spark, sf_dir, "messy")
    groups = files.stage(spam_reasons.reason_groups(reviews), "duplicate-groups")
    return spam_reasons.flag_reviews(reviews, groups=groups).select(*_B_COLUMNS)


def _single_rule(start):
    """Reviews that one rule flags, with its reason."""
    def run(spark, sf_dir):
        listed = _flagged(spark, sf_dir).where("is_spam").select(
            "review_id", F.explode(spam_reasons.reason_list()).alias("reason"))
        return listed.where(F.col("reason").startswith(start))
    return run


def spam_statistics(spark, sf_dir):
    return spam_reasons.statistics(_flagged(spark, sf_dir))


def spam_examples(spark, sf_dir):
    return spam_reasons.spam_examples(_flagged(spark, sf_dir))


def spam_reason_counts(spark, sf_dir):
    return spam_reasons.reason_counts(_flagged(spark, sf_dir))


def _export(kind):
    def run(spark, sf_dir):
        return spam_reasons.select_export(_flagged(spark, sf_dir), kind).select(*_B_COLUMNS)
    return run


STREAM_PARTS = 5


def _in_parts(documents, path, parts, run):
    """The documents part by part, each written by all tasks; `run` ends once the stream has taken in what is new.

    A part is a micro-batch of its own, in however many files it comes.
    """
    for part in parts:
        documents.where(F.expr(f"doc_id % {STREAM_PARTS}").eqNullSafe(F.lit(part))).write.parquet(f"{path}/part={part}")
        run()


def stream_spam_b(spark, sf_dir):
    """The stream over documents that come in parts, one micro-batch for each of them."""
    path, output, state = (files.staging_path(spark, n) for n in ("stream-documents", "moderated", "moderated-state"))
    documents = table(spark, sf_dir, "documents")
    parts = documents.selectExpr(f"doc_id % {STREAM_PARTS} AS part").distinct().collect()

    def run():
        stream = spark.readStream.schema(documents.schema).parquet(f"{path}/part=*")
        reviews = derived(stream, VIEWS["messy"][0][2])
        moderation.moderate_stream(reviews, output, state).awaitTermination()

    _in_parts(documents, path, [r.part for r in parts] or [0], run)
    static = view(spark, sf_dir, "messy")
    flagged = spark.read.schema(
        spam_reasons.flag_reviews(static).schema).parquet(f"{output}/batch=*")
    return flagged.select(*_B_COLUMNS)


def stream_copies(spark, sf_dir):
    """One micro-batch after the other, a hundred days apart; copies are remembered for 150 days."""
    path, output, state = (files.staging_path(spark, n) for n in ("live", "live-moderated", "live-state"))
    documents = table(spark, sf_dir, "documents")
    day = f"CAST(DATE '2024-01-01' + CAST(review_id % {STREAM_PARTS} * 100 AS INT) AS TIMESTAMP)"
    copies = earlier.EarlierCopies("written", "150 days", f"{state}/copies")

    def run():
        stream = spark.readStream.schema(documents.schema).parquet(f"{path}/part=*")
        reviews = derived(stream, VIEWS["said_again"][0][2]).withColumn("written", F.expr(day))
        moderation.moderate_stream(reviews, output, f"{state}/stream", copies=copies).awaitTermination()

    _in_parts(documents, path, range(STREAM_PARTS), run)
    flagged = spark.read.schema(spam_reasons.flag_reviews(
        view(spark, sf_dir, "said_again")).schema).parquet(f"{output}/batch=*")
    return flagged.select(*_B_COLUMNS)


def spam_statistics_observed(spark, sf_dir):
    """Counted while all reviews are written."""
    flagged, seen = spam_reasons.observed_statistics(_flagged(spark, sf_dir))
    files.write_csv(flagged.select(*_B_COLUMNS), files.staging_path(spark, "counted-csv"))
    return spam_reasons.statistics_of(spark, seen)


def _b_sql(columns, rest="", name="messy", words=10, chars=50, links=fixed.LINK_PATTERN,
           promo=fixed.PROMO_PATTERN, missing="nan", scope="", kept="TRUE", source="p", first=""):
    key = "concat(b, ':', lower(t))"
    first = first or f"min(review_id) OVER (PARTITION BY {key}{scope})"
    return f"""{cte(name)}, p AS (
        SELECT *, trim(coalesce(text, '{missing}'), {SQL_WS}) AS t,
               trim(coalesce(business_name, '{missing}'), {SQL_WS}) AS b FROM {name} WHERE {kept}),
    met AS (SELECT DISTINCT {key} AS k, review_id % {STREAM_PARTS} AS part FROM p),
    gaps AS (SELECT k, part, coalesce(part - lag(part) OVER (PARTITION BY k ORDER BY part) > 2, FALSE) AS anew FROM met),
    chains AS (SELECT k, part, count_if(anew) OVER (PARTITION BY k ORDER BY part) AS chain FROM gaps),
    chained AS (SELECT p.*, chain FROM p JOIN chains ON k = {key} AND part = review_id % {STREAM_PARTS}),
    m AS (SELECT *, {_words('t')} AS word_count, length(t) AS char_count,
        {first} AS first_id FROM {source}),
    f AS (SELECT *, concat_ws('; ',
        CASE WHEN word_count < {words} THEN concat('Too few words (', word_count, ' < {words})') END,
        CASE WHEN char_count < {chars}
             THEN concat('Too few characters (', char_count, ' < {chars})') END,
        CASE WHEN regexp_matches(t, '(?i){links}') THEN 'Contains links' END,
        CASE WHEN regexp_matches(t, '(?i){promo}') THEN 'Promotional content detected' END,
        CASE WHEN first_id <> review_id THEN concat('Duplicate of review #', first_id + 1) END,
        CASE WHEN char_count > 20
             AND length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / char_count > 0.7
             THEN 'Excessive capitalization' END,
        CASE WHEN length(t) - length(replace(t, '!', '')) > 5 THEN 'Excessive punctuation' END
        ) AS spam_reasons FROM m),
    g AS (SELECT *, spam_reasons <> '' AS is_spam FROM f),
    x AS (SELECT review_id, unnest(string_split(spam_reasons, '; ')) AS reason FROM g WHERE is_spam)
    SELECT {columns} FROM {rest or 'g'}"""


_B = ", ".join(_B_COLUMNS)
_REASON_STARTS = {
    "spam_b_min_words": "Too few words", "spam_b_min_chars": "Too few characters",
    "spam_b_links": "Contains links", "spam_b_promo": "Promotional",
    "spam_b_duplicate": "Duplicate", "spam_b_caps": "Excessive cap",
    "spam_b_exclaim": "Excessive punct",
}

_STATISTICS_SQL = _b_sql("""count(*) AS total_reviews,
    count(*) FILTER (is_spam) AS spam_count, count(*) FILTER (NOT is_spam) AS legitimate_count,
    round_even(count(*) FILTER (is_spam) / count(*) * 100 * 10, 0) / 10 AS spam_rate,
    round_even(avg(word_count) * 10, 0) / 10 AS avg_word_count,
    round_even(avg(char_count) * 10, 0) / 10 AS avg_char_count""")

CHECKS = {
    "spam_b_reasons": (spam_b_reasons, _b_sql(
        "review_id, business_name, text, is_spam, spam_reasons, word_count, char_count")),
    "spam_b_plain": (spam_b_plain, _b_sql(_B, name="reviews")),
    "spam_b_custom": (spam_b_custom, _b_sql(
        _B, words=5, chars=20, links=r"(https?://|www\.)", promo=r"(coupon|\d{2}%)", missing="")),
    "spam_b_staged": (spam_b_staged, _b_sql(_B)),
    "review_lengths": (review_lengths, _b_sql("review_id, word_count, char_count")),
    **{name: (_single_rule(start),
              _b_sql("review_id, reason", f"x WHERE starts_with(reason, '{start}')"))
       for name, start in _REASON_STARTS.items()},
    "spam_statistics": (spam_statistics, _STATISTICS_SQL),
    "spam_statistics_observed": (spam_statistics_observed, _STATISTICS_SQL),
    "spam_examples": (spam_examples, _b_sql(
        """review_id, business_name, author_name,
        CASE WHEN length(coalesce(text, 'nan')) > 100 THEN concat(left(text, 100), '...')
             ELSE coalesce(text, 'nan') END AS review, spam_reasons""",
        "g WHERE is_spam ORDER BY review_id LIMIT 5")),
    "spam_reason_counts": (spam_reason_counts, _b_sql(
        r"""regexp_replace(reason, ' (\(\d+ < \d+\)|#\d+)$', '') AS reason, count(*) AS reviews""",
        "x GROUP BY 1")),
    "export_spam": (_export("spam"), _b_sql(_B, "g WHERE is_spam")),
    "export_legitimate": (_export("legitimate"), _b_sql(_B, "g WHERE NOT is_spam")),
    "export_all": (_export("all"), _b_sql(_B)),
    "stream_spam_b": (stream_spam_b, _b_sql(
        _B, scope=f", review_id % {STREAM_PARTS}", kept="review_id < 1000000000")),
    # A key that is away for three parts is forgotten.
    "stream_copies": (stream_copies, _b_sql(
        _B, name="said_again", source="chained", first=f"""first_value(review_id) OVER (
            PARTITION BY concat(b, ':', lower(t)), chain ORDER BY review_id % {STREAM_PARTS}, review_id)""")),
    "spam_a_regex": (spam_a_regex, _a_sql("spam_regex")),
    "spam_a_regex_corrected": (
        spam_a_regex_corrected, _a_sql("spam_regex", fixed.FLAG_PATTERNS_CORRECTED)),
    "spam_a_length": (spam_a_length, _a_sql("spam_length")),
    "spam_a_duplicate": (spam_a_duplicate, _a_sql("spam_duplicate")),
    "spam_a_flags": (spam_a_flags, _a_sql(
        "spam_regex, spam_length, spam_duplicate, "
        "spam_regex OR spam_length OR spam_duplicate AS is_spam")),
}
