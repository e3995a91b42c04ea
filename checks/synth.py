"""Generation planning and response ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import SQL_WS, cte, view
from reviewmill import fixed
from reviewmill.operators import synthesis
from reviewmill.plans import synthesis as synthesis_plans
from reviewmill.sources import files

AS_OF = 1_756_425_600  # 2025-08-29 00:00 UTC


def company_counts(spark, sf_dir):
    return synthesis.company_counts(view(spark, sf_dir, "messy"))


def synth_quota(spark, sf_dir):
    return synthesis.company_quotas(view(spark, sf_dir, "messy"))


def company_first_attrs(spark, sf_dir):
    return synthesis.first_attributes(view(spark, sf_dir, "messy"))


def company_samples(spark, sf_dir):
    return synthesis.company_samples(view(spark, sf_dir, "messy"))


def _work(spark, sf_dir, **options):
    return synthesis.work_list(synthesis.company_plan(view(spark, sf_dir, "messy")), **options)


def synth_worklist(spark, sf_dir):
    return _work(spark, sf_dir).select(
        "request_id", "company_name", "category", "group", "violation_type", "seq")


def synth_worklist_chunked(spark, sf_dir):
    """Chunks of two requests: the path a hot company takes."""
    return _work(spark, sf_dir, chunk=2).select("company_name", "violation_type", "seq")


def synth_prompts(spark, sf_dir):
    return synthesis.prompts(_work(spark, sf_dir))


def policy_dimension(spark, sf_dir):
    """Policies next to the companies they will be written for."""
    named = synthesis.company_quotas(view(spark, sf_dir, "messy"))
    planned = named.withColumn("violation_type", F.explode(F.array(*map(F.lit, fixed.POLICIES))))
    return planned.join(F.broadcast(synthesis.policies(spark)), "violation_type")


def synth_attributes(spark, sf_dir):
    return synthesis.with_attributes(_work(spark, sf_dir), AS_OF).select(
        "request_id", "reviewer_name", "review_date")


def ingest_responses(spark, sf_dir):
    return synthesis.parse_responses(view(spark, sf_dir, "responses")).select(
        "request_id", "review_text", "star_rating", "rejection")


def ingest_quarantine(spark, sf_dir):
    parsed = synthesis.parse_responses(view(spark, sf_dir, "responses"))
    return synthesis.quarantine(parsed).select("request_id", "raw", "rejection")


def _answered(work):
    """The model answers every request but rants, with its samples."""
    answer = F.to_json(F.struct(
        F.concat_ws(" ", "violation_type", "samples").alias("review_text"),
        (F.col("seq") % 7).alias("star_rating")))
    raw = F.when(F.col("violation_type") != "rant_without_visit", answer)
    return work.select("request_id", "seq", raw.alias("raw"))


def _synthetic(spark, sf_dir):
    """The worked-off list."""
    work = _work(spark, sf_dir)
    parsed = synthesis.parse_responses(_answered(work).drop("seq"))
    return synthesis.synthetic_reviews(work, parsed, AS_OF)


def synth_reviews(spark, sf_dir):
    return _synthetic(spark, sf_dir)


def ingest_batches(spark, sf_dir):
    """Answers taken in by two batches, the first of them twice."""
    path, rejected = (files.staging_path(spark, n) for n in ("taken-in", "set-aside"))
    work = files.stage(_work(spark, sf_dir), "work")
    answers = _answered(work)
    for batch in (0, 0, 1):
        synthesis_plans.ingest_responses(
            work, answers.where(f"seq % 2 = {batch}").drop("seq"), path, rejected, AS_OF, str(batch))
    schema = ("company_name string, reviewer_name string, review_date date, text string, stars int, "
              "category string, group string, irrelevant boolean, violation_type string, batch string")
    return files.read_csv(spark, path, schema, multi_line=True)


def violation_summary(spark, sf_dir):
    return synthesis.violation_summary(_synthetic(spark, sf_dir))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_NAMED = f"""{cte('messy')}, named AS (SELECT * FROM messy WHERE company_name IS NOT NULL),
    c AS (SELECT company_name, count(*) AS n_reviews,
        CAST(ceil(count(*) / 2 / 3) AS BIGINT) AS quota FROM named GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY review_id) AS k
        FROM named),
    first AS (SELECT company_name, category, grp FROM r WHERE k = 1),
    lines AS (SELECT company_name, string_agg(concat('- ', left(coalesce(text, ''), 100), '...'),
        chr(10) ORDER BY k) AS samples FROM r WHERE k <= 3 GROUP BY 1),
    policy AS (SELECT * FROM (VALUES {", ".join(
        f"({_text(k)}, {i}, {_text(p['description'])}, {_text(p['example'])}, "
        f"{_text(fixed.PROMPT_POLICY[k])})" for i, (k, p) in enumerate(fixed.POLICIES.items()))})
        t(violation_type, position, description, example, words)),
    work AS (SELECT md5(concat(violation_type, '|', seq, '|', company_name)) AS request_id,
        company_name, category, grp, samples, violation_type, words, seq
        FROM (SELECT *, unnest(range(1, quota + 1)) AS seq FROM c, policy)
        JOIN first USING (company_name) JOIN lines USING (company_name)),
    pick AS (SELECT *, CAST('0x' || left(md5(concat(request_id, '-first')), 8) AS BIGINT) AS h1,
        CAST('0x' || left(md5(concat(request_id, '-last')), 8) AS BIGINT) AS h2,
        CAST('0x' || left(md5(concat(request_id, '-date')), 8) AS BIGINT) AS h3 FROM work),
    who AS (SELECT *, concat({list(fixed.FIRST_NAMES)}[h1 % 15 + 1], ' ',
        {list(fixed.LAST_NAMES)}[h2 % 15 + 1]) AS reviewer_name,
        DATE '1970-01-01' + CAST(floor(({AS_OF} - h3 % 63072001) / 86400) AS INT) AS review_date
        FROM pick),
    answered AS (SELECT * FROM who WHERE violation_type <> 'rant_without_visit')"""

_SYSTEM, _CLOSING = _text(fixed.PROMPT_SYSTEM), _text(fixed.PROMPT_CLOSING)
_CONTEXT = [_text(part) for part in fixed.PROMPT_CONTEXT.split("%s")]

_INGEST = rf"""{cte('responses')},
    found AS (SELECT *, regexp_extract(raw, '(?s)```json\s*(\{{.*?\}})\s*```|(\{{.*?\}})', 1) AS g1,
        regexp_extract(raw, '(?s)```json\s*(\{{.*?\}})\s*```|(\{{.*?\}})', 2) AS g2 FROM responses),
    body AS (SELECT *, CASE WHEN g1 <> '' THEN g1 ELSE g2 END AS body FROM found),
    parsed AS (SELECT *, json_valid(body) AS readable,
        CASE WHEN json_valid(body) THEN json_extract_string(body, '$.review_text') END AS words,
        CASE WHEN json_valid(body) AND json_type(body, '$.star_rating')
                IN ('BIGINT', 'UBIGINT', 'DOUBLE')
            THEN CAST(json_extract_string(body, '$.star_rating') AS DOUBLE) END AS rating
        FROM body),
    judged AS (SELECT *, trim(words, {SQL_WS}) AS t, CASE
        WHEN trim(raw, {SQL_WS}) = '' THEN 'empty response'
        WHEN body = '' THEN 'no JSON object'
        WHEN NOT readable THEN 'not valid JSON'
        WHEN coalesce(words, '') = '' THEN 'no review text'
        WHEN rating IS NULL THEN 'no numeric rating' END AS rejection FROM parsed)"""

CHECKS = {
    "company_counts": (company_counts, f"{_NAMED} SELECT company_name, n_reviews FROM c"),
    "synth_quota": (synth_quota, f"{_NAMED} SELECT company_name, n_reviews, quota FROM c"),
    "company_first_attrs": (company_first_attrs,
                            f'{_NAMED} SELECT company_name, category, grp AS "group" FROM first'),
    "company_samples": (company_samples, f"{_NAMED} SELECT company_name, samples FROM lines"),
    "synth_worklist": (synth_worklist, f"""{_NAMED} SELECT request_id, company_name, category,
        grp AS "group", violation_type, seq FROM work"""),
    "synth_worklist_chunked": (synth_worklist_chunked,
                               f"{_NAMED} SELECT company_name, violation_type, seq FROM work"),
    "policy_dimension": (policy_dimension, f"""{_NAMED} SELECT company_name, n_reviews, quota,
        violation_type, position, description, example FROM c, policy"""),
    "synth_prompts": (synth_prompts, f"""{_NAMED} SELECT request_id, company_name, violation_type,
        seq, concat({_SYSTEM}, chr(10), chr(10), {_CONTEXT[0]}, company_name, {_CONTEXT[1]},
        coalesce(category, 'nan'), {_CONTEXT[2]}, samples, {_CONTEXT[3]}, violation_type,
        {_CONTEXT[4]}, chr(10), chr(10), words, chr(10), chr(10), {_CLOSING}) AS prompt
        FROM work"""),
    "synth_attributes": (synth_attributes,
                         f"{_NAMED} SELECT request_id, reviewer_name, review_date FROM who"),
    "ingest_responses": (ingest_responses, f"""{_INGEST} SELECT request_id,
        CASE WHEN rejection IS NULL THEN CASE
            WHEN (t[1] = '"' AND t[-1] = '"') OR (t[1] = chr(39) AND t[-1] = chr(39))
            THEN substring(t, 2, greatest(length(t) - 2, 0)) ELSE t END END AS review_text,
        CASE WHEN rejection IS NULL
             THEN CAST(floor(greatest(1, least(5, rating))) AS INT) END AS star_rating,
        rejection FROM judged"""),
    "ingest_quarantine": (ingest_quarantine, f"""{_INGEST}
        SELECT request_id, raw, rejection FROM judged WHERE rejection IS NOT NULL"""),
    "synth_reviews": (synth_reviews, f"""{_NAMED} SELECT company_name, reviewer_name, review_date,
        trim(concat(violation_type, ' ', samples), {SQL_WS}) AS text,
        CAST(greatest(1, least(5, seq % 7)) AS INT) AS stars, category, '' AS image_urls,
        '' AS image_captions, grp AS "group", TRUE AS irrelevant, violation_type FROM answered"""),
    "ingest_batches": (ingest_batches, f"""{_NAMED} SELECT company_name, reviewer_name, review_date,
        trim(concat(violation_type, ' ', samples), {SQL_WS}) AS text,
        CAST(greatest(1, least(5, seq % 7)) AS INT) AS stars, category, grp AS "group",
        TRUE AS irrelevant, violation_type, CAST(seq % 2 AS STRING) AS batch FROM answered"""),
    "violation_summary": (violation_summary, f"""{_NAMED} SELECT p.violation_type,
        CASE position WHEN 0 THEN 'Advertisement' WHEN 1 THEN 'Irrelevant Content'
            ELSE 'Rant Without Visit' END AS title,
        count(a.request_id) AS n_reviews
        FROM policy p LEFT JOIN answered a USING (violation_type) GROUP BY ALL"""),
}
