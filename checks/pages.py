"""Extraction from pages and bodies, page plans and request bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import SQL_WS, cte, table, view
from reviewmill import fixed
from reviewmill.functions import markup
from reviewmill.operators import extract, paging


def page_fields(spark, sf_dir):
    return extract.business_pages(view(spark, sf_dir, "business_html")).drop("open_hours")


def page_fields_plain(spark, sf_dir):
    """The driver's pages as they are: they have a heading and none of the other fields."""
    return extract.business_pages(table(spark, sf_dir, "pages")).drop("open_hours")


def page_fields_nested(spark, sf_dir):
    """Labels and values among deeply nested siblings, in front of the pages as they are."""
    return extract.business_pages(view(spark, sf_dir, "nested_html")).withColumn(
        "open_hours", F.concat_ws(" ", F.map_keys("open_hours"), F.map_values("open_hours")))


def page_hours_map(spark, sf_dir):
    return extract.opening_hours(extract.business_pages(view(spark, sf_dir, "business_html")))


def page_joined_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", markup.joined_text(
        F.col("html"), r"<li><a [^>]*>([^<]*)</a>").alias("links"))


def page_meta(spark, sf_dir):
    """Business id where a page has one, null on the pages as they are."""
    with_id = extract.business_ids(view(spark, sf_dir, "business_html"))
    plain = extract.business_ids(table(spark, sf_dir, "pages"))
    return with_id.join(plain.withColumnRenamed("business_id", "absent"), "page_id")


_FEED_EDGE = """struct(struct(
    concat('e', doc_id, '-', i) AS encid,
    struct(line AS full, lang AS language) AS text,
    CAST(1 + i % 5 AS BIGINT) AS rating,
    struct(i AS coolCount, 0 AS funnyCount, n_chars AS usefulCount) AS feedback,
    CASE WHEN i % 2 = 0 THEN struct('a' AS encid, source AS displayName, 3 AS friendCount) END AS author,
    struct('b' AS encid, source AS alias, concat('The ', source) AS name) AS business,
    struct('2024-01-01T00:00:00Z' AS utcDateTime) AS createdAt,
    CASE WHEN i % 3 = 0 THEN array(struct('p' AS encid, struct(concat('u', i) AS url) AS photoUrl,
        lang AS caption, 1 AS helpfulCount),
        struct('q' AS encid, CAST(NULL AS STRUCT<url: STRING>) AS photoUrl,
            CAST(NULL AS STRING) AS caption, CAST(NULL AS INT) AS helpfulCount)) END AS businessPhotos,
    struct(array(struct('Thanks' AS displayText, 'T' AS reactionType, i AS count))
        AS availableReactions) AS availableReactionsContainer) AS node)"""


def _bodies(spark, sf_dir):
    """One review-feed body per document, with a review for each of its lines."""
    lines = table(spark, sf_dir, "documents").withColumn(
        "lines", F.split("text", "\n"))
    edges = f"transform(lines, (line, i) -> {_FEED_EDGE})"

    def bodies(rows, page_id, edges):
        return rows.selectExpr(f"{page_id} AS page_id", f"""to_json(array(struct(struct(struct(
            n_chars AS reviewCount, struct({edges} AS edges) AS reviews) AS business) AS data))) AS body""")

    empty = bodies(lines.where("doc_id % 7 = 0"), "doc_id + 1000000000", f"filter({edges}, x -> FALSE)")
    return bodies(lines, "doc_id", edges).union(empty)


def feed_totals(spark, sf_dir):
    """Totals of all feeds, one in eight without a review in it."""
    return extract.feed_totals(_bodies(spark, sf_dir))


def flatten_reviews(spark, sf_dir):
    return extract.feed_reviews(_bodies(spark, sf_dir)).selectExpr(
        "page_id", "position", "total_reviews", "encid", "text.full AS full",
        "text.language AS language", "rating", "feedback.usefulCount AS useful",
        "author IS NULL AS no_author", "author.displayName AS author_name",
        "author.displayLocation AS author_location", "business.name AS business_name",
        "createdAt AS created_at", "array_size(businessPhotos) AS photos",
        "get(businessPhotos, 0).photoUrl AS photo_url", "get(businessPhotos, 0).caption AS caption",
        "to_json(businessVideos) AS videos",
        "get(availableReactions, 0).count AS reaction_count")


def _script_pages(spark, sf_dir):
    """Pages with an embedded listing script: one kept item and two without a business id."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", """concat(html,
        '<script async data-id="react-root-props">var first = 1; react_root_props = ',
        to_json(struct(struct(struct(struct(
            CASE WHEN page_id % 4 <> 0 THEN struct(page_id AS totalResults) END AS paginationInfo,
            array(
                struct('ad' AS type, CAST(NULL AS STRING) AS bizId,
                    CAST(NULL AS STRUCT<name: STRING, rating: DOUBLE, reviewCount: BIGINT,
                         phone: STRING, alias: STRING>) AS searchResultBusiness),
                struct('biz' AS type, concat('b;', page_id) AS bizId, struct(url AS name,
                    CASE WHEN page_id % 3 <> 0 THEN page_id % 5 + 0.5D END AS rating,
                    page_id AS reviewCount, CAST(NULL AS STRING) AS phone, 'x' AS alias)
                    AS searchResultBusiness),
                struct('biz' AS type, '' AS bizId, struct(url AS name, 1.0D AS rating,
                    1L AS reviewCount, 'p' AS phone, 'y' AS alias) AS searchResultBusiness)
            ) AS mainContentComponentsListProps) AS searchPageProps) AS searchAppProps)
            AS legacyProps)), ';', chr(10), '</script>') AS html""")


def script_json(spark, sf_dir):
    documents = extract.script_documents(_script_pages(spark, sf_dir))
    url = "$.legacyProps.searchAppProps.searchPageProps.mainContentComponentsListProps[1]" \
          ".searchResultBusiness.name"
    return documents.select(
        "page_id", F.try_variant_get("document", url, "string").alias("url"))


def search_listings(spark, sf_dir):
    documents = extract.script_documents(_script_pages(spark, sf_dir))
    return extract.search_listings(documents).select(
        "page_id", "position", "biz_id", "name", "rating", "review_count", "phone", "alias",
        F.try_variant_get("listing", "$.type", "string").alias("kind"))


def search_totals(spark, sf_dir):
    return extract.search_totals(extract.script_documents(_script_pages(spark, sf_dir)))


def _totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars AS total_results")


def _feed_plan(spark, sf_dir, **options):
    totals = feed_totals(spark, sf_dir).selectExpr("page_id AS doc_id", "total_reviews DIV 10 AS total_reviews")
    return paging.review_page_plan(totals, "doc_id", **options)


def review_page_plan(spark, sf_dir):
    return _feed_plan(spark, sf_dir).select("doc_id", "offset")


def review_page_plan_capped(spark, sf_dir):
    return _feed_plan(spark, sf_dir, max_reviews=28).select("doc_id", "offset")


def search_page_plan(spark, sf_dir):
    return paging.search_page_plan(_totals(spark, sf_dir), "doc_id", max_pages=7).select(
        "doc_id", "total_pages", "offset")


def search_urls(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", paging.search_url(
        F.concat("source", F.lit(" ~* & "), "lang"), F.col("text"), F.col("n_chars")).alias("url"))


def page_cursor(spark, sf_dir):
    plan = _feed_plan(spark, sf_dir, max_reviews=28)
    return plan.select("doc_id", "offset", paging.cursor(F.col("offset")).alias("after"))


def request_payloads(spark, sf_dir):
    ids = extract.business_ids(view(spark, sf_dir, "business_html"))
    plan = paging.review_page_plan(
        ids.withColumn("total_reviews", F.col("page_id")), "page_id")
    return paging.request_payloads(plan).select("page_id", "offset", "payload")


# Character references of the pages' headings; a heading may be cut inside one.
_H1 = f"""trim(regexp_replace(replace(replace(replace(replace(
    regexp_extract(html, '<h1[^>]*>([^<]+)', 1),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g'), {SQL_WS})"""
_LINES = """WITH l AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents),
    e AS (SELECT *, lines[i + 1] AS line FROM (
        SELECT *, unnest(range(0, len(lines))) AS i FROM l))"""
_PLAN = """WITH t AS (SELECT doc_id, n_chars AS total_results FROM documents)"""
_FEED_PLAN = """WITH t AS (SELECT doc_id, n_chars // 10 AS total_reviews FROM documents
    UNION ALL SELECT doc_id + 1000000000, n_chars // 10 FROM documents WHERE doc_id % 7 = 0)"""


def _pages_sql(end):
    return f"""SELECT doc_id, CAST(1 AS BIGINT) AS "offset", {end} AS e FROM t
        UNION ALL SELECT doc_id, unnest(range(11, {end}, 10)), {end} FROM t"""


_CURSOR = """to_base64(encode(concat('{"version": 1, "type": "offset", "offset": ', "offset", '}')))"""
_PAYLOAD = f"""concat('[{{"operationName":"{fixed.REQUEST_OPERATION}","variables":{{"encBizId":"biz-',
    page_id, '","reviewsPerPage":10,"selectedReviewEncId":"","hasSelectedReview":false,',
    '"sortBy":"{fixed.REQUEST_SORT}","languageCode":"{fixed.REQUEST_LANGUAGE}","ratings":[5,4,3,2,1],"isSearching":false,"after":"',
    {_CURSOR}, '","isTranslating":false,"translateLanguageCode":"{fixed.REQUEST_LANGUAGE}",',
    '"reactionsSourceFlow":"{fixed.REQUEST_SOURCE_FLOW}","minConfidenceLevel":"{fixed.REQUEST_CONFIDENCE}",',
    '"highlightType":"","highlightIdentifier":"","isHighlighting":false}},',
    '"extensions":{{"operationType":"{fixed.REQUEST_TYPE}","documentId":"{fixed.REQUEST_DOCUMENT}"}}}}]')"""

CHECKS = {
    "page_fields": (page_fields, f"""SELECT page_id, {_H1} AS name,
        split_part(split_part(url, '/', 3), ':', 1) AS website,
        concat('(206) ', 1000 + page_id) AS phone, concat(page_id, ' Queen & King St') AS address,
        concat('/logo/', page_id, '.png') AS logo, 'claimed' AS claim_status FROM pages"""),
    "page_fields_nested": (page_fields_nested, f"""SELECT page_id, {_H1} AS name,
        split_part(split_part(url, '/', 3), ':', 1) AS website,
        concat('(206) ', 1000 + page_id) AS phone, concat(page_id, ' Queen & King St') AS address,
        concat('/logo/', page_id, '.png') AS logo, 'claimed' AS claim_status,
        concat('mon 9:00 - ', 10 + page_id % 12, ':00') AS open_hours FROM pages"""),
    "page_fields_plain": (page_fields_plain, f"""SELECT page_id, {_H1} AS name, '' AS website,
        '' AS phone, '' AS address, '' AS logo, '' AS claim_status FROM pages"""),
    "page_hours_map": (page_hours_map, """SELECT page_id, 'mon' AS day,
        concat('9:00 - ', 10 + page_id % 12, ':00') AS hours FROM pages
        UNION ALL SELECT page_id, 'tue', 'Closed' FROM pages"""),
    "page_joined_text": (page_joined_text, f"""SELECT page_id, lower(trim(array_to_string(
        regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a>', 1), ''), {SQL_WS})) AS links
        FROM pages"""),
    "page_meta": (page_meta, """SELECT page_id, concat('biz-', page_id) AS business_id,
        nullif(regexp_extract(html, '<meta[^>]*name="yelp-biz-id"[^>]*content="([^"]*)"', 1), '')
        AS absent FROM pages"""),
    "flatten_reviews": (flatten_reviews, f"""{_LINES} SELECT doc_id AS page_id, CAST(i AS INT) AS position,
        n_chars AS total_reviews, concat('e', doc_id, '-', i) AS encid, line AS "full",
        lang AS language, 1 + i % 5 AS rating, n_chars AS useful, i % 2 <> 0 AS no_author,
        CASE WHEN i % 2 = 0 THEN source END AS author_name, CAST(NULL AS STRING) AS author_location,
        concat('The ', source) AS business_name, '2024-01-01T00:00:00Z' AS created_at,
        CASE WHEN i % 3 = 0 THEN 2 END AS photos, CASE WHEN i % 3 = 0 THEN concat('u', i) END
        AS photo_url, CASE WHEN i % 3 = 0 THEN lang END AS caption, CAST(NULL AS STRING) AS videos,
        i AS reaction_count FROM e"""),
    "feed_totals": (feed_totals, """SELECT doc_id AS page_id, n_chars AS total_reviews FROM documents
        UNION ALL SELECT doc_id + 1000000000, n_chars FROM documents WHERE doc_id % 7 = 0"""),
    "script_json": (script_json, "SELECT page_id, url FROM pages"),
    "search_listings": (search_listings, """SELECT page_id, 1 AS position,
        concat('b;', page_id) AS biz_id, url AS name,
        CASE WHEN page_id % 3 <> 0 THEN page_id % 5 + CAST(0.5 AS DOUBLE) END AS rating,
        page_id AS review_count, CAST(NULL AS STRING) AS phone, 'x' AS alias, 'biz' AS kind FROM pages"""),
    "search_totals": (search_totals, """SELECT page_id,
        CASE WHEN page_id % 4 <> 0 THEN page_id ELSE 0 END AS total_results FROM pages"""),
    "review_page_plan": (review_page_plan, f"""{_FEED_PLAN} SELECT doc_id, "offset"
        FROM ({_pages_sql('total_reviews')})"""),
    "review_page_plan_capped": (review_page_plan_capped, f"""{_FEED_PLAN} SELECT doc_id, "offset"
        FROM ({_pages_sql('least(total_reviews, 28)')})"""),
    "search_page_plan": (search_page_plan, f"""{_PLAN} SELECT doc_id, e // 10 AS total_pages, "offset"
        FROM ({_pages_sql('CAST(least(ceil(total_results / 10), 7) AS BIGINT) * 10')})"""),
    "search_urls": (search_urls, """SELECT doc_id, concat(
        'https://www.yelp.com/search?find_desc=', replace(url_encode(concat(source, ' ~* & ', lang)),
        '%20', '+'), '&find_loc=', replace(url_encode(text), '%20', '+'), '&start=', n_chars) AS url
        FROM documents"""),
    "page_cursor": (page_cursor, f"""{_FEED_PLAN} SELECT doc_id, "offset", {_CURSOR} AS after
        FROM ({_pages_sql('least(total_reviews, 28)')})"""),
    "request_payloads": (request_payloads, f"""WITH o AS (
        SELECT page_id, CAST(1 AS BIGINT) AS "offset" FROM pages
        UNION ALL SELECT page_id, unnest(range(11, page_id, 10)) FROM pages)
        SELECT page_id, "offset", {_PAYLOAD} AS payload FROM o"""),
}
