"""How the driver's tables become reviews, pages and responses.

The derivations are SQL expressions that Spark and DuckDB both understand, so
each stands here once: as a Spark view and as a common table expression.  Every
row and every text of a source table is kept whole; variants come before, behind or
next to it, in rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewmill.functions.text import WS_CHARS
from reviewmill.sources import files

LABEL = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END"

# View -> (source tables, columns).
_REVIEW = {
    "review_id": "doc_id",
    "business_name": "source",
    "company_name": "source",
    "author_name": "concat('reader ', CAST(n_chars % 89 AS STRING))",
    "category": "lang",
    "grp": "CASE WHEN lang = 'en' THEN 'local' ELSE 'abroad' END",
    "text": "text",
    "stars": "CAST(1 + doc_id % 5 AS INT)",
    "review_date": "CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS DATE)",
}
_MESSY_TEXT = """CASE doc_id % 13
    WHEN 1 THEN upper(replace(text, 'ß', 'ss'))
    WHEN 2 THEN concat(text, ' Use coupon SAVE20 today')
    WHEN 3 THEN concat('See https://', lang, '.example.com/x ', text)
    WHEN 4 THEN concat(text, ' get 50%off!!!!!!')
    WHEN 5 THEN concat('  ', text, chr(9), '  ')
    ELSE text END"""
# Rows of their own, next to some of the documents.
_EXTRA = "doc_id % 13 IN (0, 6, 7, 8, 9)"
_EXTRA_TEXT = """CASE doc_id % 13
    WHEN 0 THEN CAST(NULL AS STRING)
    WHEN 6 THEN 'Great food and service! Would definitely come back.'
    WHEN 7 THEN 'Good'
    WHEN 8 THEN 'GREAT FOOD AND SERVICE! WOULD DEFINITELY COME BACK.'
    ELSE 'n/a' END"""
# JSON string content of a text, nothing left out.
_JSON_TEXT = (
    "replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), "
    "'\"', concat(chr(92), '\"')), chr(10), concat(chr(92), 'n')), chr(9), concat(chr(92), 't'))"
)
_RAW_RESPONSE = f"""CASE (conv_id + turn) % 10
    WHEN 0 THEN concat('{{"review_text": "', {_JSON_TEXT}, '", "star_rating": ',
                       CAST(turn AS STRING), '}}')
    WHEN 1 THEN concat('Sure!', chr(10), '```json', chr(10), '{{"star_rating": 9, "review_text": " ',
                       {_JSON_TEXT}, ' "}}', chr(10), '```')
    WHEN 2 THEN concat('Here it is: {{"review_text": "', {_JSON_TEXT},
                       '", "star_rating": -3}} Anything else?')
    WHEN 3 THEN concat('{{"review_text": "', {_JSON_TEXT}, '", "star_rating": "4"}}')
    WHEN 4 THEN concat('{{"review_text": "', {_JSON_TEXT}, '"}}')
    WHEN 5 THEN text
    WHEN 6 THEN concat('{{"review_text": "', {_JSON_TEXT}, '", "star_rating": 2.7}}')
    WHEN 7 THEN concat('{{"meta": {{"n": 1}}, "review_text": "', {_JSON_TEXT},
                       '", "star_rating": 4}}')
    WHEN 8 THEN concat('{{"review_text": "', chr(39), {_JSON_TEXT}, chr(39),
                       '", "star_rating": 5}}')
    ELSE concat('{{"review_text": "say ', chr(92), '"', {_JSON_TEXT}, chr(92),
                '" {{or}} not", "star_rating": 3}}') END"""
_HOST = "split_part(split_part(url, '/', 3), ':', 1)"
_BUSINESS_HTML = f"""concat(
    '<meta charset="utf-8"><meta content="biz-', CAST(page_id AS STRING), '" name="yelp-biz-id">',
    '<div><p>Business website</p><span>at</span><p><a href="/out">', {_HOST}, '</a></p></div>',
    '<div><p> Phone number </p><p>(206) ', CAST(1000 + page_id AS STRING), '</p></div>',
    '<div><p><a href="/map">Get Directions</a></p><p> ', CAST(page_id AS STRING),
    ' Queen &amp; King St </p></div>',
    '<img class="x businessLogo y" alt="" src="/logo/', CAST(page_id AS STRING), '.png">',
    '<span><span class="claim-icon"></span> Claimed<span class="b"> not this </span></span>',
    '<table><tr><th><p class="day-of-the-week c">Mon</p></th><td><div><p>9:00 - ',
    CAST(10 + page_id % 12 AS STRING), ':00</p></div></td></tr>',
    '<tr><th><p class="day-of-the-week">Tue</p></th><td><p>Closed</p></td></tr></table>', html)"""

# The same fields, labels and values among siblings that are three elements deep and more.
_NESTED_HTML = f"""concat(
    '<main><div><p><b><i>*</i></b>Business website<u>!</u></p><div><ul><li><p>', url, '</p></li></ul></div>',
    '<p>see <b><a>below</a></b></p><p><span><b>to</b></span><a href="/out"><b><i>go</i></b>', {_HOST}, '</a></p></div>',
    '<div><p><span><b>tel</b></span>Phone number<br>of ours</p><div><div><p>no</p><p>no</p></div></div>',
    '<p><em><b>call</b></em>(206) ', CAST(1000 + page_id AS STRING), ' <b>x</b></p></div>',
    '<article><p><b><i>x</i></b><a href="/map"><b><i>pin</i></b>Get Directions</a></p><ul><li><p>no</p></li></ul>',
    '<p><b><u>at</u></b>', CAST(page_id AS STRING), ' Queen &amp; King St</p></article>',
    '<img class="businessLogo" src="/logo/', CAST(page_id AS STRING), '.png">',
    '<div><span><b><i>a</i></b><span class="claim-y"><b><i>no</i></b>no</span><span><u>no</u></span>Claimed</span></div>',
    '<table><tr><th><p class="day-of-the-week">Mon</p></th><td><div><div><p>9:00 - ',
    CAST(10 + page_id % 12 AS STRING), ':00</p></div></div></td></tr></table></main>', html)"""

_MESSY = {
    **_REVIEW, "text": _MESSY_TEXT,
    "business_name": "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE source END",
    "company_name": "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE source END",
    "category": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE lang END",
}
_RESPONSE = {
    "request_id": "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING))",
    "raw": _RAW_RESPONSE,
}
_MESSY_PARTS = [
    ("documents", "TRUE", _MESSY),
    ("documents", _EXTRA, {**_MESSY, "review_id": "doc_id + 1000000000", "text": _EXTRA_TEXT}),
]
VIEWS = {
    "reviews": [("documents", "TRUE", _REVIEW)],
    "messy": _MESSY_PARTS,
    "said_again": [("documents", "TRUE", {
        **_MESSY, "text": f"CASE WHEN {_EXTRA} THEN {_EXTRA_TEXT} ELSE {_MESSY_TEXT} END"})],
    # Labels that the words of a review tell.
    "telling": [(source, kept, {**columns, "label": f"""CASE
        WHEN lower({columns['text']}) LIKE 'great food%' THEN 'praise'
        WHEN {columns['text']} = 'Good' THEN 'brief' ELSE 'other' END"""}) for source, kept, columns in _MESSY_PARTS],
    "labelled": [("documents JOIN labels USING (doc_id)", "TRUE", {**_REVIEW, "label": LABEL})],
    "responses": [
        ("conversations", "TRUE", _RESPONSE),
        ("conversations", "(conv_id + turn) % 10 = 9", {
            "request_id": "concat('blank-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING))",
            "raw": "''"}),
    ],
    "nested_html": [("pages", "TRUE", {"page_id": "page_id", "html": _NESTED_HTML})],
    "business_html": [("pages", "TRUE", {"page_id": "page_id", "url": "url", "html": _BUSINESS_HTML})],
}

# Whitespace set of the operators, for trim() and for a regular expression.
SQL_WS = "'" + WS_CHARS + "'"
SQL_WS_CLASS = "[" + WS_CHARS + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.read_parquet(spark, f"{sf_dir}/{name}.parquet")


def derived(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of a view over rows of its source table."""
    out = rows.selectExpr(*(f"{sql} AS {column}" for column, sql in columns.items()))
    return out.withColumnRenamed("grp", "group")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    out = None
    for source, kept, columns in VIEWS[name]:
        rows = table(spark, sf_dir, source.split()[0]).where(kept)
        if "labels" in source:
            rows = rows.join(table(spark, sf_dir, "labels"), "doc_id")
        part = derived(rows, columns)
        out = part if out is None else out.unionByName(part)
    return out


def cte(*names: str) -> str:
    """WITH clause that defines the views for DuckDB."""
    parts = []
    for name in names:
        chosen = " UNION ALL ".join(
            f"SELECT {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} "
            f"FROM {source} WHERE {kept}" for source, kept, columns in VIEWS[name])
        parts.append(f"{name} AS ({chosen})")
    return "WITH " + ", ".join(parts)
