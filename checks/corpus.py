"""Sources, sinks, record checks, projections and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import cte, table, view
from reviewmill import fixed, schemas
from reviewmill.operators import corpus, quality
from reviewmill.plans import corpus as corpus_plans
from reviewmill.sources import files

_CELLS = ("review_id", "business_name", "author_name", "text", "stars")
_CELL_SCHEMA = "review_id bigint, business_name string, author_name string, text string, stars int"
_NA = ", ".join(f"'{t}'" for t in fixed.NA_TOKENS)


def _csv_copy(spark, sf_dir, name):
    path = files.staging_path(spark, "reviews-csv")
    files.write_csv(view(spark, sf_dir, name).select(*_CELLS), path)
    return path


def scan_csv(spark, sf_dir):
    """Messy reviews written as CSV and read with missing cells as null."""
    return files.read_csv(spark, _csv_copy(spark, sf_dir, "messy"), _CELL_SCHEMA, multi_line=True)


def csv_roundtrip(spark, sf_dir):
    return files.read_csv(spark, _csv_copy(spark, sf_dir, "reviews"), _CELL_SCHEMA, multi_line=True)


def csv_append(spark, sf_dir):
    """Reviews of two languages written, the others appended."""
    path = files.staging_path(spark, "appended-csv")
    reviews = view(spark, sf_dir, "reviews")
    files.write_csv(reviews.where("category IN ('en', 'de')").select(*_CELLS), path)
    files.write_csv(reviews.where("category NOT IN ('en', 'de')").select(*_CELLS), path, mode="append")
    return files.read_csv(spark, path, _CELL_SCHEMA, multi_line=True)


def csv_batches(spark, sf_dir):
    """Three batches, each written twice, the first time with half of its rows."""
    path = files.staging_path(spark, "batches-csv")
    reviews = view(spark, sf_dir, "reviews").select(*_CELLS)
    for part in range(3):
        rows = reviews.where(f"review_id % 3 = {part}")
        files.write_csv_batch(rows.where("stars < 3"), path, f"b{part}")
        files.write_csv_batch(rows, path, f"b{part}")
    return files.read_csv(spark, path, f"{_CELL_SCHEMA}, batch string", multi_line=True)


def csv_whole_numbers(spark, sf_dir):
    """Numbers with a fraction are no whole numbers, those with a zero one are."""
    path = files.staging_path(spark, "numbers-csv")
    files.write_csv(table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS review_id", "concat(doc_id, CASE doc_id % 3 WHEN 0 THEN '.0' WHEN 1 THEN '.7' "
        "ELSE '' END) AS stars", "text"), path)
    return files.read_csv(spark, path, "review_id bigint, stars int, text string", multi_line=True)


def number_rows(spark, sf_dir):
    """Rows of several files numbered in the order of the files and of the rows in them.

    The files are written in the order of the ids, so each number says how many
    smaller ids there are.
    """
    path = files.staging_path(spark, "numbered")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    documents.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return files.number_rows(files.read_parquet(spark, path), "row_number").select(
        "doc_id", "row_number", F.length("text").alias("n"))


def missing_columns(spark, sf_dir):
    """What the tables lack to be reviews: one row for each table and missing column."""
    reviews = view(spark, sf_dir, "reviews")
    rows = [(name, c) for name, df in (("documents", table(spark, sf_dir, "documents")), ("reviews", reviews))
            for c in quality.missing_columns(df, ["review_id", "text", "stars"])]
    found = spark.createDataFrame(rows, "name string, missing string")
    n_rows = table(spark, sf_dir, "documents").count()
    return found.withColumn("n_rows", F.lit(n_rows).cast("bigint"))


def scan_jsonl(spark, sf_dir):
    path = files.staging_path(spark, "reviews-json")
    files.write_json(view(spark, sf_dir, "messy").select(*_CELLS), path)
    return files.read_json_lines(spark, path, _CELL_SCHEMA)


def scan_json_array(spark, sf_dir):
    """One array document per review, an element per line of its text."""
    element = F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        i.cast("bigint").alias("line"), line.alias("words")))
    path = files.staging_path(spark, "arrays")
    view(spark, sf_dir, "reviews").select(
        F.to_json(F.struct(F.col("review_id"), F.to_json(element).alias("body")))
    ).write.text(path)
    held = files.read_json_lines(spark, path, "review_id bigint, body string")
    return files.explode_json_array(held, "body", "line bigint, words string")


def dataset_shape(spark, sf_dir):
    return quality.shape(view(spark, sf_dir, "reviews"))


def dataset_preview(spark, sf_dir):
    return quality.preview(
        view(spark, sf_dir, "reviews").select("review_id", "company_name", "text"), "review_id")


def dataset_profile(spark, sf_dir):
    return quality.profile(view(spark, sf_dir, "messy"))


def _record(df):
    """A scraped-review record per review, some of them broken by language."""
    photo = F.concat(
        F.lit('{"encid": "p", "photoUrl": "u", "caption": '),
        F.when(F.col("lang") == "de", F.lit("7")).otherwise(F.lit("null")), F.lit("}"))
    whole = F.to_json(F.struct(F.col("text").alias("full"), F.lit("x").alias("unknown")))
    text = F.when(F.col("lang") == "fr", F.concat(F.lit('null, "note": '), whole)).otherwise(whole)
    rating = F.when(F.col("lang") == "es", F.lit('"5"')).otherwise(F.lit("5"))
    return F.when(
        F.col("n_chars") % 10 == 0, F.concat(F.lit("{"), F.col("text"))
    ).otherwise(F.concat(
        F.lit('{"encid": "e", "text": '), text, F.lit(', "rating": '), rating,
        F.lit(', "author": {"encid": "a", "reviewCount": 1.5}, "businessPhotos": ['),
        photo, F.lit(", "), photo, F.lit("]}")))


def validate_records(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    records = documents.select(F.col("doc_id").alias("record_id"), _record(documents).alias("record"))
    return quality.validate_records(records, schemas.REVIEW_CONTRACT)


_VALIDATE_SQL = """WITH good AS (SELECT * FROM documents WHERE n_chars % 10 <> 0)
    SELECT doc_id AS record_id, '$' AS path, 'not valid JSON' AS error
    FROM documents WHERE n_chars % 10 = 0
    UNION ALL SELECT doc_id, '$.text', 'null value not allowed' FROM good WHERE lang = 'fr'
    UNION ALL SELECT doc_id, '$.rating', 'must be of integer type' FROM good WHERE lang = 'es'
    UNION ALL SELECT doc_id, '$.author.reviewCount', 'must be of integer type' FROM good
    UNION ALL SELECT doc_id, concat('$.businessPhotos[', i, '].caption'), 'must be of string type'
    FROM good, (VALUES (0), (1)) t(i) WHERE lang = 'de'"""


def _source(spark, sf_dir, table_name):
    """A raw source file with a column too many."""
    if table_name == "documents":
        df = table(spark, sf_dir, "documents").selectExpr(
            "source AS title", "CAST(1 + doc_id % 5 AS INT) AS stars", "nullif(text, '') AS text",
            "CAST(doc_id AS STRING) AS publishedAtDate", "lang AS extra")
    elif table_name == "conversations":
        df = table(spark, sf_dir, "conversations").selectExpr(
            "role AS title", "CAST(1 + turn % 5 AS INT) AS stars",
            "CASE WHEN role = 'user' THEN text END AS text",
            "CAST(conv_id AS STRING) AS publishedAtDate", "turn AS extra")
    elif table_name == "benchmark":
        df = table(spark, sf_dir, "benchmark").selectExpr(
            "'item' AS title", "3 AS stars", "text",
            "CAST(item_id AS STRING) AS publishedAtDate", "item_id AS extra")
    else:
        df = table(spark, sf_dir, "pages").selectExpr(
            "url AS title", "4 AS stars", "html AS text",
            "CAST(page_id AS STRING) AS publishedAtDate", "page_id AS extra")
    return df


_SOURCE_SQL = {
    "documents": "SELECT source AS company_name, CAST(1 + doc_id % 5 AS INT) AS stars, "
                 "text, CAST(doc_id AS STRING) AS review_date FROM documents",
    "conversations": "SELECT role AS company_name, CAST(1 + turn % 5 AS INT) AS stars, "
                     "CASE WHEN role = 'user' THEN text ELSE '' END AS text, "
                     "CAST(conv_id AS STRING) AS review_date FROM conversations",
    "benchmark": "SELECT 'item' AS company_name, 3 AS stars, text, "
                 "CAST(item_id AS STRING) AS review_date FROM benchmark",
    "pages": "SELECT url AS company_name, 4 AS stars, html AS text, "
             "CAST(page_id AS STRING) AS review_date FROM pages",
}
_CATEGORIES = {"education": "documents", "food and beverages": "conversations",
               "healthcare": "benchmark", "retail": "pages"}


def normalize_source(spark, sf_dir):
    return corpus.normalize_source(_source(spark, sf_dir, "conversations"), "food and beverages")


def ingest_categories(spark, sf_dir):
    return corpus.ingest_categories(
        {c: _source(spark, sf_dir, name) for c, name in _CATEGORIES.items()})


def _fresh(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr(
        "role AS company_name", "text", "concat('c', turn) AS reviewer_name", "turn AS extra")


_OLD_SQL = """WITH old AS (SELECT source AS company_name, text, concat('r', n_chars) AS reviewer_name,
    CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 2 END AS label
    FROM documents LEFT JOIN labels USING (doc_id)),
    fresh AS (SELECT role AS company_name, text, concat('c', turn) AS reviewer_name,
    turn AS extra FROM conversations)"""


def _old(spark, sf_dir):
    """Every document with its label, null where it has none."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 "
                  "WHEN quality = 1 THEN 2 END AS label")
    return documents.join(labels, "doc_id", "left").selectExpr(
        "source AS company_name", "text", "concat('r', n_chars) AS reviewer_name", "label")


def filter_label_nullsafe(spark, sf_dir):
    return corpus.without_label(_old(spark, sf_dir), 1)


def distinct_labels(spark, sf_dir):
    return corpus.distinct_values(_old(spark, sf_dir), "label")


def union_sources(spark, sf_dir):
    return corpus.union_sources([_old(spark, sf_dir), _fresh(spark, sf_dir)])


def replace_label_slice(spark, sf_dir):
    return corpus.replace_label_slice(_old(spark, sf_dir), _fresh(spark, sf_dir), 1)


def label_slice_in_place(spark, sf_dir):
    """One label of a corpus kept by label replaced; the files of the other labels stay."""
    path = files.staging_path(spark, "by-label")
    corpus.write_by_label(_old(spark, sf_dir), path)
    corpus_plans.refresh_label_in_place(spark, path, _fresh(spark, sf_dir), 1)
    found = spark.read.option("mergeSchema", True).parquet(path)
    return found.select("company_name", "text", F.col("label").cast("int").alias("label"), "extra")


_SLICE_SQL = f"""{_OLD_SQL}
    SELECT company_name, text, label, NULL AS extra FROM old WHERE label IS DISTINCT FROM 1
    UNION ALL SELECT company_name, text, 1, extra FROM fresh"""

CHECKS = {
    "scan_csv": (scan_csv, f"""{cte('messy')} SELECT review_id,
        CASE WHEN business_name IN ({_NA}) THEN NULL ELSE business_name END AS business_name,
        author_name, CASE WHEN text IN ({_NA}) THEN NULL ELSE text END AS text, stars FROM messy"""),
    "csv_roundtrip": (csv_roundtrip, f"""{cte('reviews')}
        SELECT review_id, business_name, author_name, text, stars FROM reviews"""),
    "csv_append": (csv_append, f"""{cte('reviews')}
        SELECT review_id, business_name, author_name, text, stars FROM reviews"""),
    "csv_whole_numbers": (csv_whole_numbers, """SELECT doc_id AS review_id,
        CASE WHEN doc_id % 3 <> 1 THEN CAST(doc_id AS INT) END AS stars, text FROM documents"""),
    "number_rows": (number_rows, """SELECT doc_id,
        row_number() OVER (ORDER BY doc_id) - 1 AS row_number, length(text) AS n FROM documents"""),
    "missing_columns": (missing_columns, """SELECT 'documents' AS name, unnest(['review_id', 'stars'])
        AS missing, (SELECT count(*) FROM documents) AS n_rows"""),
    "scan_jsonl": (scan_jsonl, f"""{cte('messy')}
        SELECT review_id, business_name, author_name, text, stars FROM messy"""),
    "scan_json_array": (scan_json_array, f"""{cte('reviews')}, l AS (
        SELECT review_id, string_split(text, chr(10)) AS lines FROM reviews)
        SELECT review_id, CAST(i - 1 AS BIGINT) AS line, lines[i] AS words
        FROM (SELECT review_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)"""),
    "dataset_shape": (dataset_shape, f"""{cte('reviews')}
        SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns FROM reviews"""),
    "dataset_preview": (dataset_preview, f"""{cte('reviews')}
        SELECT review_id, company_name, text FROM reviews ORDER BY review_id LIMIT 5"""),
    "dataset_profile": (dataset_profile, f"""{cte('messy')} SELECT count(*) AS n_rows,
        count(DISTINCT company_name) + max(CASE WHEN company_name IS NULL THEN 1 ELSE 0 END)
        AS n_unique FROM messy"""),
    "validate_records": (validate_records, _VALIDATE_SQL),
    "normalize_source": (normalize_source, "SELECT *, 'food and beverages' AS category "
                                           f"FROM ({_SOURCE_SQL['conversations']})"),
    "ingest_categories": (ingest_categories, " UNION ALL ".join(
        f"SELECT *, '{c}' AS category FROM ({_SOURCE_SQL[name]})"
        for c, name in _CATEGORIES.items())),
    "filter_label_nullsafe": (filter_label_nullsafe,
                              f"{_OLD_SQL} SELECT * FROM old WHERE label IS DISTINCT FROM 1"),
    "distinct_labels": (distinct_labels, f"{_OLD_SQL} SELECT DISTINCT label FROM old"),
    "union_sources": (union_sources,
                      f"{_OLD_SQL} SELECT * FROM old UNION ALL BY NAME SELECT * FROM fresh"),
    "replace_label_slice": (replace_label_slice, _SLICE_SQL),
    "label_slice_in_place": (label_slice_in_place, _SLICE_SQL),
    "csv_batches": (csv_batches, f"""{cte('reviews')} SELECT review_id, business_name, author_name, text, stars,
        concat('b', review_id % 3) AS batch FROM reviews"""),
}
