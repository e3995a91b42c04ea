"""The registered queries of this folder, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill.llm import (
    chat, cluster, decontaminate, langid, lm, packing, pages, quality, resample, secrets, simhash, target, urls)
from reviewmill.llm.common import table

#: Fixed values of the URL query: (host, path, verdict).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules, keep=("page_id",))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), held_out=2, folds=7)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", F.col("_weight").alias("weight"), F.col("_key").alias("key"),
                        F.col("_kept").alias("kept"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(table(spark, sf_dir, "conversations"))


def recovered_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with every other role taken away; the model finds them again."""
    rows = table(spark, sf_dir, "conversations")
    return chat.parse(rows.withColumn("role", F.when(F.pmod("turn", F.lit(2)) == F.pmod("conv_id", F.lit(2)), F.col("role"))))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized(table(spark, sf_dir, "documents"))
    digested = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(digested).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of the pages with no mark around them, under a menu and a notice of their host."""
    body = F.regexp_extract("html", "(?s)<article>(.*?)(?:</article>|$)", 1)
    where = urls.host(F.col("url"))
    framed = F.concat(F.lit("<main><div><p>Welcome to "), where, F.lit("</p><ul><li>Home</li><li>Help</li></ul></div>"
                      "<section>All rights with "), where, F.lit("</section><p></p>"), body)
    return pages.main_text(table(spark, sf_dir, "pages").withColumn("html", framed))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"), folds=5)
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).withColumn("held_out", held_out)


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster(table(spark, sf_dir, "embeddings")).drop("point")


QUERIES = {q.__name__: q for q in (
    op1_quality_rules, op2_url_filters, op3_benchmark_decontamination,
    op4_lm_scoring, op5_secret_scans, op6_simhash_near_dedup,
    op7_importance_resampling, op8_chat_formatting, recovered_roles, op9_best_fit_packing, op10_html_extraction,
    site_templates, op11_language_id, op12_target_resampling, op13_centroid_clustering,
)}

def _clustering_sql(clusters: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Each round of the clustering as a table of its own, over all pairs of vector and centroid."""
    parts = [f"""whole AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding,
            lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id)), p) - 1 AS k, p AS c
            FROM whole ORDER BY k LIMIT {clusters})"""]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (SELECT vec_id, place, p, k, list_sum(list_transform(list_zip(p, c),
                lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM whole, c{r}),
            a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY place ORDER BY d, k) = 1)""")
        if r < rounds:
            parts.append(f"""x{r} AS (SELECT k, unnest(p) AS x, unnest(range({size})) AS i FROM a{r}),
                y{r} AS (SELECT k, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM x{r} GROUP BY k, i),
                n{r} AS (SELECT k, list(x ORDER BY i) AS c FROM y{r} GROUP BY k),
                c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (k))""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance,
            CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


#: CRC-32 byte by byte over the distinct words, from a table made by its rule.
_TARGET_SQL = r"""
    WITH RECURSIVE steps AS (SELECT i AS byte, i AS crc, 0 AS bit FROM range(256) t(i) UNION ALL
        SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, bit + 1
        FROM steps WHERE bit < 8),
    crcs AS (SELECT list(crc ORDER BY byte) AS tab FROM steps WHERE bit = 8),
    found AS (SELECT 0 AS side, row_number() OVER () AS place, doc_id, text FROM documents
        UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
    texts AS MATERIALIZED (SELECT side, place, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM found),
    said AS MATERIALIZED (SELECT side, place, unnest(words) AS word FROM texts),
    hexes AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM said),
    hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(
            range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
            lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS INT) + 1])), 4294967295) % 10000 AS bucket FROM hexes, crcs),
    counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
        FROM said JOIN hashed USING (word) GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM counts) + 10000) AS DOUBLE)
        / CAST((s + 1) * ((SELECT sum(t) FROM counts) + 10000) AS DOUBLE))) AS gain FROM counts),
    weights AS (SELECT place, floor(sum(gain) / count(*)) AS weight
        FROM said JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY place),
    scored AS (SELECT doc_id, place, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256(concat('2024:', doc_id)), 8) AS BIGINT)
            + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM texts LEFT JOIN weights USING (place) WHERE side = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, place) AS place_in,
        count(*) FILTER (n_words >= 20) OVER () AS fitting FROM scored)
    SELECT doc_id, n_words, n_words AS n_features, weight, score,
        CASE WHEN n_words >= 20 AND place_in <= fitting * 10 // 100 THEN place_in END AS rank FROM ranked"""

#: The tables mark every article, and hold few kinds of elements and references.
_ARTICLES = r"""
        WITH bodies AS (SELECT page_id, url,
            regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
        blocks AS (SELECT page_id, url, list_filter(list_transform(
            string_split_regex(body, '</?(?:p|h1|div|ul|li)>'), lambda b: trim(regexp_replace(
                regexp_replace(replace(replace(replace(replace(
                    regexp_replace(b, '<[^>]*>?', ' ', 'g'),
                    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g'),
                '\s+', ' ', 'g'))), lambda b: b <> '') AS parts FROM bodies),
        articles AS (SELECT page_id, url, array_to_string(parts, chr(10)) AS text FROM blocks)"""

SQL = {
    "op12_target_resampling": _TARGET_SQL,
    "op13_centroid_clustering": _clustering_sql(),
    "op2_url_filters": r"""
        WITH parts AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules AS (
            SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r (rh, rp, rv)),
        fitting AS (
            SELECT page_id, host, path, rh || rp AS rule, rv,
                   row_number() OVER (PARTITION BY page_id, host, path
                       ORDER BY length(rh || rp) DESC, length(rh) DESC) AS place
            FROM parts JOIN rules
            ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rv, 'allow') AS verdict
        FROM parts p LEFT JOIN fitting f
        ON p.page_id = f.page_id AND p.host = f.host AND p.path = f.path AND f.place = 1""",
    # The tables give every row its role and hold no marker inside a text.
    "op8_chat_formatting": """SELECT conv_id, turn, CAST(0 AS INT) AS piece, role, text,
        concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)) AS rendered FROM conversations""",
    "op10_html_extraction": f"""{_ARTICLES}
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM articles""",
    # The menu and the notice stay where fewer than five articles are different.
    "site_templates": f"""{_ARTICLES},
        hosts AS (SELECT *, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM articles),
        many AS (SELECT host FROM hosts WHERE text <> '' GROUP BY host HAVING count(DISTINCT text) >= 5),
        framed AS (SELECT page_id, url, CASE WHEN host IN (SELECT host FROM many) THEN text ELSE concat('Welcome to ',
            host, chr(10), 'Home', chr(10), 'Help', chr(10), 'All rights with ', host, chr(10), text) END AS text FROM hosts)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM framed""",
}
