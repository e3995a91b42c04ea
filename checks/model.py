"""Text features, splits, scoring, stacking, the meta model and its metrics."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.views import LABEL, SQL_WS, SQL_WS_CLASS, cte, table, view
from reviewmill import fixed
from reviewmill.functions import text, vectors
from reviewmill.operators import features, metrics, modelling, stages
from reviewmill.plans import serving, training
from reviewmill.sources import files


def _one(spark, sf_dir, expression, name, source="messy"):
    return view(spark, sf_dir, source).select("review_id", expression.alias(name))


def text_remove_punct(spark, sf_dir):
    return _one(spark, sf_dir, text.remove_punctuation(F.col("text")), "clean")


def text_normalize_ws(spark, sf_dir):
    return _one(spark, sf_dir, text.normalize_whitespace(F.col("text")), "clean")


def text_normalize(spark, sf_dir):
    return _one(spark, sf_dir, text.normalize(F.col("text")), "clean")


def text_tokens(spark, sf_dir):
    return _one(spark, sf_dir, F.explode(text.tokens(F.col("text"))), "token")


def _bits(column):
    return F.array_join(F.col(column).cast("array<int>").cast("array<string>"), "")


def vocab_presence(spark, sf_dir):
    return features.with_presence(view(spark, sf_dir, "messy")).select(
        "review_id", _bits("presence").alias("bits"))


def vocab_doc_freq(spark, sf_dir):
    return features.document_frequency(view(spark, sf_dir, "messy"))


def poi_string(spark, sf_dir):
    return features.with_poi(view(spark, sf_dir, "messy")).select("review_id", "poi")


def model_pairs(spark, sf_dir):
    return features.model_pairs(view(spark, sf_dir, "messy"))


def special_tokens(spark, sf_dir):
    return features.special_tokens(view(spark, sf_dir, "reviews"))


def parse_vectors(spark, sf_dir):
    """Vectors kept as JSON text, one in ten of them broken."""
    raw = table(spark, sf_dir, "documents").selectExpr("doc_id", """CASE
        WHEN n_chars % 10 = 0 THEN 'not a vector'
        ELSE concat('[', n_chars, ', ', n_chars % 7, '.5, 0.25]') END AS tfidf_score""")
    parsed = features.with_parsed_vector(raw, "tfidf_score")
    return parsed.select("doc_id", *(F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(3)))


def class_encode(spark, sf_dir):
    return modelling.class_encode(view(spark, sf_dir, "messy"), "category").select(
        "review_id", "category", "label_id")


def stratified_split(spark, sf_dir):
    return modelling.stratified_split(view(spark, sf_dir, "labelled")).select(
        "review_id", "label", "split")


def hash_split(spark, sf_dir):
    return modelling.hash_split(view(spark, sf_dir, "labelled")).select("review_id", "split")


def toy_model():
    """Stands in for the caller's classifier: three logits from lengths and letters."""
    def predict(texts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        return np.array([
            [len(t) / 1000.0, len(c) / 20.0, t.count("e") / 100.0]
            for t, c in zip(texts, contexts)
        ])
    return predict


def score_batch(spark, sf_dir):
    pairs = features.model_pairs(view(spark, sf_dir, "messy"))
    scored = modelling.with_prediction(
        modelling.with_probabilities(modelling.with_logits(pairs, toy_model)))
    return scored.select("review_id", *(
        F.round(F.get("probs", F.lit(i)), 6).alias(f"p{i}") for i in range(3)), "prediction")


def _logits(spark, sf_dir):
    """Three logits per vector: ten times the largest element of each third."""
    thirds = ("slice(embedding, 1, 21)", "slice(embedding, 22, 21)", "slice(embedding, 43, 22)")
    logits = ", ".join(f"10 * CAST(array_max({t}) AS DOUBLE)" for t in thirds)
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS review_id", f"array({logits}) AS logits", "embedding")


def softmax(spark, sf_dir):
    scored = modelling.with_probabilities(_logits(spark, sf_dir))
    return scored.select("review_id", *(
        F.round(F.get("probs", F.lit(i)), 6).alias(f"p{i}") for i in range(3)))


def argmax(spark, sf_dir):
    return modelling.with_prediction(_logits(spark, sf_dir), "embedding").select(
        "review_id", "prediction")


def stack_features(spark, sf_dir):
    """Vocabulary vectors and probabilities of the same reviews, kept as two tables."""
    reviews = view(spark, sf_dir, "messy")
    words = features.with_presence(reviews).select("review_id", "presence")
    logits = reviews.selectExpr("review_id", """array(length(coalesce(text, '')) / 1000D,
        length(coalesce(category, '')) / 2D, CAST(stars AS DOUBLE)) AS logits""")
    stacked = modelling.stack_features(words, modelling.with_probabilities(logits))
    return stacked.select("review_id", F.posexplode("features").alias("place", "value")).select(
        "review_id", "place", F.round("value", 6).alias("value"))


def _predicted(spark, sf_dir):
    return view(spark, sf_dir, "labelled").selectExpr(
        "review_id", "label", "CAST(length(text) % 3 AS INT) AS prediction")


def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_predicted(spark, sf_dir))


def macro_metrics(spark, sf_dir):
    scores = metrics.macro_metrics(metrics.confusion_matrix(_predicted(spark, sf_dir)))
    return scores.select(*(F.round(c, 6).alias(c) for c in scores.columns))


def classification_report(spark, sf_dir):
    return metrics.classification_report(metrics.confusion_matrix(_predicted(spark, sf_dir)))


def metrics_missing_labels(spark, sf_dir):
    """All documents scored, most of them without a label."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", f"{LABEL} AS label")
    scored = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").selectExpr(
        "label", "CASE WHEN n_chars % 11 <> 0 THEN CAST(length(text) % 3 AS INT) END AS prediction")
    scores = metrics.macro_metrics(metrics.confusion_matrix(scored))
    return scores.select(*(F.round(c, 6).alias(c) for c in scores.columns))


def class_encode_many(spark, sf_dir):
    """As many classes as there are orders."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderkey AS STRING) AS label")
    return modelling.class_encode(orders)


def label_names(spark, sf_dir):
    named = metrics.with_label_name(view(spark, sf_dir, "labelled").select("review_id", "label"))
    return metrics.with_label_id(named, out="label_back")


def train_meta(spark, sf_dir):
    """Gradient of the penalised loss at the coefficients found: 0 at the optimum."""
    rows = files.stage(training.prepared(view(spark, sf_dir, "labelled"), toy_model), "prepared")
    meta = training.fit(rows)
    train = rows.where("split = 'train'")
    n = train.count()
    weights = meta.model.coefficientMatrix.toArray()
    error = F.transform(modelling.vectors.softmax(_decision(meta)), lambda p, c: p - (
        c == F.col("label_id")).cast("double"))
    cells = train.select(F.posexplode(error).alias("class", "error"), "features").select(
        "class", "error", F.posexplode("features").alias("feature", "value"))
    sums = cells.groupBy("class", "feature").agg((F.sum(F.col("error") * F.col("value")) / n).alias("slope"))
    penalty = spark.createDataFrame(
        [(c, f, float(v) / n) for c, row in enumerate(weights) for f, v in enumerate(row)],
        "class int, feature int, penalty double")
    slope = F.abs(F.round(F.col("slope") + F.col("penalty"), 3))
    return sums.join(penalty, ["class", "feature"]).select("class", "feature", slope.alias("gradient"))


def _decision(meta):
    """Scores of the classes, from the coefficients by plain arithmetic."""
    scores = []
    for row, bias in zip(meta.model.coefficientMatrix.toArray(), meta.model.interceptVector.toArray()):
        products = F.zip_with("features", F.lit([float(v) for v in row]), lambda x, w: x * w)
        scores.append(F.aggregate(products, F.lit(float(bias)), lambda a, x: a + x))
    return F.array(*scores)


def _classes(scored):
    return scored.select("review_id", "label_name")


def predict_meta(spark, sf_dir):
    """Classes of the validation rows by the model trained on the others."""
    meta, scored = training.train(view(spark, sf_dir, "telling"), toy_model, exact_split=False)
    return _classes(metrics.with_label_name(scored, "prediction", names=dict(enumerate(meta.classes))))


def predict_scores(spark, sf_dir):
    """Class and probabilities by Spark's model, and by plain arithmetic over its table of coefficients."""
    meta, scored = training.train(view(spark, sf_dir, "telling"), toy_model, exact_split=False)
    model, features = meta.model, scored.select("review_id", "features", "prediction")
    table = spark.createDataFrame(
        [(c, [float(b), *map(float, row)]) for c, (row, b) in enumerate(zip(
            model.coefficientMatrix.toArray(), model.interceptVector.toArray()))],
        "class int, weights array<double>")
    path = files.staging_path(spark, "coefficients")
    table.write.parquet(path)
    cells = features.select("review_id", "prediction", F.posexplode(
        F.concat(F.array(F.lit(1.0)), "features")).alias("place", "value"))
    weights = spark.read.parquet(path).select("class", F.posexplode("weights").alias("place", "weight"))
    sums = cells.join(F.broadcast(weights), "place").groupBy("review_id", "prediction", "class").agg(
        F.sum(F.col("value") * F.col("weight")).alias("score"))
    best = sums.groupBy("review_id", "prediction").agg(F.max_by("class", "score").alias("class"))
    return best.select("review_id", "class", (F.col("class") == F.col("prediction")).alias("same"))


def infer_reviews(spark, sf_dir):
    """Every review classified by the model trained on a part of them."""
    meta, _ = training.train(view(spark, sf_dir, "telling"), toy_model)
    return _classes(training.infer(view(spark, sf_dir, "messy"), toy_model, meta))


def save_load_model(spark, sf_dir):
    """Classes by the saved model."""
    meta, _ = training.train(view(spark, sf_dir, "telling"), toy_model)
    path = files.staging_path(spark, "meta-model")
    modelling.save_model(meta, spark, path)
    return _classes(training.infer(view(spark, sf_dir, "messy"), toy_model, modelling.load_model(spark, path)))


def saved_pipeline(spark, sf_dir):
    """Classes by one saved object that holds the features, both models and the names."""
    path = files.staging_path(spark, "pipeline")
    serving.save_pipeline(serving.train_pipeline(view(spark, sf_dir, "telling"), "checks.model:toy_model"), path)
    classes = _classes(serving.classify(serving.load_pipeline(path), view(spark, sf_dir, "messy")))
    with files.small_batches(spark):  # a Python worker holds a batch of texts, and texts can be long
        return files.stage(classes, "classified")


def evaluate_meta(spark, sf_dir):
    """The report on the exact split; the words tell the label, so all is found."""
    _, scored = training.train(view(spark, sf_dir, "telling"), toy_model)
    return training.evaluate(scored)


def tfidf_weights(spark, sf_dir):
    """Weights of the words that a review holds, by a saved and loaded model."""
    reviews = view(spark, sf_dir, "messy")
    path = files.staging_path(spark, "tfidf")
    stages.TfIdf().fit(reviews).write().save(path)
    weighed = stages.TfIdfModel.load(path).transform(reviews)
    return weighed.select("review_id", F.posexplode(vector_to_array("tfidf")).alias("place", "value")).where(
        "value <> 0").select("review_id", "place", F.round("value", 6).alias("weight"))


def learned_vocabulary(spark, sf_dir):
    words = stages.learned_vocabulary(view(spark, sf_dir, "messy"))
    return spark.createDataFrame(list(enumerate(words)), "word_index int, word string")


_VOCAB = "[" + ", ".join(f"'{w}'" for w in fixed.VOCABULARY) + "]"
_CLASS = fixed.PUNCTUATION.replace("'", "''")
_PUNCT = f"regexp_replace(coalesce(text, ''), '{_CLASS}', '', 'g')"


def _ws(column):
    return f"trim(regexp_replace({column}, '{SQL_WS_CLASS}+', ' ', 'g'), {SQL_WS})"


_TOKENS = f"""{cte('messy')}, n AS (SELECT *, {_ws(f'lower({_PUNCT})')} AS norm FROM messy),
    k AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda w: w <> ''))
        AS toks FROM n)"""
_POI = f"""concat('POI: ', trim(coalesce(company_name, ''), {SQL_WS}), ' [CAT_',
    coalesce(category, 'None'), '] [RATING_', stars, ']')"""
_CLEAN = f"trim(coalesce(text, ''), {SQL_WS})"
_LOGITS = """l AS (SELECT vec_id AS review_id, embedding,
    10 * CAST(list_max(embedding[1:21]) AS DOUBLE) AS z0,
    10 * CAST(list_max(embedding[22:42]) AS DOUBLE) AS z1,
    10 * CAST(list_max(embedding[43:64]) AS DOUBLE) AS z2 FROM embeddings)"""
_SOFTMAX = """, e AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0,
    exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM l),
    s AS (SELECT *, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1,
        round(e2 / (e0 + e1 + e2), 6) AS p2 FROM e)"""
_CM = """
    cm AS (SELECT label, prediction, count(*) AS n FROM q GROUP BY ALL),
    cls AS (SELECT DISTINCT label AS c FROM cm UNION SELECT DISTINCT prediction FROM cm),
    tot AS (SELECT c,
        coalesce((SELECT sum(n) FROM cm WHERE label = c AND prediction = c), 0) AS hits,
        coalesce((SELECT sum(n) FROM cm WHERE label = c), 0) AS support,
        coalesce((SELECT sum(n) FROM cm WHERE prediction = c), 0) AS predicted FROM cls),
    sc AS (SELECT c, hits, support,
        CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p,
        CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r,
        CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f
        FROM tot)"""
_PRED = f"""{cte('labelled')}, q AS (SELECT label, CAST(length(text) % 3 AS INT) AS prediction
    FROM labelled),{_CM}"""
_SCORED = f"""WITH q AS (SELECT * FROM (SELECT CASE WHEN quality IS NULL THEN NULL ELSE {LABEL} END AS label,
    CASE WHEN n_chars % 11 <> 0 THEN CAST(length(text) % 3 AS INT) END AS prediction
    FROM documents LEFT JOIN labels USING (doc_id)) WHERE label IS NOT NULL AND prediction IS NOT NULL),{_CM}"""
_MACRO = """SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(p), 6) AS precision_macro,
    round(avg(r), 6) AS recall_macro, round(avg(f), 6) AS f1_macro FROM sc"""
_HASH = "md5(concat(review_id, '-42'))"
# Validation rows: ceil(0.2 n) in all, by largest remainder, ties in the order of the labels.
def _split(name):
    return f"""{cte(name)}, sizes AS (SELECT label, count(*) AS n FROM {name} GROUP BY label),
    quota AS (SELECT label, floor(0.2 * n) + CASE WHEN row_number() OVER (
            ORDER BY 0.2 * n - floor(0.2 * n) DESC, label NULLS FIRST)
        <= (SELECT ceil(0.2 * sum(n)) - sum(floor(0.2 * n)) FROM sizes) THEN 1 ELSE 0 END AS wanted
        FROM sizes),
    ranked AS (SELECT review_id, label,
        row_number() OVER (PARTITION BY label ORDER BY {_HASH}, review_id) AS k FROM {name}),
    parts AS (SELECT review_id, label, CASE WHEN k <= wanted THEN 'validation' ELSE 'train' END AS split
        FROM ranked JOIN quota USING (label))"""


def _parts(name):
    return f"""{cte(name)}, parts AS (SELECT review_id,
    CASE WHEN CAST('0x' || left({_HASH}, 8) AS BIGINT) / 4294967296.0 < 0.2
         THEN 'validation' ELSE 'train' END AS split FROM {name})"""


_TELLING = f"{cte('telling')} SELECT review_id, label AS label_name FROM telling"

CHECKS = {
    "text_remove_punct": (text_remove_punct,
                          f"{cte('messy')} SELECT review_id, {_PUNCT} AS clean FROM messy"),
    "text_normalize_ws": (text_normalize_ws, f"""{cte('messy')}
        SELECT review_id, {_ws("coalesce(text, '')")} AS clean FROM messy"""),
    "text_normalize": (text_normalize, f"{_TOKENS} SELECT review_id, norm AS clean FROM n"),
    "text_tokens": (text_tokens, f"{_TOKENS} SELECT review_id, unnest(toks) AS token FROM k"),
    "vocab_presence": (vocab_presence, f"""{_TOKENS} SELECT review_id,
        array_to_string(list_transform({_VOCAB}, lambda w:
            CASE WHEN list_contains(toks, w) THEN '1' ELSE '0' END), '') AS bits FROM k"""),
    "vocab_doc_freq": (vocab_doc_freq, f"""{_TOKENS}, v AS (SELECT unnest({_VOCAB}) AS word,
        CAST(unnest(range(0, 150)) AS INT) AS word_index),
        t AS (SELECT unnest(toks) AS word FROM k)
        SELECT word_index, word, count(t.word) AS n_reviews FROM v LEFT JOIN t USING (word)
        GROUP BY ALL"""),
    "poi_string": (poi_string, f"{cte('messy')} SELECT review_id, {_POI} AS poi FROM messy"),
    "model_pairs": (model_pairs, f"""{cte('messy')}
        SELECT review_id, {_CLEAN} AS text, {_POI} AS poi FROM messy"""),
    "special_tokens": (special_tokens, f"""{cte('reviews')}
        SELECT DISTINCT 0 AS kind, category AS value, concat('[CAT_', category, ']') AS token
        FROM reviews UNION ALL
        SELECT 1, CAST(r AS STRING), concat('[RATING_', r, ']') FROM range(1, 6) t(r)"""),
    "parse_vectors": (parse_vectors, """SELECT doc_id,
        CASE WHEN n_chars % 10 <> 0 THEN CAST(n_chars AS DOUBLE) END AS v0,
        CASE WHEN n_chars % 10 <> 0 THEN n_chars % 7 + CAST(0.5 AS DOUBLE) END AS v1,
        CASE WHEN n_chars % 10 <> 0 THEN CAST(0.25 AS DOUBLE) END AS v2 FROM documents"""),
    "class_encode": (class_encode, f"""{cte('messy')}, d AS (
        SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INT) AS label_id
        FROM (SELECT DISTINCT category FROM messy WHERE category IS NOT NULL))
        SELECT review_id, category, label_id FROM messy LEFT JOIN d USING (category)"""),
    "class_encode_many": (class_encode_many, """SELECT o_orderkey, CAST(o_orderkey AS STRING) AS label,
        CAST(row_number() OVER (ORDER BY CAST(o_orderkey AS STRING)) - 1 AS INT) AS label_id FROM orders"""),
    "stratified_split": (stratified_split, f"{_split('labelled')} SELECT review_id, label, split FROM parts"),
    "hash_split": (hash_split, f"{_parts('labelled')} SELECT review_id, split FROM parts"),
    "score_batch": (score_batch, f"""{cte('messy')}, m AS (SELECT review_id, {_CLEAN} AS t,
        {_POI} AS c FROM messy), l AS (SELECT review_id, length(t) / 1000 AS z0,
        length(c) / 20 AS z1, (length(t) - length(replace(t, 'e', ''))) / 100 AS z2 FROM m){_SOFTMAX}
        SELECT review_id, p0, p1, p2, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0
            WHEN z1 >= z2 THEN 1 ELSE 2 END AS prediction FROM s"""),
    "softmax": (softmax, f"WITH {_LOGITS}{_SOFTMAX} SELECT review_id, p0, p1, p2 FROM s"),
    "argmax": (argmax, """SELECT vec_id AS review_id,
        list_position(embedding, list_max(embedding)) - 1 AS prediction FROM embeddings"""),
    "stack_features": (stack_features, f"""{_TOKENS}, l AS (SELECT review_id,
            length(coalesce(text, '')) / 1000 AS z0, length(coalesce(category, '')) / 2 AS z1,
            CAST(stars AS DOUBLE) AS z2 FROM messy){_SOFTMAX},
        w AS (SELECT review_id, list_transform({_VOCAB}, lambda w:
            CASE WHEN list_contains(toks, w) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
            AS ones FROM k)
        SELECT review_id, CAST(unnest(range(0, 153)) AS INT) AS place,
            unnest(list_concat(ones, [p0, p1, p2])) AS value FROM w JOIN s USING (review_id)"""),
    "confusion_matrix": (confusion_matrix, f"{_PRED} SELECT label, prediction, n FROM cm"),
    "macro_metrics": (macro_metrics, f"{_PRED} {_MACRO}"),
    "metrics_missing_labels": (metrics_missing_labels, f"{_SCORED} {_MACRO}"),
    "classification_report": (classification_report, f"""{_PRED}, rep AS (
        SELECT CAST(c AS STRING) AS "row", p, r, f, support FROM sc
        UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support),
            sum(hits) / sum(support), sum(support) FROM sc
        UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM sc
        UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support),
            sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM sc)
        SELECT "row", round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1,
            CAST(support AS BIGINT) AS support FROM rep"""),
    "label_names": (label_names, f"""{cte('labelled')} SELECT review_id, label,
        CASE label WHEN 0 THEN 'spam' WHEN 1 THEN 'irrelevant' ELSE 'relevant' END AS label_name,
        label AS label_back FROM labelled"""),
    "train_meta": (train_meta, f"""{cte('labelled')}, c AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1
        AS INT) AS class FROM (SELECT DISTINCT label FROM labelled))
        SELECT class, CAST(unnest(range(0, 153)) AS INT) AS feature, CAST(0 AS DOUBLE) AS gradient FROM c"""),
    "predict_meta": (predict_meta, f"""{_parts('telling')} SELECT review_id, label AS label_name FROM parts
        JOIN telling USING (review_id) WHERE split = 'validation'"""),
    "predict_scores": (predict_scores, f"""{_parts('telling')}, c AS (SELECT label,
            CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS class FROM (SELECT DISTINCT label FROM telling))
        SELECT review_id, class, TRUE AS same FROM parts JOIN telling USING (review_id) JOIN c USING (label)
        WHERE split = 'validation'"""),
    "evaluate_meta": (evaluate_meta, f"""{_split('telling')}, s AS (SELECT CAST(dense_rank() OVER (ORDER BY label) - 1
            AS STRING) AS "row", split FROM parts),
        v AS (SELECT "row", count(*) AS support FROM s WHERE split = 'validation' GROUP BY "row"),
        r AS (SELECT * FROM v UNION ALL
            SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT CAST(sum(support) AS BIGINT) FROM v))
        SELECT "row", CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1, support FROM r"""),
    "infer_reviews": (infer_reviews, _TELLING),
    "save_load_model": (save_load_model, _TELLING),
    "saved_pipeline": (saved_pipeline, _TELLING),
    "tfidf_weights": (tfidf_weights, f"""{_TOKENS}, said AS (SELECT review_id,
            unnest(list_filter(string_split(norm, ' '), lambda w: w <> '')) AS word FROM n),
        v AS (SELECT unnest({_VOCAB}) AS word, CAST(unnest(range(0, 150)) AS INT) AS place),
        tf AS (SELECT review_id, place, count(*) AS f FROM said JOIN v USING (word) GROUP BY ALL),
        idf AS (SELECT place, ln((1 + (SELECT count(*) FROM messy)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY place),
        w AS (SELECT review_id, place, f * idf AS weight FROM tf JOIN idf USING (place))
        SELECT review_id, place, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY review_id)), 6) AS weight
        FROM w"""),
    "learned_vocabulary": (learned_vocabulary, f"""{_TOKENS}, said AS (SELECT
            unnest(list_filter(string_split(norm, ' '), lambda w: w <> '')) AS word FROM n),
        most AS (SELECT word FROM said GROUP BY word ORDER BY count(*) DESC, word LIMIT 150)
        SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS INT) AS word_index, word FROM most"""),
}
