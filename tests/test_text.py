import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import samples
from reviewmill import fixed
from reviewmill.functions import text, vectors
from reviewmill.operators import features


def run(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_vocabulary_is_whole():
    assert len(fixed.VOCABULARY) == len(set(fixed.VOCABULARY)) == 150
    assert fixed.VOCABULARY[0] == "the" and fixed.VOCABULARY[-1] == "last"


@pytest.mark.parametrize("column,python", [
    (text.strip, str.strip),
    (text.words, str.split),
    (text.char_count, len),
    (text.uppercase_count, lambda t: sum(map(str.isupper, t))),
    (lambda c: text.occurrences(c, "!"), lambda t: t.count("!")),
    (text.remove_punctuation, lambda t: re.sub(fixed.PUNCTUATION, "", t)),
    (text.normalize_whitespace, lambda t: re.sub(r"\s+", " ", t).strip()),
])
def test_edge_texts_match_python(spark, column, python):
    values = [t for t in samples.EDGE if t is not None]
    values += [a + b for a in values[:12] for b in values[8:20]]
    assert run(spark, values, column(F.col("text"))) == [python(v) for v in values]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn")), max_size=30),
                min_size=1, max_size=40))
def test_random_texts_match_python(spark, values):
    assert run(spark, values, text.words(F.col("text"))) == [v.split() for v in values]
    assert run(spark, values, text.strip(F.col("text"))) == [v.strip() for v in values]


def test_null_text(spark):
    for column in (text.remove_punctuation(F.col("text")), text.normalize(F.col("text"))):
        assert run(spark, [None], column) == [""]


def test_presence(spark):
    """Places of the words that are in a text, worked out by hand."""
    cases = {
        "": [], "The THE the!": [fixed.VOCABULARY.index("the")],
        "thefood": [], "it's the food, really": [fixed.VOCABULARY.index(w) for w in ("the", "food")],
        "The new Spicy Tomato McChicken Set is wonderful for my wallet. "
        "The potato pops also go really well with it.": [0, 6, 8, 9, 13, 15, 34, 63, 88, 126, 145],
    }
    df = spark.createDataFrame(list(enumerate([*cases, None])), "i int, text string")
    got = [r.presence for r in features.with_presence(df).orderBy("i").collect()]
    assert all(len(p) == len(fixed.VOCABULARY) for p in got)
    for places, vector in zip([*cases.values(), []], got):
        found = {i for i, v in enumerate(vector) if v}
        assert set(places) <= found and (len(found) == len(places) or "really" in "".join(cases))


def test_presence_computes_the_hits_once(spark):
    df = spark.createDataFrame([("the",)], "text string")
    plan = features.with_presence(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1


def test_a_filter_on_presence_does_not_search_for_every_word_again(spark):
    df = spark.createDataFrame([("the",), ("qq zz",), (None,)], "text string")
    kept = features.with_presence(df).where(F.array_max("presence") > 0)
    assert [r.text for r in kept.collect()] == ["the"]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "array_contains(array_intersect" not in plan


def test_document_frequency_keeps_absent_words(spark):
    df = spark.createDataFrame([("The the food",), ("food!",), (None,)], "text string")
    got = {r.word: r.n_reviews for r in features.document_frequency(df).collect()}
    assert len(got) == 150 and got["the"] == 1 and got["food"] == 2 and got["bar"] == 0


def test_poi_and_pairs(spark):
    df = spark.createDataFrame(
        [("McDonald's ", "food and beverages", 5, None), (None, None, None, " x ")],
        "company_name string, category string, stars int, text string")
    got = [tuple(r) for r in features.model_pairs(df).collect()]
    assert got == [("", "POI: McDonald's [CAT_food and beverages] [RATING_5]"),
                   ("x", "POI:  [CAT_None] [RATING_None]")]


def test_special_tokens(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "category string")
    assert [r.token for r in features.special_tokens(df).collect()] == [
        "[CAT_a]", "[CAT_b]", "[RATING_1]", "[RATING_2]", "[RATING_3]", "[RATING_4]", "[RATING_5]"]


def test_vectors(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, -5.0],)], "z array<double>")
    p = df.select(vectors.softmax(F.col("z"))).first()[0]
    assert abs(sum(p) - 1) < 1e-12 and p[1] > p[0] > p[2]
    ties = spark.createDataFrame([([1.0, 3.0, 3.0],)], "z array<double>")
    assert ties.select(vectors.argmax(F.col("z"))).first()[0] == 1
    parsed = spark.createDataFrame([("[0.0, 1.5]",), ("oops",)], "s string")
    assert [r[0] for r in parsed.select(vectors.parse_vector(F.col("s"))).collect()] == [
        [0.0, 1.5], None]
