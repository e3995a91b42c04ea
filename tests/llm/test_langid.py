import random
import zlib

import numpy as np
import pytest

from reviewmill.llm import langid, queries

SF = "/root/testdata/sf0.01"
WORDS = {"ab": "mirelo sanute copira lune vasto".split(), "cd": "krunz schtop wieldt unk bracht".split()}


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 60))), lang)
            for i, lang in enumerate(rng.choices(list(WORDS), k=n))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_query_on_held_out_texts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    for r in got:
        letters = any(c.isalpha() for c in docs[r.doc_id].text or "")
        assert (r.lang_pred == "und") == (not letters)
    judged = [r for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    right = [r.lang_pred == docs[r.doc_id].lang for r in judged]
    assert len(judged) > 100 and sum(right) / len(right) >= 0.99
    assert sum(r.rejected for r in got) < 0.02 * len(got)


def by_hand(model, text):
    """Cosines with every centroid over a dictionary of n-grams."""
    found = langid.counts(text)
    weights = [(1 + np.log(n)) * model.idf[b] if n else 0.0 for b, n in enumerate(found)]
    length = sum(w * w for w in weights) ** 0.5
    return [sum(w * float(c) for w, c in zip(weights, column)) / length for column in model.centroids.T]


def test_nearest_centroid_equals_plain_cosines(spark):
    model = langid.train(frame(spark, corpus()))
    assert set(model.languages) == {"ab", "cd"} and len(model.languages) > 2
    for text in ("mirelo", "Schtop unk!", "lune bracht", "x"):
        cosines = by_hand(model, text)
        best, score = model.nearest(text)
        assert score == pytest.approx(max(cosines)) and cosines[best] == pytest.approx(max(cosines))


def test_ngrams_of_long_texts_across_blocks(monkeypatch):
    text = "Ab, cd  éf\n" * 50
    whole = langid.counts(text)
    words = " " + " ".join(text.lower().replace(",", " ").split()) + " "
    assert whole.sum() == sum(len(words) - n + 1 for n in range(1, 5)) - words.count(" ")
    monkeypatch.setattr(langid, "_BLOCK", 7)
    assert (langid.counts(text) == whole).all()


def test_odd_rows_and_clashing_columns(spark):
    model = langid.train(frame(spark, corpus()))
    rows = [(1, None, 9), (2, "", 9), (3, "12 !?", 9), (4, "mirelo", 9), (4, "mirelo", 9), (None, "schtop", 9),
            (5, "unk " * 100_000, 9), (6, "漢字", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in langid.predict(docs, model).collect()))
    assert [x for x in got if x[0] != 6] == [
        (0, "cd"), (1, "und"), (2, "und"), (3, "und"), (4, "ab"), (4, "ab"), (5, "cd")]
    far = langid.predict(docs.where("doc_id = 6"), model).first()
    assert far.rejected and far.lang_pred == model.languages[0]
    with pytest.raises(ValueError):
        langid.predict(docs, model, keep=("doc_id", "score"))
    assert langid.predict(docs.limit(0), model).count() == 0


def test_no_language_to_learn(spark):
    model = langid.train(frame(spark, [(1, "text", None), (2, None, "ab"), (3, "77", "ab")]))
    assert langid.predict(frame(spark, corpus(3)), model).where("lang_pred <> 'und'").count() == 0


def test_model_does_not_depend_on_the_layout(spark):
    one = langid.train(frame(spark, corpus()).coalesce(1), per_language=15)
    many = langid.train(frame(spark, corpus()[::-1]).repartition(7), per_language=15)
    assert one.languages == many.languages and (one.idf == many.idf).all()
    assert np.allclose(one.centroids, many.centroids)


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.train(frame(spark, corpus()))
