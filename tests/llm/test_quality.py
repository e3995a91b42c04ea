import re

import numpy as np

from reviewmill.llm import quality, queries

SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n\x0b\x0c\r", "a", "a b c d e a b c d e", "x x x x x x x", "l\nl\n\n \nl\n é é",
       "\U0001F600#*$%&|<>", "\xa0 \x85 a", "w " * 20000, "a b c d e f " * 3 + "g"]


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def rows_match(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n, *_, repeated = got = tuple(r[c] for c in quality.COUNTS)
        assert got == by_hand(texts[r.doc_id])
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows_match(queries.op1_quality_rules(spark, SF_SMALL).collect(), texts)


def test_odd_texts_without_labels(spark):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(ODD)],
                                 "doc_id long, text string, n_words int, kept string")
    labels = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    rows_match(quality.judge(docs, labels).collect(), dict(enumerate(ODD)))
    assert quality.judge(docs.limit(0), labels).collect() == []
    twice = quality.judge(docs.unionAll(docs), labels.limit(0)).collect()
    assert len(twice) == 2 * len(ODD)


def test_held_out_documents(spark):
    """Rules learned on even ids judge the odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    verdicts = quality.judge(docs, labels.where("doc_id % 2 = 0"))
    seen = verdicts.join(labels.where("doc_id % 2 = 1"), "doc_id").where("n_words >= 10").toPandas()
    good, bad = seen[seen.quality == 1], seen[seen.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.1


def test_rules_cover_a_planted_conjunction(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random(3000), rng.random(3000)
    bad = (x > 0.7) & (y <= 0.4) | (y > 0.95)
    rules = quality.learn({"x": x, "y": y}, bad, np.arange(3000) % 3, steps=200)
    held = np.zeros(3000, bool)
    for rule in rules:
        held |= quality._covers(rule, {"x": x, "y": y}, 3000)
    assert (held == bad).mean() > 0.97 and len(rules) >= 2
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:300], y[:300])], "x double, y double")
    numbers = [r.n for r in frame.select(quality.expression(rules).alias("n")).collect()]
    assert [n > 0 for n in numbers] == held[:300].tolist()
    assert quality.learn({"x": x}, np.zeros(3000, bool), np.arange(3000) % 3) == []


def test_implied_conditions_are_left_out():
    c = quality.Condition
    rule = (c("x", False, 0.62), c("y", True, 3.0), c("x", False, 0.53), c("y", True, 2.0), c("x", True, 0.1),
            c("x", False, 0.53))
    assert quality._tightest(rule) == (c("y", True, 3.0), c("x", False, 0.53), c("x", True, 0.1))
    rng = np.random.default_rng(2)
    columns = {"x": rng.random(500), "y": rng.random(500) * 5}
    assert (quality._covers(rule, columns, 500) == quality._covers(quality._tightest(rule), columns, 500)).all()
