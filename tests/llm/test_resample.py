import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import queries, resample

SF, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    """Labels of even ids are learned from; clean odd documents stay, junk and toxic ones go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = resample.resample(docs, labels.where("doc_id % 2 = 0"), keep=["doc_id"])
    seen = found.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean = seen[(seen.quality == 1) & (seen.toxic == 0)]
    assert clean._kept.mean() > 0.98
    assert seen[seen.quality == 0]._kept.mean() < 0.5
    assert seen[seen.toxic == 1]._kept.mean() < 0.5


@pytest.mark.parametrize("held", [0, 1])
def test_few_labels(spark, held):
    """A thousand documents, of which two hundred have a label to learn from."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = resample.resample(docs, labels.where(f"doc_id % 2 <> {held}"), keep=["doc_id"])
    seen = found.join(labels.where(f"doc_id % 2 = {held}"), "doc_id").toPandas()
    assert seen[(seen.quality == 1) & (seen.toxic == 0)]._kept.mean() >= 0.96
    assert seen[seen.quality == 0]._kept.mean() < 0.5


def test_the_query_on_a_thousand_documents(spark):
    found = queries.op7_importance_resampling(spark, SMALL).join(
        spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").toPandas()
    clean = (found.quality == 1) & (found.toxic == 0)
    assert found[clean].kept.mean() > 0.98
    assert found[found.quality == 0].kept.mean() < 0.5 and found[found.toxic == 1].kept.mean() < 0.5


MASK, MIX, SECOND = 2 ** 64 - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def crc(text):
    return zlib.crc32(text.encode("utf-8", "replace"))


def plain_buckets(text):
    """Buckets of a text with whole numbers, token by token."""
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    words = [crc(t.lower()) for t in tokens]
    out = {(w * MIX & MASK) >> 47 for w in words}
    out |= {((zlib.crc32(t.lower()[:6].encode("utf-8", "replace") + b"\0") * MIX & MASK) >> 47) + 2 ** 17 for t in tokens}
    for a, b in zip(words, words[1:]):
        out.add((((a * MIX & MASK ^ b * SECOND & MASK) * MIX & MASK) >> 46) + 2 ** 18 + 2 ** 14)
    shapes = [1 if t.isupper() and len(t) > 1 else 2 if t[0].isupper() else 3 if t.islower() else
              4 if t[0].isdigit() else crc(t) | 16 for t in tokens]
    shapes = [5 if i and words[i] == words[i - 1] else s for i, s in enumerate(shapes)]
    for size in (3, 5):
        for i in range(len(shapes) - size + 1):
            run = size
            for s in shapes[i:i + size]:
                run = (run * MIX + s) & MASK
            run ^= run >> 29
            out.add(((run * MIX & MASK) >> 50) + 2 ** 18)
    return out


def test_query_equals_brute_force(spark):
    """Buckets, counts, ratios, weights and the draw, again in plain Python."""
    got = {r.doc_id: r for r in queries.op7_importance_resampling(spark, SMALL).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    sample = {r.doc_id: (r.target, r.fit) for r in resample.labelled_sample(labels, 10**6, "doc_id").collect()}
    assert sum(t and not f for t, f in sample.values()) > 50 and not any(f and not t for t, f in sample.values())
    met = {i: plain_buckets(t) for i, t in docs.items()}
    fit = [i for i in met if i in sample and sample[i][1]]
    raw, target = (Counter(b for i in own for b in met[i]) for own in (met, fit))

    def ratio(b, doubt):
        e = raw[b] * len(fit) / len(met) + 1
        r = math.log((target[b] + 1) / e)
        return r * max(0.0, 1 - doubt / (r * r * e)) if r else 0.0
    def misses(doubt):
        return max(abs(got[i].weight - sum(ratio(b, doubt) for b in own)) for i, own in list(met.items())[:100])
    doubt = min(resample.DOUBTS, key=misses)
    for i, own in met.items():
        assert got[i].weight == pytest.approx(sum(ratio(b, doubt) for b in own), abs=1e-3)
    clean, rest = ([got[i].key for i, (t, f) in sample.items() if i in got and not f and t == want] for want in (True, False))

    def cost(least):
        return 25 * sum(x < least for x in clean) / len(clean) + sum(x >= least for x in rest) / len(rest)
    least = min([-math.inf, *sorted(clean)], key=cost)
    drawn = sum(r.key >= least - 1e-6 for r in got.values())
    best = sorted(got.values(), key=lambda r: -r.key)[:drawn]
    assert {r.doc_id for r in best} == {r.doc_id for r in got.values() if r.kept}


@pytest.mark.parametrize("buckets", [[], [0], [4094], [4095], [4096], [0, 4095, 8190, 540_671], [3, 4, 400_000]])
def test_packed_buckets(buckets):
    found = resample.unpacked(resample.packed(np.array(buckets, np.int64)))
    assert found.tolist() == buckets


def test_gumbel_numbers(spark):
    rows = spark.range(20000).select(resample.gumbel("id", 3).alias("g")).toPandas().g
    assert abs(rows.mean() - 0.5772) < 0.03 and abs(rows.var() - math.pi ** 2 / 6) < 0.08


@pytest.mark.parametrize("k", [0, 1, 500, 1234, 5000, 9000])
def test_kth_largest(spark, k):
    keys = spark.range(5000).select(F.when(F.col("id") < 900, 0.25).otherwise(F.rand(1) * F.col("id")).alias("_key"))
    keys = spark.createDataFrame(keys.collect(), "_key double")
    ordered = sorted((r._key for r in keys.collect()), reverse=True)
    want = math.inf if k == 0 else ordered[min(k, len(ordered)) - 1]
    assert resample.kth_largest(keys, k, bins=10, most=20) == want


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 30000, "c"), (3, "word " * 30000, "c"), (None, "x", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _Buckets string")
    none = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = resample.resample(docs, none).collect()
    assert len(got) == 5 and all(r._kept is True and r._weight == 0 for r in got)
    assert {r._Buckets for r in got} == set("abcd")
    few = resample.resample(docs, none, k=2).collect()
    assert 2 <= sum(r._kept for r in few) <= 3
    assert resample.resample(docs.limit(0), none).collect() == []
    assert resample.resample(docs, none.limit(0), keep=[]).columns == ["doc_id", "_weight", "_key", "_kept"]
    with pytest.raises(ValueError):
        resample.resample(docs.withColumn("_kept", F.lit("mine")), none)


def test_best_cut():
    rng = np.random.default_rng(1)
    clean, rest = rng.normal(0, 1, 1000), rng.normal(-20, 3, 300)
    clean[0] = -50  # a wrong label does not move the cut
    least, cost = resample.best_cut(clean, rest)
    assert cost == pytest.approx(0.025) and (clean < least).sum() == 1 and (rest >= least).sum() == 0
    assert resample.best_cut(clean, clean[:0]) == resample.best_cut(clean[:0], rest) == (-math.inf, 1)
    assert resample.best_cut(clean[:100], clean[100:]) == (-math.inf, 1)  # nothing to tell them by


def test_log_ratios_shrink_by_their_doubt():
    counts = np.zeros((2, resample.BUCKETS + 1))
    counts[:, -1] = 10_000, 5_000
    counts[0, :4], counts[1, :4] = (1000, 1000, 4, 1000), (0, 480, 0, 900)
    ratios = resample.shrunk(*resample.ratios(counts), 14.0)
    gone, more = math.log(1 / 501), math.log(901 / 501)
    assert ratios[0] == pytest.approx(gone - 14 / 501 / gone) and ratios[3] == pytest.approx(more - 14 / 501 / more)
    assert not ratios[1:3].any() and not ratios[4:].any()
