import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from reviewmill.llm import components, queries, simhash

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \t\n", "one", "One TWO", "é É ß", "a b c d", "a b c d", "A B C D", "x " * 5000]


def by_hand(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance):
    """Smallest id reachable, by repeated search over all pairs."""
    least = {i: i for i, _ in prints}
    pairs = [(a, b) for (a, f), (b, g) in itertools.combinations(prints, 2)
             if (f ^ g).bit_count() <= distance]
    while True:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, by_hand(r.text)) for r in docs]
    want = classes(prints, 4)
    got = queries.op6_simhash_near_dedup(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{f:016x}", want[i]) for i, f in prints}
    assert len(set(want.values())) < len(docs)


def test_odd_texts_repeats_and_clashing_columns(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(ODD)] + [(3, "one", "c", 1), (None, "one", "c", 1)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, component_id string, fingerprint int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint % 2**64) for r in got} == {(i, by_hand(t)) for i, t, *_ in rows}
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (None, 3)} == {3}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        {r.component_id for r in got})


def test_one_of_each_group_whatever_the_ids(spark):
    """Rows without an id or with the same one in several groups are told apart."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (1, d), (None, d), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.one_of_each(docs)
    assert sorted(map(str, got.collect())) == sorted(
        str(x) for x in spark.createDataFrame(
            [(None, a), (None, b), (5, c), (1, d), (6, "")], docs.schema).collect())


@pytest.mark.parametrize("groups", [5, 8, 9, 12, None])
def test_links_lose_no_pair(spark, groups):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for f in list(prints):
        for n in range(1, 7):
            prints.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    prints |= {0, 1, 3, 2**64 - 1}
    signed = [f - (f >> 63 << 64) for f in prints]
    frame = spark.createDataFrame([(f,) for f in signed], "fingerprint long")
    got = [(r.a, r.b) for r in simhash.links(frame, 4, groups).collect()]
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2)
            if ((a ^ b) % 2**64).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_cells_stay_small_as_tables_grow():
    """A fingerprint is compared with few others of its cell, whatever the number of fingerprints."""
    chosen = [simhash.groups_for(10 ** n, 4) for n in range(13)]
    assert chosen == sorted(chosen) and chosen[0] == 8 and chosen[-1] > 10
    for n, groups in enumerate(chosen[:11]):
        assert 10 ** n * (3 / 8) ** (32 * (groups - 4) // groups) < 200
    for groups in range(5, 17):
        masks = simhash._dealt(groups)
        assert sum(masks) == 2 ** 64 - 1 and sum(m.bit_count() for m in masks) == 64


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.one_of_each(docs).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(9, 9)]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}


def test_columns_of_any_name(spark):
    rows = [(i, "one two three four five", i, i, "x") for i in range(5)] + [(9, "other words altogether", 9, 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, _leader long, _First string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r._row, r._leader, r._First) for r in kept.collect()} == {(0, 0, 0, "x"), (9, 9, 9, "x")}


def test_copies_are_dealt_out(spark):
    """A third of the rows share a fingerprint; no task of the last join has many more rows than the others."""
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'copy' ELSE concat_ws(' ', 'text', id, id * 7, id * 13, 'end') END AS text")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = simhash.near_duplicates(docs, distance=0, groups=4)
        sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]
        assert found.where("doc_id % 3 = 0 AND component_id = 0").count() == 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cells_are_not_broadcast(spark, capsys):
    """A fingerprint has many cells, which the planner takes for one."""
    few = spark.range(50).toDF("fingerprint")  # of a known size
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 0
    simhash.links(few, 4).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
