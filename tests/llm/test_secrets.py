import hashlib
import re

from pyspark.sql import functions as F

from reviewmill.llm import queries, secrets

SF = "/root/testdata/sf0.01"
FIRST = "AKIA" + "A" * 16
OPAQUE = "aB3" + "xY7z" * 9
BASE = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
     lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
ODD = [
    None, "", "token", "token=", "token=short1", "token=longenough", "TOKEN : 'abcdefgh'",
    "secret=token:abcdefgh", "é\U0001F600 api_key=\"ABCDEFGH.==\" x", "ApiKey=abcdefgh passwd: abcdefgh",
    "AKIA" + "B" * 11, "AKIA" + "B" * 12, "AKIAAKIA" + "0" * 9, "a" * 31, "a" * 32 + "g" + "0" * 40,
    "password=" + "f" * 40, "token  =  " + "9" * 64 + "\ntoken=abcdefgh" * 300, "ß" * 3 + "token=abcdefgh" * 2,
]


def by_hand(text):
    text = text or ""
    spans = [(m.start(), number, m.end(), kind) for number, (kind, pattern, good) in enumerate(BASE)
             for m in pattern.finditer(text) if good(m)]
    return sorted(spans)


def digest(spans):
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return hashlib.sha256(joined.encode()).hexdigest()


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        spans = by_hand(texts[r.doc_id])
        assert r.base_sha256 == digest(spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(k == kind for *_, k in spans) for kind, *_ in BASE)
        assert all(f"{k}:{a}:{b}" in r.spans.split(",") for a, _, b, k in spans)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_secret_scans(spark, SF).collect()
    check(rows, texts)
    assert sum(r.n_assign for r in rows) > 5


def test_odd_texts(spark, tmp_path):
    folder = str(tmp_path)
    data = [(i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    check(queries.op5_secret_scans(spark, folder).collect(), dict(data))


def kinds(spark, text, reach=200):
    docs = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, spans string")
    (row,) = secrets.scan(docs, reach).collect()
    return [(s.kind, text[s.start:s.end]) for s in row.spans]


def test_weak_parts_need_their_complements(spark):
    assert kinds(spark, f"see {OPAQUE} and https://db.example.com/x") == []
    assert kinds(spark, "user = alice at https://db.example.com/x") == []
    linked = kinds(spark, f"é id {FIRST} key {OPAQUE} at https://db.example.com/x")
    assert linked == [("access", FIRST), ("opaque", OPAQUE), ("endpoint", "https://db.example.com/x")]
    linked = kinds(spark, "user=alice password=wonderland99 on jdbc:mysql://h.example/db")
    assert [k for k, _ in linked] == ["user", "assign", "endpoint"]
    apart = f"{FIRST}{' word' * 100} {OPAQUE}"
    assert kinds(spark, apart) == [("access", FIRST)]
    assert [k for k, _ in kinds(spark, apart, reach=600)] == ["access", "opaque"]


def test_rows_repeats_and_empty_table(spark):
    docs = spark.createDataFrame(
        [(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, "token=abcdefgh"), (2, None)],
        "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.spans)) for r in secrets.scan(docs).collect())
    assert got == [("1", 1), ("1", 1), ("2", 0), ("None", 1)]
    assert secrets.scan(docs.limit(0)).collect() == []


def test_masking(spark):
    texts = {1: f"a é {FIRST} b token=abcdefgh", 2: "plain", 3: None, 4: "", 5: "token=abcdefgh",
             6: "token=" + "a" * 40 + " end", 7: "token=ab AKIA"}
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts.items()] + [(5, texts[5], "k")],
                                 "doc_id long, text string, row string")
    got = secrets.without_secrets(docs)
    assert got.columns == docs.columns
    rows = sorted((r.doc_id, r.text, r.row) for r in got.where(F.col("text").isNotNull()).collect())
    assert rows == [(1, "a é [secret] b [secret]", "k"), (2, "plain", "k"), (4, "", "k"),
                    (5, "[secret]", "k"), (5, "[secret]", "k"), (6, "[secret] end", "k"),
                    (7, "token=ab AKIA", "k")]
    assert got.where(F.col("text").isNull()).count() == 1


def test_columns_of_any_name_and_copies_of_a_text(spark):
    text = "password=abcdefgh1 and more"
    rows = [(i, text if i % 3 else None, "t", "c", 1, 2, 3) for i in range(12)] + [(99, "nothing", "t", "c", 1, 2, 3)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, _text string, _clean string, _row int, _Spans int, _cut int")
    out = secrets.without_secrets(docs.repartition(4))
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 13 and {tuple(r[2:]) for r in got.values()} == {("t", "c", 1, 2, 3)}
    assert {r.text for i, r in got.items() if i % 3 and i < 99} == {"[secret] and more"}
    assert got[0].text is None and got[99].text == "nothing"
