import json
from pathlib import Path

import pytest

from reviewmill import fixed, schemas
from reviewmill.operators import corpus, quality
from reviewmill.plans import corpus as corpus_plans
from reviewmill.sources import files

SOURCE = "title string, stars int, text string, publishedAtDate string, extra string"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_normalize_source(spark):
    df = spark.createDataFrame([("Cafe", 5, None, "2025-01-01", "x")], SOURCE)
    out = corpus.normalize_source(df, "retail")
    assert out.columns == ["company_name", "stars", "text", "review_date", "category"]
    assert rows(out, "stars") == [("Cafe", 5, "", "2025-01-01", "retail")]
    with pytest.raises(ValueError, match="publishedAtDate"):
        corpus.normalize_source(df.drop("publishedAtDate"), "retail")


def test_label_filter_keeps_missing_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "label int")
    assert {r[0] for r in corpus.without_label(df, 1).collect()} == {0, 2, None}
    assert corpus.distinct_values(df.union(df), "label").count() == 4


def test_replace_label_slice(spark):
    old = spark.createDataFrame([("a", "n", 0), ("b", "n", 1)], "text string, reviewer_name string, label int")
    fresh = spark.createDataFrame([("c", True)], "text string, irrelevant boolean")
    out = corpus.replace_label_slice(old, fresh, 1)
    assert "reviewer_name" not in out.columns
    assert {(r.text, r.label, r.irrelevant) for r in out.collect()} == {
        ("a", 0, None), ("c", 1, True)}


def test_one_label_is_replaced_in_place(spark, tmp_path):
    path = tmp_path / "corpus"
    old = spark.createDataFrame([("a", "n", 0), ("b", "n", 1), ("c", "n", 1), ("d", "n", None)],
                                "text string, reviewer_name string, label int")
    corpus.write_by_label(old, str(path))

    def parts(label):
        return {f.name: f.stat().st_mtime_ns for f in (path / f"label={label}").glob("*.parquet")}

    def texts():
        return {(r.text, r.label) for r in spark.read.option("mergeSchema", True).parquet(str(path)).collect()}
    before = parts(0), parts("__HIVE_DEFAULT_PARTITION__")
    assert all(before)
    fresh = spark.createDataFrame([("new", True)], "text string, irrelevant boolean")
    corpus_plans.refresh_label_in_place(spark, str(path), fresh, 1)
    assert texts() == {("a", 0), ("new", 1), ("d", None)}
    corpus_plans.refresh_label_in_place(spark, str(path), fresh.limit(0), 1)
    corpus_plans.refresh_label_in_place(spark, str(path), fresh, 2)
    assert texts() == {("a", 0), ("new", 2), ("d", None)}
    assert (parts(0), parts("__HIVE_DEFAULT_PARTITION__")) == before


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "batches")
    rows = spark.createDataFrame([(1, "a\nb"), (2, 'say "x"'), (3, None)], "id int, text string").repartition(2, "id")
    for batch, df in (("one", rows), ("two", rows), ("one", rows.where("id < 3")), ("two", rows)):
        files.write_csv_batch(df, path, batch)
    got = files.read_csv(spark, path, "id int, text string, batch string", multi_line=True).collect()
    assert sorted((r.batch, r.id) for r in got) == [("one", 1), ("one", 2), ("two", 1), ("two", 2), ("two", 3)]
    assert {r.text for r in got} == {"a\nb", 'say "x"', None}
    for part in (tmp_path / "batches").glob("*/*.csv"):
        assert part.read_text().startswith("id,text\n")


def test_ingest_job_prunes_by_category(spark, tmp_path):
    sources = {}
    for name in ("education", "retail"):
        sources[name] = str(tmp_path / name)
        files.write_csv(spark.createDataFrame(
            [(f"{name} co", 4, "fine, \"really\"\nfine", "2025-01-01")], schemas.SOURCE_REVIEW),
            sources[name])
    out = str(tmp_path / "corpus")
    corpus_plans.ingest_csv(spark, sources, out)
    retail = files.read_parquet(spark, out).where("category = 'retail'")
    assert [(r.company_name, r.text) for r in retail.collect()] == [
        ("retail co", "fine, \"really\"\nfine")]
    assert "PartitionFilters: [isnotnull(category" in retail._jdf.queryExecution().toString()


def test_csv_cells_survive(spark, tmp_path):
    cells = [' pad ', 'a,b', 'say "hi"', 'line\nbreak', 'back\\', 'tab\t', "é 😀", 'plain']
    df = spark.createDataFrame(list(enumerate(cells)), "i int, text string")
    path = str(tmp_path / "csv")
    files.write_csv(df, path)
    assert rows(files.read_csv(spark, path, "i int, text string", multi_line=True), "i") == list(enumerate(cells))


def test_csv_missing_tokens(spark, tmp_path):
    df = spark.createDataFrame(
        list(enumerate([*fixed.NA_TOKENS, "na", "none at all"])), "i int, text string")
    path = str(tmp_path / "csv")
    files.write_csv(df, path)
    got = [t for _, t in rows(files.read_csv(spark, path, "i int, text string", multi_line=True), "i")]
    assert got == [None] * len(fixed.NA_TOKENS) + ["na", "none at all"]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "extra,stars,review_date,text,flag\nx,4.0,2025-01-02,hi,True\ny,NA,not a day,n/a,\nz,oops,,w,False\n")
    out = files.read_csv(spark, str(tmp_path / "a.csv"),
                         "text string, stars int, review_date date, flag boolean", multi_line=True)
    assert [(r.text, r.stars, str(r.review_date), r.flag) for r in out.collect()] == [
        ("hi", 4, "2025-01-02", True), (None, None, "None", None), ("w", None, "None", False)]
    with pytest.raises(ValueError, match="label"):
        files.read_csv(spark, str(tmp_path / "a.csv"), "text string, label int", multi_line=True)


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    sizes = [5, 300, 1, 40]
    n = 0
    for i, size in enumerate(sizes):
        lines = [f"{j},t{j}" for j in range(n, n + size)]
        (tmp_path / f"part-{i}.csv").write_text("i,text\n" + "\n".join(lines) + "\n")
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    try:
        for multi_line in (True, False):
            out = files.number_rows(files.read_csv(
                spark, str(tmp_path), "i bigint, text string", multi_line=multi_line))
            got = out.collect()
            assert len(got) == n and all(r.review_id == r.i for r in got)
            assert "Exchange hash" not in out.select("review_id", "text")._jdf.queryExecution() \
                .executedPlan().toString().split("BroadcastExchange")[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbering_agrees_with_line_breaks_and_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i,text\n0,"x\ny, ""z"""\n\n1,\n2\n')
    (tmp_path / "b.csv").write_text('i,text\n3,"\n\n"\n4,last')
    out = files.number_rows(files.read_csv(spark, str(tmp_path), "i bigint, text string", multi_line=True))
    got = rows(out, "review_id")
    assert [r[:2] for r in got] == [(j, j) for j in range(5)]
    assert got[0][2] == 'x\ny, "z"' and got[3][2] == "\n\n"


def test_append_keeps_one_header_per_part(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        files.write_csv(spark.createDataFrame([(i, "x")], "i int, text string"), path, mode="append")
    assert [i for i, _ in rows(files.read_csv(spark, path, "i int, text string", multi_line=True), "i")] == [0, 1, 2]


def test_json_sink_keeps_characters_and_nulls(spark, tmp_path):
    path = tmp_path / "json"
    files.write_json(spark.createDataFrame([("é😀", None)], "a string, b string"), str(path))
    text = "".join(p.read_text("utf-8") for p in path.glob("*.json"))
    assert json.loads(text) == {"a": "é😀", "b": None} and "é😀" in text


def test_json_array_file(spark, tmp_path):
    path = tmp_path / "pages.json"
    path.write_text(json.dumps([
        {"name": "IHOP", "open_hours": {"mon": "Open 24 hours"}}, {"name": "Other"}], indent=2))
    out = files.read_json_array(spark, str(path), schemas.BUSINESS_PAGE)
    got = {r.name: r.open_hours for r in out.collect()}
    assert got == {"IHOP": {"mon": "Open 24 hours"}, "Other": None}


def test_staging_path_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = files.staging_path(spark, "x")
    assert path != files.staging_path(spark, "x")
    if root:
        assert path.startswith(root)


def test_staged_tables_can_be_dropped(spark):
    table = files.stage(spark.range(5), "gone")
    folder = table.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
    assert table.count() == 5 and Path("/" + folder.lstrip("/")).is_dir()
    files.drop_staged(spark, table)
    assert not Path("/" + folder.lstrip("/")).exists()


def test_numbers_with_a_fraction_are_no_whole_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n4.0\n4.7\n-0.5\n-3\n1e2\n9007199254740993\n")
    got = [r.n for r in files.read_csv(spark, str(tmp_path), "n bigint", multi_line=True).collect()]
    assert got == [4, None, None, -3, 100, 9007199254740993]


def test_files_with_another_header_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,author\nt,a\n")
    (tmp_path / "b.csv").write_text("author,text\na,t\n")
    for multi_line in (True, False):
        with pytest.raises(Exception, match="(?i)header"):
            files.read_csv(spark, str(tmp_path), "text string, author string", multi_line=multi_line).collect()


def test_shape_profile_preview(spark):
    df = spark.createDataFrame([(2, "a"), (1, None), (3, "a")], "i int, company_name string")
    assert tuple(quality.shape(df).first()) == (3, 2)
    assert tuple(quality.profile(df).first()) == (3, 2)
    assert tuple(quality.profile(df.where("false")).first()) == (0, 0)
    assert [r.i for r in quality.preview(df, "i", rows=2).collect()] == [1, 2]
    assert quality.missing_columns(df, ["i", "text"]) == ["text"]


RECORDS = [
    ({"encid": "e", "unknown": 1}, []),
    ({"encid": None}, [("$.encid", "null value not allowed")]),
    ({"rating": 4.5, "text": {"full": 1}},
     [("$.rating", "must be of integer type"), ("$.text.full", "must be of string type")]),
    ({"text": "flat"}, [("$.text", "must be of dict type")]),
    ({"businessPhotos": [{"encid": "a", "caption": None}, {"photoUrl": None}, None]},
     [("$.businessPhotos[1].photoUrl", "null value not allowed"),
      ("$.businessPhotos[2]", "null value not allowed")]),
    ({"businessPhotos": {}}, [("$.businessPhotos", "must be of list type")]),
    ([1], [("$", "must be of dict type")]),
]


def test_validate_records(spark):
    data = [(i, json.dumps(record)) for i, (record, _) in enumerate(RECORDS)] + [(99, "{broken")]
    out = quality.validate_records(
        spark.createDataFrame(data, "record_id int, record string"), schemas.REVIEW_CONTRACT)
    got = {}
    for r in out.collect():
        got.setdefault(r.record_id, []).append((r.path, r.error))
    want = {i: v for i, (_, v) in enumerate(RECORDS) if v} | {99: [("$", "not valid JSON")]}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_listing_contract_accepts_whole_numbers_as_floats(spark):
    record = {"bizId": "b", "searchResultBusiness": {
        "rating": 4, "phone": None, "businessAttributes": {"licenses": None}}}
    df = spark.createDataFrame([(1, json.dumps(record))], "record_id int, record string")
    assert quality.validate_records(df, schemas.LISTING_CONTRACT).count() == 0
