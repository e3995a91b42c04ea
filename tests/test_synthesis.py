import datetime
import math

import pytest

from reviewmill import fixed
from reviewmill.operators import synthesis
from reviewmill.plans import synthesis as synthesis_plans
from reviewmill.sources import files

AS_OF = 1_756_425_600


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(i, "Hot", "retail" if i else None, "g", f"text {i} " + "x" * 200) for i in range(90)]
    rows += [(100 + i, f"c{i}", "food", None, None if i == 0 else "short") for i in range(7)]
    rows += [(200, None, "food", "g", "no company")]
    return spark.createDataFrame(
        rows, "review_id bigint, company_name string, category string, `group` string, text string"
    ).repartition(4, "review_id")


def test_quota(spark, reviews):
    got = {r.company_name: (r.n_reviews, r.quota)
           for r in synthesis.company_quotas(reviews).collect()}
    assert got["Hot"] == (90, 15) and got["c0"] == (1, 1) and None not in got
    sizes = spark.range(1, 200)
    out = sizes.select("id", synthesis.quota(sizes["id"]).alias("q")).collect()
    assert all(r.q == math.ceil(r.id / 2 / 3) for r in out)


def test_first_attributes_keep_a_missing_first_value(reviews):
    got = {r.company_name: (r.category, r.group)
           for r in synthesis.first_attributes(reviews).collect()}
    assert got["Hot"] == (None, "g") and got["c1"] == ("food", None)


def test_samples(reviews):
    samples = synthesis.company_samples(reviews)
    got = {r.company_name: r.samples for r in samples.collect()}
    lines = got["Hot"].split("\n")
    assert len(lines) == 3 and lines[0].startswith("- text 0 ") and len(lines[0]) == 105
    assert got["c0"] == "- ..." and got["c1"] == "- short..."
    assert "WindowGroupLimit" in samples._jdf.queryExecution().toString()


@pytest.mark.parametrize("chunk", [1, 4, 10_000])
def test_work_list(reviews, chunk):
    work = synthesis.work_list(synthesis.company_plan(reviews), chunk).collect()
    assert len(work) == 3 * (15 + 7)
    assert len({r.request_id for r in work}) == len(work)
    hot = sorted(r.seq for r in work
                 if r.company_name == "Hot" and r.violation_type == "advertisement")
    assert hot == list(range(1, 16))


def test_prompts(reviews):
    work = synthesis.work_list(synthesis.company_plan(reviews))
    prompts = {(r.company_name, r.violation_type): r.prompt
               for r in synthesis.prompts(work).collect()}
    ad = prompts["c1", "advertisement"]
    assert ad.startswith(fixed.PROMPT_SYSTEM + "\n\n\nCompany: \"c1\" (a food business)\n")
    assert "\n- short...\n\nVIOLATION TYPE: advertisement\n\n\n\nGenerate a review that contains" in ad
    assert ad.endswith("\n\n" + fixed.PROMPT_CLOSING)
    assert "(a nan business)" in prompts["Hot", "rant_without_visit"]
    assert "clearly has never actually visited" in prompts["Hot", "rant_without_visit"]


def test_attributes_are_repeatable_and_in_range(reviews):
    work = synthesis.work_list(synthesis.company_plan(reviews))
    first = synthesis.with_attributes(work, AS_OF).orderBy("request_id").collect()
    again = synthesis.with_attributes(work.repartition(3), AS_OF).orderBy("request_id").collect()
    assert [(r.reviewer_name, r.review_date) for r in first] == [
        (r.reviewer_name, r.review_date) for r in again]
    last = datetime.date(2025, 8, 29)
    for r in first:
        name, surname = r.reviewer_name.split(" ")
        assert name in fixed.FIRST_NAMES and surname in fixed.LAST_NAMES
        assert last - datetime.timedelta(days=730) <= r.review_date <= last


RESPONSES = [
    ('{"review_text": "ok", "star_rating": 4}', ("ok", 4, None)),
    ('Sure:\n```json\n{"review_text": " a\\nb ", "star_rating": 9}\n```', ("a\nb", 5, None)),
    ('x {"star_rating": 0, "review_text": "\\"quoted\\""} y', ("quoted", 1, None)),
    ('{"review_text": "\'q\'", "star_rating": 2.7}', ("q", 2, None)),
    ('{"review_text": "\\"", "star_rating": 1e30}', ("", 5, None)),
    ('{"review_text": "half\\"", "star_rating": -0.5}', ('half"', 1, None)),
    ('{"review_text": 12, "star_rating": 3}', ("12", 3, None)),
    ('{"review_text": "t", "star_rating": "4"}', (None, None, "no numeric rating")),
    ('{"review_text": "t", "star_rating": null}', (None, None, "no numeric rating")),
    ('{"review_text": "t", "star_rating": NaN}', (None, None, "no numeric rating")),
    ('{"star_rating": 3}', (None, None, "no review text")),
    ('{"review_text": "", "star_rating": 3}', (None, None, "no review text")),
    ("just words", (None, None, "no JSON object")),
    ('{"a": {"b": 1}, "review_text": "t", "star_rating": 3}', (None, None, "not valid JSON")),
    ("{'review_text': 't', 'star_rating': 3}", (None, None, "not valid JSON")),
    ("  ", (None, None, "empty response")),
    (None, (None, None, "empty response")),
]


def test_parse_responses(spark):
    df = spark.createDataFrame(
        [(i, raw) for i, (raw, _) in enumerate(RESPONSES)], "request_id int, raw string")
    got = synthesis.parse_responses(df).orderBy("request_id").collect()
    assert [(r.review_text, r.star_rating, r.rejection is None) for r in got] == [
        (t, s, e is None) for _, (t, s, e) in RESPONSES]
    named = [(r.rejection, want[2]) for r, (_, want) in zip(got, RESPONSES) if "NaN" not in str(r.raw)]
    assert all(a == b for a, b in named)
    assert synthesis.quarantine(synthesis.parse_responses(df)).count() == 10


def test_jobs(spark, reviews, tmp_path):
    full = reviews.selectExpr(
        "*", "'n' AS reviewer_name", "DATE '2025-01-01' AS review_date", "5 AS stars",
        "'' AS image_urls", "'' AS image_captions")
    synthesis_plans.write_requests(full, str(tmp_path / "requests"))
    requests = spark.read.parquet(str(tmp_path / "requests"))
    responses = requests.selectExpr("request_id", """CASE WHEN violation_type = 'advertisement'
        THEN '{"review_text": "Buy", "star_rating": 5}' ELSE 'no' END AS raw""")
    for _ in range(2):  # taken in again, as after a failure
        summary = synthesis_plans.ingest_responses(
            requests, responses, str(tmp_path / "out"), str(tmp_path / "bad"), AS_OF, "monday")
    assert {(r.title, r.n_reviews) for r in summary.collect()} == {
        ("Advertisement", 22), ("Irrelevant Content", 0), ("Rant Without Visit", 0)}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 44
    synthesis_plans.ingest_responses(
        requests, responses.limit(0), str(tmp_path / "out"), str(tmp_path / "bad"), AS_OF, "tuesday")
    written = files.read_csv(spark, str(tmp_path / "out"), "company_name string, stars int, batch string",
                             multi_line=True)
    assert {(r.batch, r.stars) for r in written.collect()} == {("monday", 5)} and written.count() == 22
    with pytest.raises(ValueError, match="stars"):
        synthesis_plans.write_requests(full.drop("stars"), str(tmp_path / "x"))
