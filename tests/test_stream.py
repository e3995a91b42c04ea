import datetime

import pytest
from pyspark.sql import functions as F

from checks import spam
from reviewmill.operators import spam_reasons
from reviewmill.streaming import earlier, moderation

DDL = "review_id bigint, business_name string, text string"
TIMED = f"{DDL}, written timestamp"
TEXT = "A long enough review of this place, written with care and no haste at all."


def test_batches_look_for_duplicates_on_their_own(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for batch in ([(0, "b", TEXT), (1, "b", TEXT)], [(2, "b", TEXT)]):
        spark.createDataFrame(batch, DDL).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source)
    moderation.moderate_stream(stream, out, state).awaitTermination()
    got = {r.review_id: (r.spam_reasons, r.batch) for r in spark.read.parquet(out).collect()}
    assert len(got) == 3 and got[2][0] == ""
    assert {got[0][0], got[1][0]} == {"", "Duplicate of review #1"}


def test_stream_equals_batch_and_runs_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(i, f"b{i % 3}", TEXT if i % 2 else "Short!") for i in range(40)], DDL)
    rows.coalesce(1).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(DDL).parquet(source)
        moderation.moderate_stream(stream, out, state).awaitTermination()
    got = {r.review_id: r.spam_reasons for r in spark.read.parquet(out).collect()}
    want = {r.review_id: r.spam_reasons for r in spam_reasons.flag_reviews(rows).collect()}
    assert got == want and spark.read.parquet(out).count() == 40


def day(n):
    return datetime.datetime(2025, 3, 1) + datetime.timedelta(days=n)


class Live:
    """A stream that is fed one file after the other and started anew for each run."""

    def __init__(self, spark, folder, keep="2 days"):
        self.spark, self.folder = spark, folder
        self.copies = earlier.EarlierCopies("written", keep, str(folder / "copies"))

    def feed(self, *rows):
        self.spark.createDataFrame(list(rows), TIMED).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self):
        stream = self.spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        moderation.moderate_stream(stream, str(self.folder / "out"), str(self.folder / "state"),
                                   copies=self.copies).awaitTermination()

    def reasons(self):
        rows = self.spark.read.parquet(str(self.folder / "out")).collect()
        assert len(rows) == len({r.review_id for r in rows})
        return {r.review_id: r.spam_reasons for r in rows}


@pytest.fixture
def live(spark, tmp_path):
    return Live(spark, tmp_path)


def other(n):
    return f"{TEXT} Visit number {n}."


def test_copies_of_earlier_batches_name_the_first(live):
    live.feed((5, "b", TEXT, day(0)), (6, "b", other(1), day(0)))
    live.feed((3, "b", TEXT, day(0)), (7, "b", other(2), day(0)))  # a smaller id that came later
    live.feed((8, "b", TEXT, day(1)), (9, "c", TEXT, day(1)), (10, "b", other(2), day(1)), (11, "b", other(3), None))
    live.run()
    assert live.reasons() == {5: "", 6: "", 3: "Duplicate of review #6", 7: "", 8: "Duplicate of review #6",
                              9: "", 10: "Duplicate of review #8", 11: ""}


def test_state_goes_on_after_a_restart(live):
    live.feed((1, "b", TEXT, day(0)))
    live.run()
    live.feed((2, "b", TEXT, day(0)), (3, "b", TEXT, day(0)))
    live.run()
    live.run()
    assert live.reasons() == {1: "", 2: "Duplicate of review #2", 3: "Duplicate of review #2"}


def test_groups_behind_the_watermark_are_forgotten(live):
    live.feed((1, "b", TEXT, day(0)))
    live.feed((2, "b", TEXT, day(1)), (3, "b", other(1), day(1)))
    live.feed((4, "b", other(2), day(9)))
    live.feed((5, "b", TEXT, day(9)))  # the first again
    live.feed((6, "b", TEXT, day(9)))
    live.feed((7, "b", TEXT, day(1)), (8, "b", TEXT, day(1)))  # late: looked for in its batch
    live.run()
    assert live.reasons() == {1: "", 2: "Duplicate of review #2", 3: "", 4: "", 5: "",
                              6: "Duplicate of review #6", 7: "", 8: "Duplicate of review #8"}


def test_a_batch_that_runs_again_gets_the_same_groups(spark, live):
    def groups(*rows):
        df = spark.createDataFrame(list(rows), TIMED)
        return spam_reasons.group_facts(df, seen_at=F.max("written"))

    def found(rows, batch):
        return sorted((r.first_id, r.copies) for r in earlier.with_earlier(groups(*rows), live.copies, batch).collect())

    first = [(1, "b", TEXT, day(0)), (2, "b", TEXT, day(0)), (3, "b", other(1), day(0))]
    second = [(4, "b", other(1), day(0)), (5, "b", other(2), day(0))]
    for _ in range(2):
        assert found(first, 0) == [(1, 2)]
    for _ in range(2):
        assert found(second, 1) == [(3, 1)]


def test_one_group_of_a_batch_is_one_row_of_state(spark, live):
    rows = [(i, "b", TEXT, day(0)) for i in range(3000)]
    df = spark.createDataFrame(rows, TIMED).repartition(8)
    earlier.with_earlier(spam_reasons.group_facts(df, seen_at=F.max("written")), live.copies, 0)
    assert spark.read.parquet(f"{live.copies.path}/groups").count() == 1


def test_a_part_of_a_stream_comes_in_many_files_and_is_one_batch(spark, tmp_path, monkeypatch):
    """The documents of a part are written by all tasks, not by one."""
    rows = [(i, f"{TEXT} {i % 10}", "en", "web", 80) for i in [*range(200), -3]] + [(None, TEXT, "en", "web", 80)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(spam.files, "staging_path", lambda spark, name: f"{tmp_path}/shared/{name}")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        flagged = spam.stream_spam_b(spark, str(tmp_path))
        got = sorted((r.review_id is None, r.review_id or 0, r.spam_reasons) for r in flagged.collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    files_of = [len(list(p.glob("*.parquet"))) for p in tmp_path.glob("shared/stream-documents/part=*")]
    assert len(files_of) == 7 and max(files_of) == 3
    assert len(list(tmp_path.glob("shared/moderated/batch=*"))) == 7
    assert len(got) == 202
    named = {i: reasons for _, i, reasons in got}
    assert "Duplicate" not in named[5] and "Duplicate of review #6" in named[25]  # copies in their part
