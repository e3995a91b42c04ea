import pytest
from pyspark.sql import functions as F

from reviewmill.llm import pages, queries

SF = "/root/testdata/sf0.01"
CASES = [
    ("", []),
    ("plain  text &amp; more", ["plain text & more"]),
    ("<nav><ul><li>menu</ul></nav><article><h1>T</h1><p>one<br>two<p><b>three</article><footer>f", ["T", "one two", "three"]),
    ("<main><p>a</p><aside>no</aside><div class='comments'><p>no</p></div><p>b</p></main><p>out</p>", ["a", "b"]),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><th>3</table>", ["a", "b", "1", "2", "3"]),
    ("<p>x<script>var a='</p>';</script> y<!-- <p>no</p> --><style>p{}</style></p>", ["x y"]),
    ("<div hidden>no</div><p title='a>b'>q</p><form>no<input value='>'></form>", ["q"]),
    ("<p>cut off <a href=", ["cut off"]),
    ("</div></p></b>a</article>", ["a"]),
    ("a < b && c &lt;i&gt; &#233; &bogus;", ["a < b && c <i> é &bogus;"]),
    ("<div class='ad-box'>no</div><div class='adult'>yes</div><p role=alert>no</p>", ["yes"]),
    ("<article><span class='ad'>no</span>yes<p>a&nbsp;b</p></article>", ["yes", "a b"]),
    ("<article class='comment'>c</article><article>main</article>", ["main"]),
]


@pytest.mark.parametrize("source,want", CASES)
def test_blocks(source, want):
    page = pages.Page(source)
    assert [page.texts[i] for i in page.main_blocks()] == want


WRAPPED = [
    *((f"<nav>menu</nav><div class='{c}'><article><p>story</p></article>by</div>", ["story"])
      for c in ("layout has-sidebar", "no-sidebar", "search-page", "with-navbar", "search", "page sidebar")),
    ("<div class='layout has-sidebar'><p>a</p><div class='left-sidebar'>no</div></div>", ["a"]),
    ("<article><div class='article-header'><h1>T</h1><p>by x</p></div><p>a</p></article>", ["T", "a"]),
    ("<article><header><h1>T</h1><nav><h2>no</h2></nav></header><p>a</p></article>", ["T", "a"]),
    ("<header><h1>site</h1></header><article>a</article>", ["a"]),
    ("<article>a</article><div class='related'><article>teaser</article></div>", ["a"]),
    ("<main><h1>T</h1><div class='search-page'><article>a</article>by</div></main>", ["T", "a"]),
    ("<main><article>a</article><div class='related'><article>teaser</article></div>b</main>", ["a", "b"]),
    ("<div hidden><article>no</article></div><p>a</p>", ["a"]),
]


@pytest.mark.parametrize("source,want", WRAPPED)
def test_articles_in_marked_wrappers(source, want):
    test_blocks(source, want)


def test_articles_in_wrappers_are_no_template(spark):
    rows = [(i, f"http://a.example/{i}", f"<section>Menu<div class='sidebar'><article><p>story {i}</p>"
             "</article></div></section>", "x") for i in range(8)]
    got = pages.main_text(frame(spark, rows)).collect()
    assert sorted(r.text for r in got) == [f"story {i}" for i in range(8)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_templates_of_a_site_go(spark):
    rows = [(i, f"http://a.example/{i}",
             f"<div><p>Welcome to us</p></div><p>story {i}</p><section>All <i>rights</i></section>", "x")
            for i in range(8)]
    rows += [(100 + i, f"http://b.example/{i}", f"<div><p>Welcome to us</p></div><p>tale {i}</p>", "x")
             for i in range(3)]
    rows += [(200, None, None, "x"), (201, "", "", "x"), (202, "http://a.example", "<p>alone</p>", "x")]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in pages.main_text(frame(spark, rows)).collect()}
    assert got[3] == ("http://a.example/3", "story 3", 7)
    assert got[101][1] == "Welcome to us\ntale 1"
    assert got[200] == (None, "", 0) and got[201] == ("", "", 0)
    assert got[202][1] == "alone" and len(got) == len(rows)


def test_prose_of_articles_stays_where_it_recurs(spark):
    box = "<div>Share this</div>"
    rows = [(i, "http://a.example/x", f"<article><p>same words</p><p>tale {i}</p>{box}</article>", "x") for i in range(9)]
    got = {r.page_id: r.text for r in pages.main_text(frame(spark, rows)).collect()}
    assert got == {i: f"same words\ntale {i}" for i in range(9)}


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://a.example/x", "<div><p>one story</p><p>told again</p></div>", "x") for i in range(9)]
    got = pages.main_text(frame(spark, rows)).collect()
    assert [r.text for r in got] == ["one story\ntold again"] * 9


def test_large_templates_go_and_large_parts_of_copies_stay(spark):
    menu = "<div>" + "<p>a long menu of the whole site</p>" * 9 + "</div>"
    rows = [(i, f"http://a.example/{i}", f"{menu}<p>short story {i}</p>", "x") for i in range(8)]
    copy = "<article><p>intro</p><div>most of the story is in here</div></article>"
    rows += [(100 + i, f"http://b.example/{i}", f"<article><p>tale {i}</p></article>", "x") for i in range(15)]
    rows += [(200 + i, f"http://b.example/c{i}", copy, "x") for i in range(5)]
    # Copies under a menu: without both nothing is left of them, so they say nothing.
    rows += [(300 + i, f"http://a.example/c{i}", f"{menu}<div>told again and again</div>", "x") for i in range(5)]
    got = {r.page_id: r.text for r in pages.main_text(frame(spark, rows)).collect()}
    assert [got[i] for i in range(8)] == [f"short story {i}" for i in range(8)]
    assert {got[200 + i] for i in range(5)} == {"intro\nmost of the story is in here"}
    assert {got[300 + i] for i in range(5)} == {"told again and again"}
    assert got[114] == "tale 14"


PAGE = ("<article><h1>T</h1><p>the story</p><ul><li>a</li><li>b</li></ul><table><tr><td>1</td></tr></table>"
        "<div><p>most of the text of this page</p></div></article>")


@pytest.mark.parametrize("source", [PAGE, PAGE.replace("article", "div"), "<p>a</p><div>b</div>"])
@pytest.mark.parametrize("times", [6, 60])
def test_a_page_told_many_times_equals_itself(spark, source, times):
    alone = pages.main_text(frame(spark, [(0, "http://a.example/x", source, "x")])).first().text
    rows = [(i, f"http://a.example/{i}", source, "x") for i in range(times)]
    other = [(100 + i, f"http://a.example/o{i}", f"<article><p>other {i}</p></article>", "x") for i in range(9)]
    got = {r.page_id: r.text for r in pages.main_text(frame(spark, rows + other)).collect()}
    assert {got[i] for i in range(times)} == {alone} and alone.count("\n") >= 1
    assert got[104] == "other 4"


def test_menus_of_sections_and_of_some_pages_go(spark):
    menu = "<div><p>section menu</p><p>more of it</p></div>"
    advert = "<section>Buy now</section>"
    rows = [(i, f"http://a.example/{'en' if i < 12 else 'de'}/{i}",
             f"{menu if i < 6 else ''}{advert if i % 10 == 3 else ''}<p>story {i}</p>", "x") for i in range(80)]
    quoted = [(200 + i, f"http://b.example/{i}", f"<article><p>tale {i}</p>"
               + ("<ul><li>quoted here and there</li></ul>" if i < 6 else "") + "</article>", "x") for i in range(80)]
    got = {r.page_id: r.text for r in pages.main_text(frame(spark, rows + quoted)).collect()}
    assert all(got[i] == f"story {i}" for i in range(80))
    # Inside an article it takes a larger share.
    assert got[203] == "tale 3\nquoted here and there"


def test_switching_templates_off_changes_the_result(spark):
    found = queries.site_templates(spark, SF).where("text LIKE 'Welcome%'").count()
    source = spark.read.parquet(f"{SF}/pages.parquet")
    assert 0 < found < source.count() / 2


def test_a_menu_on_every_page_is_dealt_out(spark):
    rows = [(i, f"http://a.example/{i}", f"<div>menu</div><p>story {i}</p>", "x") for i in range(2000)]
    blocks = pages.parsed(frame(spark, rows), "page_id").withColumn("row", F.col("page_id"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        sizes = [r["count"] for r in pages.recurring(blocks, 5).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2000 and max(sizes) < 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_deep_and_empty(spark):
    rows = [(1, "u://h", "<div>" * 5000 + "deep", "x"), (1, "u://h", "<div>" * 5000 + "deep", "x")]
    assert [r.text for r in pages.main_text(frame(spark, rows)).collect()] == ["deep", "deep"]
    assert pages.main_text(frame(spark, []).limit(0)).collect() == []


def test_query_gives_the_articles(spark):
    import html
    import re

    source = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op10_html_extraction(spark, SF).collect()}
    assert got.keys() == source.keys()
    for number, page in source.items():
        body = re.search(r"<article>(.*?)(?:</article>|$)", page.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", x)).split())
                  for x in re.split(r"</?(?:p|h1|div|ul|li)>", body)]
        want = "\n".join(x for x in blocks if x)
        assert got[number].text == want and got[number].n_chars == len(want)
        assert got[number].url == page.url
