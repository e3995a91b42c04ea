import random

import pytest

from reviewmill.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    at = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    tail = rest[at:]
    return host, tail[:min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]


def by_hand(url, rules, default):
    host, path = split(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("blocks", [1, 6])
def test_nested_rules_equal_brute_force(spark, blocks):
    rng = random.Random(blocks)
    labels = ["a", "b", "com", "net", "x-y", "ü"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", "/ü/", ""]
    rules = {}
    for _ in range(60):
        name = ".".join(rng.choices(labels, k=rng.randint(1, 3)))
        rules[name, rng.choice(paths)] = rng.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in rules.items()]
    some = [None, "", "no scheme", "http://", "http://a.com", "http://a.com?x", "HTTP://A.CoM/A#f",
            "http://a..com/a", "http://.com/", "x://a.com://b.net/a", "http://com/" + "a/" * 3000,
            "http://a.com/\U0010ffffz", "http://" + "b." * 300 + "com/a"] * 2
    for _ in range(150):
        some.append("http://" + ".".join(rng.choices(labels, k=rng.randint(1, 4)))
                    + rng.choice(["", "/", "/a/b/c", "/abc?q", "/ü/x", "/A"]))
    frame = spark.createDataFrame([(i, u, "t") for i, u in enumerate(some)], "id long, url string, rule string")
    table = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("com", None, "block")],
                                  "host string, path string, verdict string")
    got = urls.judge(frame, table, "allow", blocks=blocks, keep=("id",)).collect()
    want = {i: by_hand(u, rules, "allow") for i, u in enumerate(some)}
    assert len(got) == len(some)
    assert {r.id: (r.host, r.path, r.rule, r.verdict) for r in got} == want


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = urls.judge(pages, rules, "block", keep=("id",)).collect()
    assert [tuple(r) for r in got] == [(1, "a.net", "/x", None, "block")]
    assert urls.judge(pages.limit(0), rules).collect() == []
    with pytest.raises(ValueError):
        urls.judge(pages, rules, keep=("host",))


def test_kept_columns_of_any_name(spark):
    pages = spark.createDataFrame([("http://a.net/x", 7, 8)], "url string, best int, Best_ int")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    got = urls.judge(pages, rules, keep=("best", "Best_")).first()
    assert (got["best"], got["Best_"], got["rule"], got["verdict"]) == (7, 8, "net/", "block")
