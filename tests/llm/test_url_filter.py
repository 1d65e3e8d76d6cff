import re

from fairlead.llm import url_filter as u


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://WWW.Example.com/en/1?q#f", "https://example.com/en/2", "https://a.example.com/en/", "http://x.com", "http://x.com/", "http://q.net/es/1",
            "http://net/fr/", "http://anet/fr/", "no scheme", None, "", "http://x.org?a://b/c", "x://y.com#/", "a://b://c/d"]
    found = {r.page_id: r for r in u.judge(pages(spark, urls)).collect()}
    got = [(found[k].host, found[k].path, found[k].rule) for k in range(len(urls))]
    assert got == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("example.com", "/en/2", "example.com/en/"), ("a.example.com", "/en/", "example.com/en/"),
        ("x.com", "", None), ("x.com", "/", "com/"), ("q.net", "/es/1", "net/es/"), ("net", "/fr/", "net/fr/"), ("anet", "/fr/", None),
        ("", "", None), ("", "", None), ("", "", None), ("x.org", "", None), ("y.com", "", None), ("b:", "//c/d", None),
    ]
    assert {r.verdict for r in found.values()} <= {"allow", "block"}


def test_the_models_separate_held_out_urls(spark):
    good = [f"http://{w}{k}.com/{w}/page" for k in range(60) for w in ("garden", "river", "meadow")]
    bad = [f"http://{w}{k}.net/es/{w}" for k in range(60) for w in ("casino", "pokies", "jackpot")]
    fresh = {"http://rivergarden.org/meadow": "allow", "http://casinopokies.org/jackpot": "block", "http://garden.io/river": "allow", "http://jackpot.io/casino": "block"}
    df = pages(spark, good + bad + list(fresh))
    found = {r.host + r.path: r.verdict for r in u.judge(df).collect()}
    assert {url: found[re.sub("^http://", "", url)] for url in fresh} == fresh


def test_queries_and_urls_without_a_scheme_are_judged_by_what_they_say(spark):
    good = [f"http://{w}{k}.com/?topic={w}" for k in range(60) for w in ("garden", "river", "meadow")]
    bad = [f"http://{w}{k}.net/es/?topic={w}" for k in range(60) for w in ("casino", "pokies", "jackpot")]
    fresh = {"http://a.org/x?topic=garden#river": "allow", "http://a.org/x?topic=casino#pokies": "block", "river-meadow garden": "allow", "jackpot-casino pokies": "block"}
    urls = good + bad + list(fresh)
    found = {r.page_id: r.verdict for r in u.judge(pages(spark, urls)).collect()}
    assert {url: found[len(good + bad) + k] for k, url in enumerate(fresh)} == fresh


def test_no_rows_and_one_kind_only(spark):
    assert u.judge(pages(spark, ["http://a.com/"]).filter("false")).count() == 0
    only = u.judge(pages(spark, ["http://a.com/", "http://b.org/"])).collect()
    assert all(r.verdict in ("allow", "block") for r in only)


def test_clashing_columns(spark):
    df = pages(spark, ["http://a.com/", "http://b.org/"]).selectExpr("*", "1 AS host", "2 AS cells", "3 AS ratios", "4 AS id", "5 AS verdict")
    assert u.judge(df).columns == ["page_id", "host", "path", "rule", "verdict"]
