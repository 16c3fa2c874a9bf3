import brute

from syncohort.llm import urls


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute.site(r.url) for r in pages.collect()}
    for r in urls.judge_urls(pages).collect():
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict
        else:
            first = [x.split("-")[0] for x in host.split(".")]
            bad = {*urls.BLOCKED_NAMES, "free"} & set(first)
            assert r.verdict == ("block" if bad else "allow"), r


def test_odd_urls(spark):
    cases = [
        (1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/x?q#f"), (4, "HTTP://WWW.Example.COM/en/x?q#f"),
        (None, "http://a.example.com/en/"), (5, "http://example.com"), (6, "http://myexample.com/en/"),
        (7, "http://net/es/1"), (8, "x://y://z.net/fr/"), (9, "http://casino.test/"), (10, "http://a.test/casino-"),
        (11, "http://É.net/es/\n?"), (12, "http://a.net/ES/"), (13, "http://a.net?/es/"), (14, "http://com/"), (15, "http://" + "a." * 20000 + "net/es/"),
    ]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in cases], "page_id long, url string, rule string, rank int")
    got = urls.judge_urls(frame).collect()
    assert len(got) == len(cases)
    for r in got:
        options = [brute.site(u) for p, u in cases if p == r.page_id]
        assert (r.host, r.path, r.rule) in [o[:3] for o in options]
    by_id = {r.page_id: r for r in got}
    assert by_id[9].verdict == "block" and by_id[9].rule is None
    assert by_id[10].verdict == "allow" and by_id[4].rule == "www.example.com/en/"
    assert by_id[1].verdict == "allow" and by_id[1].host == "" and by_id[None].verdict == "block"
    assert urls.judge_urls(frame.limit(0)).collect() == []


def test_rules_without_literals_and_order(spark):
    rules = [
        urls.Rule("block", r"[0-9]{4}", (), 1, "digits"),
        urls.Rule("allow", r"/ok/", ("ok",), 2, "ok"),
        urls.Rule("block", r"/ok/", ("ok",), 2, "not ok"),
    ]
    frame = spark.createDataFrame(
        [(1, "http://a/1234"), (2, "http://a/ok/1234"), (3, "http://a/12")], "page_id long, url string"
    )
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(frame, rules).collect()}
    assert got == {1: ("digits", "block"), 2: ("not ok", "block"), 3: (None, "allow")}
