import itertools

from pyspark.sql import functions as F

from moodmill.llm import url_filter as u


def test_split_and_listed_rules(spark):
    cases = [
        (None, "", "", None), ("no scheme", "", "", None), ("http://A.Example.COM/en/x?q=1", "a.example.com", "/en/x", "example.com/en/"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"), ("http://x.net", "x.net", "", None),
        ("x://b.net/es/", "b.net", "/es/", "net/es/"), ("ftp://badcom/", "badcom", "/", None), ("a://com/", "com", "/", "com/"),
        ("http://h#f://g/en", "h", "", None), ("://?x", "", "", None), ("http://h.org/a\nb#c", "h.org", "/a\nb", None),
    ]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, unwanted boolean")
    for r in u.judged_urls(frame, none).collect():
        _, host, path, rule = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == ("block" if rule in ("example.com/en/", "net/es/") else "allow")


def test_tokens(spark):
    frame = spark.createDataFrame([("http://m.a.org/en/12.html?x=1&y#top",), (None,)], "url string")
    got = [r.t for r in frame.select(u.url_tokens(F.col("url")).alias("t")).collect()]
    assert sorted(got[0]) == sorted(["host:m", "host:a", "host:org", "path:en", "path:#.html", "query:x", "query:y", "fragment:top"])
    assert got[1] == []


def test_mined_rules_equal_plain_search(spark):
    hosts = ["good.org", "shop.org", "cheap.org", "pills.org"]
    rows = []
    for i in range(400):
        host, lang = hosts[i % 4], ["en", "de"][i // 4 % 2]
        unwanted = host == "pills.org" or host == "cheap.org" and lang == "de" or i % 97 == 0
        rows.append((f"http://{host}/{lang}/{i}", unwanted))
    labelled = spark.createDataFrame(rows, "url string, unwanted boolean")
    found = {tuple(r.tokens): (round(r.confidence, 9), round(r.support, 9)) for r in u.mined_rules(labelled).collect()}
    transactions = [(frozenset(r.t), r.unwanted) for r in labelled.select(u.url_tokens(F.col("url")).alias("t"), "unwanted").collect()]
    tokens = sorted({t for items, _ in transactions for t in items})
    every = {}
    for n in range(1, u.MAX_ANTECEDENT + 1):
        for combo in itertools.combinations(tokens, n):
            hit = [bad for items, bad in transactions if items >= set(combo)]
            if hit and sum(hit) >= 20 and sum(hit) / len(hit) >= u.MIN_CONFIDENCE:
                every[combo] = (round(sum(hit) / len(hit), 9), round(sum(hit) / 400, 9))
    pruned = {
        c: v for c, v in every.items()
        if not any(set(o) < set(c) and every[o][0] >= v[0] for o in every)
    }
    assert found == pruned and ("host:pills",) in found
    pages = spark.createDataFrame([(1, "https://pills.org/fr/9"), (2, "https://cheap.org/de/1"), (3, "https://cheap.org/en/1"), (3, "https://cheap.org/en/1"), (4, None)], "page_id long, url string")
    got = sorted((r.page_id, r.verdict) for r in u.judged_urls(pages, labelled).collect())
    assert got == [(1, "block"), (2, "block"), (3, "allow"), (3, "allow"), (4, "allow")]
    assert u.judged_urls(pages.where("false"), labelled).count() == 0


def test_rules_on_late_tokens_and_of_any_length(spark):
    deep = "/".join(f"s{chr(97 + i)}" for i in range(14))
    rows = [(f"http://h.org/{deep}?q={i}{'&bad=1' if i % 2 else '&fine=1'}#f", bool(i % 2)) for i in range(80)]
    # Unwanted only with all of five names; each four of them are as often wanted.
    names = ["v", "w", "x", "y", "z"]
    rows += [("http://k.net/?" + "&".join(names), True)] * 40
    rows += [("http://k.net/?" + "&".join(x for x in names if x != gone), False) for gone in names for _ in range(40)]
    labelled = spark.createDataFrame(rows, "url string, unwanted boolean")
    found = {tuple(r.tokens): r.confidence for r in u.mined_rules(labelled).collect()}
    assert found == {("query:bad",): 1.0, tuple(f"query:{x}" for x in names): 1.0}
    pages = spark.createDataFrame([(1, "http://a.b/?bad"), (2, "http://a.b/?v&w&x&y"), (3, "http://a.b/?z&v&w&x&y")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in u.judged_urls(pages, labelled).collect()) == [(1, "block"), (2, "allow"), (3, "block")]


def test_rules_survive_unrelated_pages(spark):
    own = spark.range(30).selectExpr("concat('http://bad.biz/', id) url", "true unwanted")
    other = spark.range(20_000).selectExpr("concat('http://n', id % 50, '.info/', id) url", "id % 9 = 0 unwanted")
    alone = {tuple(r.tokens) for r in u.mined_rules(own).collect()}
    among = {tuple(r.tokens) for r in u.mined_rules(own.unionByName(other)).collect()}
    assert {("host:bad",), ("host:biz",)} <= alone
    assert among == {("host:bad",), ("host:biz",)}
