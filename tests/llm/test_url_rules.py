import random

from pyspark.sql import functions as F

from sightline.llm.url_rules import judge_urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), len(h), h, p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else default


def test_against_brute_force(spark):
    rnd = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "aa.com", "net", "x.net", "é.net", "com.a"]
    paths = ["/", "/a", "/a/b", "/ab", "/a/b/c", ""]
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h in hosts for p in paths if rnd.random() < 0.6}.values())
    urls = [f"http://{rnd.choice(['', 'w.', 'W.w.'])}{rnd.choice(hosts).upper() if rnd.random() < 0.3 else rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', 'x', '/z', '?q=/a', '#f'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "http://", "http:///a", "http://com", "x://com?/a"] + ["http://a.com/a/b"] * 300
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    rule_rows = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    for most in (50_000, 2):  # sent to all, and dealt over ranges
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rule_rows, max_shipped=most).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            assert got[i] == brute(u, rules), (most, u, got[i], brute(u, rules))
        assert judge_urls(df.limit(0), rule_rows, max_shipped=most).count() == 0
    assert {r.verdict for r in judge_urls(df, rule_rows.limit(0)).collect()} == {"allow"}


def test_very_long_urls_and_many_copies(spark):
    rules = [("com", "/", "allow"), ("a.com", "/x/", "block")]
    urls = ["http://" + "w." * 20_000 + "a.com/x/" + "y/" * 100_000 + "?q=" + "z" * 100_000, "http://a.com/" + "x" * 200_000, "h" * 300_000] + ["http://a.com/x/1"] * 500
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    rows = spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (50_000, 1):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rows, max_shipped=most).collect()}
        assert all(got[i] == brute(u, rules) for i, u in enumerate(urls))


def test_columns_of_any_name(spark):
    names = ("_host", "_path", "_key", "_range", "_rules", "_rule", "_verdict", "_c0", "host")
    df = spark.createDataFrame([("http://a.com/x",), (None,)], "url string").select("url", *(F.lit("own").alias(c) for c in names))
    rule_rows = spark.createDataFrame([("com", "/", "block"), ("net", "/", "allow")], "host string, path string, verdict string")
    for most in (50_000, 1):
        out = judge_urls(df, rule_rows, max_shipped=most)
        got = {r.url: r for r in out.collect()}
        assert got["http://a.com/x"].verdict == "block" and got[None].verdict == "allow" and got["http://a.com/x"].host == "a.com"
        assert all(r[c] == "own" for r in got.values() for c in names[:-1])
