import random

from pyspark.sql import functions as F

from tagframe.llm import url_filters as u


def brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    k = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    tail = rest[k:]
    m = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
    path = tail[:m]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])] if host else []
    best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def table(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def test_against_brute_force(spark):
    rnd = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "A.NET", "org.", "..", ""]
    paths = ["", "/", "/e", "/en/", "/en/7", "/en/77/é", "/\U0010ffff", "/en/7\U0010ffffx"]
    rules = list({(rnd.choice(hosts[:5]), rnd.choice(paths)): rnd.choice(["allow", "block"]) for _ in range(25)}.items())
    rules = [(h, p, v) for (h, p), v in rules] + [("com", "/en/", "allow"), ("com", "/en/", "block"), (None, "/", "block")]
    urls = [None, "", "no scheme", "://", "http://", "http://a.com?x=/en/", "http://a.com#f"] + [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q', '#f'])}" for _ in range(300)]
    df = spark.createDataFrame([(i % 50, x, "clash") for i, x in enumerate(urls)], "page_id int, url string, verdict string")
    one = {}
    for h, p, v in rules:
        if h is not None:
            one[h, p] = max(v, one.get((h, p), ""))
    got = u.judge_urls(df, table(spark, rules)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, [(h, p, v) for (h, p), v in one.items()]), r


def test_many_urls_of_one_host_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(u, "URLS_A_SWEEP", 10)
    df = spark.range(500).select("id", F.concat(F.lit("http://www.example.com/en/"), "id").alias("url"))
    assert {r.rule: r["count"] for r in u.judge_urls(df, u.rules_table(spark)).groupBy("rule").count().collect()} == {"com/en/": 489, "example.com/en/7": 11}
    assert u.judge_urls(df.limit(0), u.rules_table(spark)).count() == 0
    assert u.judge_urls(df, table(spark, [])).where("rule IS NULL AND verdict = 'allow'").count() == 500


def test_no_python_in_the_plan(spark):
    df = spark.range(5).select(F.lit("http://a.com/en/").alias("url"))
    plan = u.judge_urls(df, u.rules_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_that_clash_stay(spark):
    names = ["key", "top", "prefix", "urls", "salt", "at", "kind", "sweeps", "column 0", "size"]
    df = spark.createDataFrame([("http://a.example.com/en/71", *range(10)), (None, *range(10))], ["url", *names]).withColumn("host", F.lit(1))
    out = u.judge_urls(df, u.rules_table(spark))
    assert out.columns == ["url", *names, *u.NEW]
    assert sorted((r.verdict, r.rule or "", *[r[c] for c in names]) for r in out.collect()) == [("allow", "", *range(10)), ("allow", "example.com/en/7", *range(10))]
