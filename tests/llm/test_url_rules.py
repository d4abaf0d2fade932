import itertools
import random
import re

from pyspark.sql import functions as F

from lendlens.llm import url_rules as ur
from lendlens.llm.catalog import URL_RULES

URLS = ["http://Example.com/en/1", "https://www.example.com/en/2?q=1", "http://a.b.net/es/", "http://x.net/en/", "ftp://net/fr/a#b", "http://example.com",
        "http://notexample.com/en/1", "no scheme", "", None, "http://EXAMPLE.com:80/en/", "http://a.com?x://y/z", "://com/", "http://", "http://É.com/x",
        "x" * 3000 + "://com/" + "y/" * 500, "http://www.example.com/en/2?q=1"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else None


def frames(spark, urls, labels):
    pages = spark.createDataFrame([(i, u, "h", "t", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, tokens string, id int")
    return pages, spark.createDataFrame(labels, "id long, verdict string")


def test_listed_rules_equal_the_plain_reading(spark):
    pages, labels = frames(spark, URLS, [])
    got = {r.id: r for r in ur.judge(pages, labels, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_empty_tables(spark):
    pages, labels = frames(spark, [], [])
    assert ur.judge(pages, labels, URL_RULES).collect() == []


def mined_by_hand(rows, support, confidence, lift):
    """All rules by counting every token combination."""
    n = len(rows)
    count, joint, by = {}, {}, {}
    for tokens, verdict in rows:
        by[verdict] = by.get(verdict, 0) + 1
        for k in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), k):
                count[c] = count.get(c, 0) + 1
                joint[c, verdict] = joint.get((c, verdict), 0) + 1
    return {(c, v): (j / count[c], j / n) for (c, v), j in joint.items()
            if j >= support * n and j / count[c] >= confidence and j / count[c] / (by[v] / n) >= lift}


def test_mined_rules_and_matches_equal_counting(spark):
    rng = random.Random(4)
    urls, labels = [], []
    for i in range(240):
        section, site = rng.choice(["ads", "news", "blog"]), rng.choice(["alpha", "beta"])
        urls.append(f"http://{site}.org/{section}/{i}")
        bad = section == "ads" and site == "beta"
        if i < 200:
            labels.append((i, "block" if bad or rng.random() < 0.05 else "allow"))
    labels += labels[:3] + [(5000, "block"), (None, "block")]
    pages, known = frames(spark, urls, labels)
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", ur.tokens("url").alias("t")).collect()}
    rows = [(tokens[i], v) for i, v in dict.fromkeys(labels) if i in tokens]
    want = mined_by_hand(rows, 0.1, 0.8, 1.2)
    got = ur.mine(pages.join(known.distinct(), F.col("page_id") == known["id"]).select(ur.tokens("url").alias("tokens"), "verdict"), 0.1, 0.8, 1.2).collect()
    assert {(tuple(r.tokens), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in got} \
        == {k: (round(a, 9), round(b, 9)) for k, (a, b) in want.items()} and any(v == "block" for _, v in want)
    judged = {r.id: r for r in ur.judge(pages, known, [], min_support=0.1).collect()}
    for i in tokens:
        fits = [(-c, -s, -len(t), t, v) for (t, v), (c, s) in want.items() if set(t) <= tokens[i]]
        assert judged[i].mined == (min(fits)[4] if fits else None)
    assert judged[239].rule is None


def test_no_python_on_the_path(spark):
    pages, labels = frames(spark, URLS, [(i, "allow") for i in range(10)])
    plan = ur.judge(pages, labels, URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
