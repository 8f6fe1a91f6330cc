"""Trusted hosts in urls: one walk of an automaton against a plain scan."""

from __future__ import annotations

import random
import time

from factgraph.operators import trust

SOURCE = "position int, url string, trust_score double"


def made(n, seed=1):
    rng = random.Random(seed)
    label = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    return [(i, f"https://{label()}.{label()}/feed", float(rng.randint(0, 10))) for i in range(n)]


def plain(urls, sources):
    last = {}
    for position, url, score in sources:
        last[url.split("/")[2]] = (position, score / 10)
    return [max((v for h, v in last.items() if u is not None and h in u), default=(0, 0.5))[1] for u in urls]


def test_fifty_thousand_hosts(spark, monkeypatch):
    sources = made(50_000)
    rng = random.Random(2)
    urls = [f"http://{rng.choice(sources)[1][8:-5]}.{rng.choice('xyz')}/{i}" if i % 2 else f"https://x{i}.example/abcde.abcde" for i in range(300)] + [None, "", "no host"]
    articles = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "id long, url string, __text string")
    table = spark.createDataFrame(sources, SOURCE)
    want = plain(urls, sources)
    got = {r["id"]: r["trust_score"] for r in trust.score_trust(articles, table).collect()}
    assert [got[i] for i in range(len(urls))] == want
    monkeypatch.setattr(trust, "HOSTS", 20_000)
    got = {r["id"]: r["trust_score"] for r in trust.score_trust(articles, table).collect()}
    assert [got[i] for i in range(len(urls))] == want


def test_time_does_not_grow_with_the_list(spark):
    urls = spark.range(200_000).selectExpr("id", "concat('https://site', id % 9973, '.example/', repeat('path/', 20), id) AS url").cache()
    urls.count()

    def seconds(n):
        scored = trust.score_trust(urls, spark.createDataFrame([(i, f"https://h{i}.other", 5.0) for i in range(n)], SOURCE))
        scored.write.format("noop").mode("overwrite").save()  # workers start
        began = time.time()
        scored.write.format("noop").mode("overwrite").save()
        return time.time() - began

    few, many = seconds(20), seconds(20_000)
    assert many < 4 * few + 2  # a scan of the list would take a thousand times as long


def test_no_hosts(spark):
    articles = spark.createDataFrame([(1, "https://a.b/c")], "id long, url string")
    assert [r["trust_score"] for r in trust.score_trust(articles, spark.createDataFrame([], SOURCE)).collect()] == [0.5]
