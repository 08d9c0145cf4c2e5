import random

from pyspark.sql import functions as F

from lumenweave.llm import urls


def brute(url, rules=urls.RULES):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "nothing", "http://", "http:///x", "HTTP://WWW.Example.NET/en/1?q#f", "http://example.net/en", "http://badexample.net/en/2", "x://a.org/fr/é", "x://org/fr/", "ftp://a.b.example.com/de/", "http://a.example.com/en/",
    "http://net", "http://net/", "http://x.net?y=/", "http://x.net#/", "http://ÀB.net/", "http://a..net/", "http://.net/", "a://b://c.net/", "http://example.net./en/", "http://user@host.net:80/", "http://x.net/\n\nz",
]


def test_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[5], "h"), (5, URLS[5], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect())
    assert got == sorted((str(i), *brute(u)) for i, u, _ in rows)
    assert urls.judge(pages.limit(0)).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(3)
    keys = [f"key{rng.random()}" for _ in range(4000)]
    held = set(keys[::7])
    universe = spark.createDataFrame([(k, k in held) for k in keys], "key string, listed boolean")
    levels = urls.build_cascade(universe)
    assert len(levels) > 2
    got = {r.key for r in universe.filter(urls.listed(levels, F.col("key"))).collect()}
    assert got == held


def test_membership_by_cascade_and_past_its_bound(spark, monkeypatch):
    keys = spark.createDataFrame([(str(i),) for i in range(300)] + [(None,), ("7",)], "key string")
    listing = spark.createDataFrame([(str(i),) for i in range(0, 900, 3)] + [(None,), ("3",)], "key string")
    want = sorted([(str(i), i % 3 == 0) for i in range(300)] + [("None", False), ("7", False)])
    for bits in (urls.MAX_BITS, 64):
        monkeypatch.setattr(urls, "MAX_BITS", bits)
        assert sorted((str(r.key), r.listed) for r in urls.member(keys, listing).collect()) == want


MANY = tuple((".".join(h), p, v) for h, p, v in [(("b", "net"), "/", "block"), (("net",), "/en", "allow"), (("c", "b", "net"), "/", "allow"), (("net",), "/e", "block"), (("org",), "", "block"), (("x",), "y/", "block")])


def test_other_rules_ties_and_long_urls(spark):
    hosts = ["net", "b.net", "a.b.net", "c.b.net", "d.c.b.net", "cb.net", "org", "a.org", "x", "b.com"]
    tails = ["", "/", "/en", "/e?q", "/en/x", "#/en", "/" + "z" * 100_000]
    long = ["http://" + "a." * n + "b.net/en" for n in (10, 10_000)]
    rows = [(i, u) for i, u in enumerate([f"http://{h}{t}" for h in hosts for t in tails] + long)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for rules in (MANY, MANY[:1], MANY[-1:], ()):
        got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect())
        assert got == sorted((i, *brute(u, rules)) for i, u in rows)


def test_one_url_of_many_labels_takes_no_longer_than_its_length(spark):
    import time

    pages = spark.createDataFrame([(1, "http://" + "a." * 10_000 + "example.net/en/")], "page_id long, url string")
    urls.judge(pages).collect()
    host, path = urls.split_url(F.col("url"))
    keys = pages.select(urls.candidates(host, path, 2, [1, 4]).alias("k"))
    began = time.perf_counter()
    assert keys.first().k == ["example.net/en/", "example.net/", "net/en/", "net/"]
    assert time.perf_counter() - began < 5


def test_small_levels_stay_exact_and_sizes_follow_the_universe(spark, monkeypatch):
    rows = [(i, f"http://h{i}.{'net' if i % 3 else 'com'}/{i}") for i in range(3000)] + [(-1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [(f"h{i}.net", "/", "block" if i % 2 else "allow") for i in range(0, 3000, 5)]
    want = sorted((i, *brute(u, rules)) for i, u in rows)
    used = []
    monkeypatch.setattr(urls, "judge_by_join", lambda *a, join=urls.judge_by_join: used.append(1) or join(*a))
    for bits, least in ((urls.MAX_BITS, urls.LEAST_PASSING), (urls.MAX_BITS, 8), (1 << 10, 8)):
        monkeypatch.setattr(urls, "MAX_BITS", bits)
        monkeypatch.setattr(urls, "LEAST_PASSING", least)
        assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()) == want
    assert used == [1]
    monkeypatch.setattr(urls, "LEAST_PASSING", 4096)
    for others in (10**6, 10**9, 10**12):
        bits = urls.bits_for(4, others)
        wrong = others * (1 - (1 - 1 / bits) ** (4 * urls.HASHES)) ** urls.HASHES
        assert bits <= 1 << 13 and wrong < 1.2 * urls.LEAST_PASSING
    assert urls.bits_for(100_000, 10**12) <= 1 << 26
