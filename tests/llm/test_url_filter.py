import random

from pyspark.sql import functions as F

from tessera.llm import url_filter
from tessera.llm.queries import URL_RULES


def brute(rules, host, path):
    hits = [(len(h), len(p), v, h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=None)  # block sorts behind allow
    return (best[3], best[2]) if best else (None, None)


def some_rules(rng, n):
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "", "com."]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/", "/ab", "//"]
    return [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(n)]


def test_trie_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        rules = some_rules(rng, rng.randrange(8))
        trie = url_filter.UrlTrie(rules)
        for _ in range(20):
            host = ".".join(rng.choice(["com", "a", "b", "net", "x", "xa", ""]) for _ in range(rng.randrange(1, 4)))
            path = rng.choice(["", "/"]) + "/".join(rng.choice(["a", "b", "ab", "", "a%2F"]) for _ in range(rng.randrange(4)))
            assert trie.match(host, path) == brute(rules, host, path), (rules, host, path)


URLS = ["http://a.com/x?q=://b", None, "", "no scheme", "HTTP://WWW.Example.COM/en/1", "http://example.com/en", "://",
        "https://sub.example.com/en/?x", "http://x.net/es/#a", "http://net/fr/", "http://com", "http://a.com?x/en/",
        "x\ny://host.net/fr/a\nb", "http://\u00c9.com/"]


def test_host_and_path(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    got = [tuple(r) for r in url_filter.judge(df, URL_RULES).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [
        ("a.com", "/x", "com/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en", "com/", "allow"),
        ("", "", None, "allow"), ("sub.example.com", "/en/", "example.com/en/", "block"),
        ("x.net", "/es/", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("com", "", None, "allow"),
        ("a.com", "", None, "allow"), ("host.net", "/fr/a\nb", "net/fr/", "block"), ("\u00c9.com", "/", "com/", "allow")]


def test_long_lists_are_joined_with_the_same_result(spark):
    rng = random.Random(9)
    rules = some_rules(rng, 12)
    df = spark.createDataFrame([(u, "old", 1) for u in URLS * 2 + ["http://b.a.com/a/b/c", "http://a.com/ab"]],
                               "url string, verdict string, host int")
    table = spark.createDataFrame(rules + [(None, None, None)], "verdict string, host string, path string")
    key = lambda d: sorted(map(repr, d.select("url", "host", "path", "rule", "verdict").collect()))
    want = key(url_filter.judge(df, rules))
    assert want == key(url_filter.judge(df, table)) == key(url_filter.judge(df, table, max_broadcast_rules=3))
    assert len(want) == df.count()


def test_block_wins_a_tie_and_empty_tables(spark):
    assert url_filter.UrlTrie([("block", "a", "/"), ("allow", "a", "/")]).match("a", "/")[1] == "block"
    empty = spark.createDataFrame([], "url string, rule long")
    out = url_filter.judge(empty, [])
    assert out.columns == ["url", "host", "path", "rule", "verdict"] and out.count() == 0
    one = spark.createDataFrame([("http://a/",)], "url string")
    assert url_filter.judge(one, [], default="block").select(F.col("verdict")).first()[0] == "block"
