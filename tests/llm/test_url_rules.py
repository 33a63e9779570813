import random

from digestry.llm import url_rules

RULES = [*url_rules.RULES, ("block", "b.org", "/a"), ("allow", "b.org", "/a"), ("block", "x.b.org", ""), ("block", "b.org", "nowhere")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits)
    return host, path, best[3], best[2]


def urls():
    pick = random.Random(1)
    out = [None, "", "no scheme/com/", "http://", "://com", "http://COM/x?y#z", "http://a.b.org/ab", "HTTP://x.B.org", "http://com./", "http://.com/", "http://É.com/"]
    for _ in range(400):
        host = ".".join(pick.choice(["www", "example", "b", "x", "com", "net", "org", "EXAMPLE"]) for _ in range(pick.randint(1, 4)))
        out.append(f"http://{host}{pick.choice(['', '/', '/en/', '/es/1', '/fr', '/a', '/ab?x', '#q', '/en/a/b?c=://d'])}")
    return out + out[:50] + ["http://com/" + "x" * 100_000]


def check(spark):
    rows = list(enumerate(urls())) + [(3, "http://com/")] * 5
    df = spark.createDataFrame([(*r, "host", "clash") for r in rows], "page_id long, url string, host string, rule string").repartition(3)
    got = url_rules.judge_urls(df, url_rules.rule_table(spark, RULES), ["page_id"])
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *brute(u))) for i, u in rows)


def test_against_brute_force(spark):
    check(spark)


def test_long_rule_lists_are_shuffled_with_salt(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    check(spark)


def test_hash_prefix_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "PREFIX_HEX", 1)
    check(spark)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(none, url_rules.rule_table(spark, RULES), ["page_id"]).count() == 0
    some = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert url_rules.judge_urls(some, rules, ["page_id"], default="block").collect()[0]["verdict"] == "block"
