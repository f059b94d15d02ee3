from pyspark.sql import functions as F

from corpusloom.llm import weblinks
from corpusloom.llm.weblinks import RULES

SCHEMA = "page_id long, url string, html string"


def plain(url):
    """Host, path and rule, by hand."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and rest[:end].startswith(r.path)]
    return host, rest[:end], max(fits, key=lambda r: len(r.pattern)) if fits else None


URLS = [
    "https://a.example.org/en/1?x#y", "http://example.org/en/2", "http://EXAMPLE.org/es/", "x://b.org?q=/es/", "http://org/", "http://org",
    "http://shop.com/de/1", "http://shop.com/fr/1#/de/", "http://shop.com/en/", "HTTP://Ünï.Com/fr/", "http://notexample.org/es/1",
    "mailto:x", "", None, "://", "http:///path", "http://a://b/c", "http://h.com/de/\nx", "http://x.net/a b",
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame([*rows, rows[0]], SCHEMA).withColumn("host", F.lit("clash")).withColumn("fit", F.lit(1))
    got = weblinks.judged(pages).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        host, path, rule = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.pattern)
        if rule:
            assert r.verdict == rule.verdict


def test_trust_and_distrust_follow_links(spark):
    link = '<a href="https://{}/x">'.format
    rows = [
        (1, "http://good.org/a", link("friend.net") + link("friend.net") + '<img src="//cdn.net/i.png">'),
        (2, "http://friend.net/", link("far.net")),
        (3, "http://bad.com/de/1", link("victim.net")),
        (4, "http://spam.net/", link("BAD.com:80") + '<a href="/relative">'),
        (5, "http://far.net/", None), (6, "http://victim.net/", ""), (7, "http://alone.net/", link("alone.net")), (8, None, link("bad.com")),
        (9, "http://bad.com/en/", ""),
    ]
    got = {r.page_id: r.verdict for r in weblinks.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block"}


def test_ranks_equal_power_iteration(spark):
    links = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "a"): 3.0, ("d", "a"): 1.0}
    seeds = {"trust": {"a": 3.0, "d": 1.0}, "distrust": {"c": 2.0}}
    edges = spark.createDataFrame([(*k, w) for k, w in links.items()], "src string, dst string, weight double")
    seed_rows = [(k, h, m) for k, s in seeds.items() for h, m in s.items()]
    found = weblinks.propagate(edges, spark.createDataFrame(seed_rows, "kind string, host string, mass double")).collect()
    got = {(r.kind, r.host): r.mass for r in found}
    for kind, own in seeds.items():
        flow = links if kind == "trust" else {(b, a): w for (a, b), w in links.items()}
        start = {h: own.get(h, 0) / sum(own.values()) for h in "abcd"}
        rank = dict(start)
        for _ in range(weblinks.ROUNDS):
            new = {h: 0.15 * start[h] for h in "abcd"}
            for (a, b), w in flow.items():
                new[b] += 0.85 * rank[a] * w / sum(x for (s, _), x in flow.items() if s == a)
            rank = new
        for h in "abcd":
            assert abs(got.get((kind, h), 0) - rank[h]) < 1e-9


def test_parent_domains(spark):
    hosts = spark.createDataFrame([("a.b.example.org",), ("example.org",), ("x",)], "host string")
    got = {(r.src, r.dst) for r in weblinks.parent_edges(hosts).collect()}
    up = {("a.b.example.org", "b.example.org"), ("b.example.org", "example.org")}
    assert got == up | {(b, a) for a, b in up}


def test_empty_table(spark):
    assert weblinks.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distrust_reaches_every_host_of_a_long_chain(spark):
    rows = [(0, "http://bad.com/de/1", None), (100, "http://alone.net/", None)]
    rows += [(i, f"http://h{i}.net/", f'<a href="http://{f"h{i - 1}.net" if i > 1 else "bad.com"}/">') for i in range(1, 31)]
    got = {r.page_id: r.verdict for r in weblinks.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "allow" if i == 100 else "block" for i in [*range(31), 100]}


def test_ranks_are_final(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("trust", "a", 2.0)], "kind string, host string, mass double")
    got = {r.host: r.mass for r in weblinks.propagate(edges, seeds, rounds=None).collect()}
    a = 0.15 / (1 - 0.85 * 0.85 * 0.75)  # a = 0.15 + 0.85 * 0.75 b, b = 0.85 a, c = 0.85 * 0.25 b
    for host, mass in {"a": a, "b": 0.85 * a, "c": 0.85 * 0.25 * 0.85 * a}.items():
        assert abs(got[host] - mass) < 1e-5 * mass
