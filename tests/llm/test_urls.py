"""URL filters: hosts, paths and rules against plain Python; the trees on URLs they can tell apart."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tilltrail.llm import urls

URLS = [
    None,
    "",
    "no scheme.net/x",
    "http://",
    "https://a.net",
    "https://a.net/",
    "HTTP://Sub.Example.NET/en/x?y=1#z",
    "http://example.net/en/",
    "http://example.net/EN/",
    "http://notexample.com/de/x",
    "http://example.com/de/x",
    "http://www.example.com/de",
    "http://x.org/fr/1",
    "http://x.org/frx",
    "http://net/",
    "http://ÉX.net?a=b://c",
    "http://a.com#://net/",
    "ftp://u@h.org:80/fr/;p?q",
    "http://bonnet/a",
]


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else None


def pages_of(spark, found):
    rows = [(i, u, "h", "r", "v") for i, u in enumerate(found)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string, verdict string")


def test_hosts_paths_and_rules(spark):
    found = {r["page_id"]: r for r in urls.judge(pages_of(spark, URLS)).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain(url)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule), url
        assert found[i]["verdict"] == verdict if verdict else found[i]["verdict"] in ("allow", "block")


def test_trees_learn_what_the_rules_label(spark):
    rnd = random.Random(2)
    found = []
    for i in range(400):
        if i % 2:
            found.append(f"http://a{rnd.randint(0, 9)}.net/ads/{rnd.getrandbits(60)}/{rnd.getrandbits(60)}?a=1&b=2&c=3")
        else:
            found.append(f"http://w{rnd.choice('abc')}.org/fr/page")
    unlabelled = ["http://z.info/ads/918273645546372819/1029384756473829?a=1&b=2&c=3", "http://wa.info/it/page"]
    rows = {r["page_id"]: r for r in urls.judge(pages_of(spark, found + unlabelled)).collect()}
    assert rows[400]["verdict"] == "block" and rows[401]["verdict"] == "allow"
    assert rows[400]["score"] > 0.5 > rows[401]["score"]


def test_one_label_or_none(spark):
    one = urls.judge(pages_of(spark, ["http://a.net/", "http://b.info/", None])).collect()
    assert {r["verdict"] for r in one} == {"block"} and {r["score"] for r in one} == {None}
    none = urls.judge(pages_of(spark, ["http://b.info/", None])).collect()
    assert {r["verdict"] for r in none} == {"allow"}
    assert urls.judge(pages_of(spark, [])).count() == 0


def test_features(spark):
    rows = urls.with_features(urls.with_host_and_path(pages_of(spark, ["http://a-b.x1.com/p/q.html?u=1&v#f", None])))
    first, second = rows.orderBy("page_id").collect()
    url = "http://a-b.x1.com/p/q.html?u=1&v#f"
    entropy = -sum(url.count(c) / len(url) * math.log2(url.count(c) / len(url)) for c in set(url))
    assert (first["length"], first["depth"], first["labels"], first["parameters"]) == (len(url), 2, 3, 2)
    assert (first["fragment"], first["hyphens"], first["tld"], first["extension"]) == (1, 1, "com", "html")
    assert math.isclose(first["entropy"], entropy) and math.isclose(first["digit_ratio"], 2 / len(url))
    assert (second["length"], second["entropy"], second["parameters"]) == (0, 0, 0)


def test_trees_run_without_python(spark):
    plan = urls.judge(pages_of(spark, URLS)).select(F.max("score"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def kind_of(rnd, host: str, bad: bool) -> str:
    if bad:
        return f"http://{host}/ads-{rnd.getrandbits(50)}/c-{rnd.getrandbits(40)}?id={rnd.getrandbits(30)}&b=2&c=3"
    return f"http://{host}/{rnd.choice(['news', 'about', 'people'])}/{rnd.choice(['today', 'archive', 'city'])}"


def test_hosts_without_a_rule_are_told_by_their_look(spark):
    """Each rule's host and suffix in turn is unknown to the trees; those of other rules must do."""
    rnd = random.Random(6)
    hosts = {f"h{i}.s{i}": i % 2 == 0 for i in range(8)}
    found = [(host, bad, kind_of(rnd, host, bad)) for host, bad in hosts.items() for _ in range(60)]
    pages = pages_of(spark, [u for _, _, u in found])
    right = total = 0
    for withheld in ("h0.s0", "h3.s3"):
        rules = tuple(urls.Rule("block" if bad else "allow", f"{h}/") for h, bad in hosts.items() if h != withheld)
        verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules).collect()}
        own = [i for i, (h, _, _) in enumerate(found) if h == withheld]
        right += sum(verdicts[i] == ("block" if found[i][1] else "allow") for i in own)
        total += len(own)
    assert right / total >= 0.95


def test_training_rates_come_from_hosts_of_other_folds(spark):
    rows = [(f"http://h{i}.net/a.html", f"h{i}.net", "/a.html", float(i % 2)) for i in range(40)] + [("http://a.b/x", "a.b", "/x", 1.0)]
    sample = urls.with_features(spark.createDataFrame(rows, "url string, host string, path string, label double"))
    folds = {r["host"]: r["f"] for r in sample.select("host", F.pmod(F.xxhash64("host"), F.lit(urls.FOLDS)).alias("f")).collect()}
    found = urls._with_own_rates_withheld(sample).collect()
    assert len(found) == len(rows)
    for r in found:
        others = [label for _, host, _, label in rows if folds[host] != folds[r["host"]] and host.endswith(r["tld"])]
        assert math.isclose(r["tld_rate"], (sum(others) + 1) / (len(others) + 2))


def test_repeated_and_very_long_urls(spark):
    long = "http://a.info/" + "x/1?" * 50_000
    found = urls.judge(pages_of(spark, [long, long, "http://a.net/", "http://x.org/fr/"])).collect()
    assert len(found) == 4
    assert len({(r["host"], r["path"], r["verdict"], r["score"]) for r in found if r["host"] == "a.info"}) == 1
