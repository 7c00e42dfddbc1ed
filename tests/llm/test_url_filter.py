import pytest

from gaugeline.llm import url_filter
from gaugeline.llm.queries import op1_url_filter

URLS = [
    None, "", "no mark", "://", "http://Example.ORG/en/1x?y", "https://a.example.org/en/2", "x://example.org/es/q#z", "http://badexample.org/es/",
    "ftp://m.shop.com/fr/1", "http://com/de/", "http://x.com?/de/", "http://x.com#://y.org/", "http://x.org", "http://É.Org/Ä", "a://b://c/d", "http://u@h.com:80/de/7",
    "http://net/" + "a" * 3000,
]
WANT = [
    ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("example.org", "/en/1x", "example.org/en/1"), ("a.example.org", "/en/2", "org/"),
    ("example.org", "/es/q", "example.org/es/"), ("badexample.org", "/es/", "org/"), ("m.shop.com", "/fr/1", "com/fr/"), ("com", "/de/", "com/de/"), ("x.com", "", None),
    ("x.com", "", None), ("x.org", "", None), ("É.org", "/Ä", "org/"), ("b:", "//c/d", None), ("u@h.com:80", "/de/7", None), ("net", "/" + "a" * 3000, None),
]


def test_hosts_paths_and_rules(spark):
    rows = [(k, u, "<p>some text</p>") for k, u in enumerate(URLS)] + [(None, URLS[4], None), (4, URLS[4], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as host", "1 as score")
    out = url_filter.judged(pages).collect()
    assert len(out) == len(rows)
    kinds = {h + p: k for k, h, p in url_filter.RULES}
    for r in out:
        if r["page_id"] is not None:
            host, path, rule = WANT[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[r["page_id"]]
        assert r["verdict"] in ("allow", "block") and (r["rule"] is None or r["verdict"] == kinds[r["rule"]])
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_split_name():
    counts = {"best": 50, "shop": 40, "be": 60, "st": 10, "online": 30, "a": 500}
    total = sum(counts.values())
    assert url_filter.split_name("bestshoponline", counts, total) == ["best", "shop", "online"]
    assert url_filter.split_name("bestqqqshop", counts, total) == ["best", "qqq", "shop"]
    assert url_filter.split_name("", counts, total) == [] and url_filter.split_name("zz", {}, 0) == ["zz"]


def test_longest_rule_wins_and_judge_learns(spark):
    rules = [("allow", "org", "/"), ("block", "casino.org", "/")]
    text = "best casino poker garden flower " * 50
    rows = [(k, f"http://{'pokercasino' if k % 2 else 'gardenflower'}{k // 2}.{'casino' if k % 2 else 'home'}.org/", text) for k in range(40)]
    rows += [(100, "http://bestpoker.net/", text), (101, "http://bestgarden.net/", text), (102, "http://pokercasino.net/x", text)]
    out = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert out[1]["rule"] == "casino.org/" and out[0]["rule"] == "org/"
    assert out[100]["words"] == ["best", "poker", "net"] and out[102]["words"] == ["poker", "casino", "net", "x"]
    assert out[100]["verdict"] == "block" and out[101]["verdict"] == "allow" and out[102]["verdict"] == "block"


def brute_words(pages):
    import re
    from collections import Counter

    counts = Counter()
    for html in pages:
        counts.update(w for w in re.findall(r"[^\W\d_]+", re.sub(r"<[^<>]*>", " ", html or "").lower()) if len(w) <= url_filter.LONGEST)
    return counts


def test_query_equals_brute_force(spark, sf):
    import math
    import re
    from collections import Counter

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    counts = brute_words([p["html"] for p in pages])
    total = sum(counts.values())
    out = {r["page_id"]: r for r in op1_url_filter(spark, sf).collect()}
    assert len(out) == len(pages)

    def tokens(r):
        found = []
        for side in ("host", "path"):
            shape = re.sub(r"[^a-z0-9]+", " ", re.sub(r"[0-9]+", " 0 ", r[side].lower())).split()
            found += [f"{side[0]}:{w}" for name in shape for w in (["0"] if name == "0" else url_filter.split_name(name, counts, total))]
        return found

    seen, classes = {"block": Counter(), "allow": Counter()}, Counter()
    for r in out.values():
        assert [t.split(":")[1] for t in tokens(r)] == r["words"]
        if r["rule"]:
            classes[r["verdict"]] += 1
            seen[r["verdict"]].update(tokens(r))
    size = len(set(seen["block"]) | set(seen["allow"]))
    known = set(seen["block"]) | set(seen["allow"])
    odds = {t: math.log((seen["block"][t] + 1) / (sum(seen["block"].values()) + size + 1)) - math.log((seen["allow"][t] + 1) / (sum(seen["allow"].values()) + size + 1)) for t in known}
    for r in out.values():
        score = math.log(classes["block"] / classes["allow"]) + sum(odds.get(t, 0.0) for t in tokens(r))
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert r["rule"] or r["verdict"] == ("block" if r["score"] > 0 else "allow")
