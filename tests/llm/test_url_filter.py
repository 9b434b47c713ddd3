"""The tree and its verdicts against a plain version over all urls."""

import math
import random
import re
from collections import defaultdict

from tierlens.llm import url_filter as u


def brute(urls, depth=99):
    rows = []
    for url in urls:
        host = path = ""
        if "://" in (url or ""):
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, said = max(fits)[1:] if fits else (None, None)
        rows.append([host, path, rule, said, [re.sub("[0-9]+", "*", s) for s in path[1:].split("/")] if path else [], "", ""])
    for level in range(depth):
        kids = defaultdict(lambda: defaultdict(int))
        for r in rows:
            if len(r[4]) > level:
                kids[r[0], r[6]][r[4][level]] += 1
        for r in rows:
            if len(r[4]) > level:
                k = kids[r[0], r[6]]
                variable = len(k) > u.MANY and sum(k.values()) < u.FEW * len(k)
                r[5], r[6] = r[6], f"{r[6]}/{'*' if variable else r[4][level]}"
    for r in rows:
        if len(r[4]) > depth:
            r[5], r[6] = r[6], r[6] + "/**"
    branch, pool, every, total = (defaultdict(lambda: [0, 0]) for _ in range(4))
    for host, _, _, said, _, parent, template in rows:
        for d, key in ((branch, (host, parent, template)), (pool, (host, parent)), (every, template), (total, 0)):
            d[key][0] += said is not None
            d[key][1] += said == "block"
    prior = (total[0][1] + 1) / (total[0][0] + 2)
    out = []
    for host, path, rule, said, _, parent, template in rows:
        (n, b), (pn, pb), (tn, tb) = branch[host, parent, template], pool[host, parent], every[template]
        alone = False
        if n and pn > n:
            s = pb / pn
            alone = abs(b / n - (pb - b) / (pn - n)) > u.DIFFERENT * math.sqrt(s * (1 - s) * (1 / n + 1 / (pn - n)))
        n, b = (n, b) if alone else (pn, pb)
        score = (b + u.WEIGHT * (tb + u.WEIGHT * prior) / (tn + u.WEIGHT)) / (n + u.WEIGHT)
        out.append((host, path, rule, template, round(score, 9), said or ("block" if score > 0.5 else "allow")))
    return out


def check(spark, urls, **kw):
    frame = spark.createDataFrame([(i, x, "t") for i, x in enumerate(urls)], "page_id bigint, url string, template string")
    got = u.judge(frame, **kw).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["template"], round(r["score"], 9), r["verdict"]) for r in got] == brute(urls, **kw)
    return got


def test_tree(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    hosts = ["a.example.org", "B.Example.com", "c.net", "org", "x.com", "hot.example.net"]
    urls = [None, "", "no scheme", "http://", "https://A.ORG", "https://a.org?x=/es/", "ftp://x.com#/de/", "http://a.com/fr/\n/é", "a://b://c/d"]
    for _ in range(400):
        path = [rng.choice(["de", "fr", "es", "en"]), rng.choice([str(rng.randrange(3000)), word(), "p%d.html" % rng.randrange(90)])]
        path += [word() for _ in range(rng.choice([0, 0, 0, 1, 9]))]
        urls.append(f"https://{rng.choice(hosts)}/{'/'.join(path)}{rng.choice(['', '/', '?q=1', '#t'])}")
    got = check(spark, urls + urls[:50], depth=6)
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}
    assert any(r["template"].endswith("/**") for r in got) and any("/de/*" in r["template"] for r in got)


def test_every_depth(spark):
    """Rules that differ in the eighth segment, and paths of all depths, against the plain version."""
    base = "http://a.org/1/b/c/d/e/f"
    urls = [f"{base}/{x}/{y}{chr(97 + i % 26)}{i}x{'/z' * (i % 3)}" for x in "gh" for y in "ku" for i in range(60)]
    rules = ((u.BLOCK, "a.org", "/1/b/c/d/e/f/g/k"), (u.ALLOW, "a.org", "/1/b/c/d/e/f/h/k"))
    frame = spark.createDataFrame([(x,) for x in urls], "url string")
    got = u.judge(frame, rules, depth=None).where("rule is null").collect()
    assert len(got) == 120
    assert all(r["verdict"] == (u.BLOCK if "/g/" in r["path"] else u.ALLOW) for r in got)
    rng = random.Random(9)
    urls += [f"http://b.example.org/{rng.choice(['en', 'es'])}/" + "/".join(rng.choice(["x", "y1", "y22"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    urls += ["http://c.com/fr" + "/s" * 25, "http://c.com/de" + "/s" * 40]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "page_id bigint, url string")
    got = u.judge(frame, depth=None).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["template"], round(r["score"], 9), r["verdict"]) for r in got] == brute(urls, depth=99)


def test_longest_rule_wins(spark):
    got = check(spark, ["http://www.example.org/en/17", "http://example.org/en/27", "http://q.org/es/1", "http://a.com/de/1", "http://com/fr/", "http://xorg/"], depth=1)
    assert [(r["rule"], r["verdict"]) for r in got][:5] == [
        ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow")]
    assert got[5]["rule"] is None


def test_no_labels_and_empty(spark):
    check(spark, ["http://a.net/x", None])
    assert u.judge(spark.createDataFrame([], "page_id bigint, url string")).collect() == []


def test_query(spark):
    from tierlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    pages = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]
    got = QUERIES["op4_url_filter"](spark, sf).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [(*b[:3], b[5]) for b in brute(pages)]
