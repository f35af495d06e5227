from __future__ import annotations

import random

import pytest

from lectern.llm import url_filter as U


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([k for k, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host, tail = rest[:at], rest[at:]
    end = min([k for k, c in enumerate(tail) if c in "?#"], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    fits = []
    for verdict, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://ORG/", "https://a.org", "https://a.org/x", "https://xorg/", "http://example.org/es/1", "http://m.example.org/en/12?x=/es/", "http://example.org/EN/1",
        "http://b.com/fr/", "http://b.com/fr", "http://b.com/de/x#y", "a://b.com?/de/", "http://x.com/a://y.org/", "http://É.ORG/é", "http://u:p@h.org:80/", "http://.org/", "http://example.org./"]


def test_parts_and_rules(spark):
    rng = random.Random(1)
    urls = URLS + ["http://" + "".join(rng.choices(["a", ".", "org", "com", "example.", "/", "?", "#", "fr/", "de/", "es/", "en/1"], k=rng.randrange(1, 8))) for _ in range(400)]
    frame = spark.createDataFrame([(k, u, "h", "x") for k, u in enumerate(urls)] + [(0, None, "h", "x"), (None, "http://a.org/", "h", "x")], "page_id bigint, url string, html string, host string")
    rows = U.judge(frame).collect()
    assert len(rows) == len(urls) + 2
    for r in rows[: len(urls)]:
        host, path = plain_parts(urls[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert r["verdict"] == (verdict or ("block" if r["block_probability"] >= 0.5 else "allow"))
    assert U.judge(frame.limit(0)).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in U.judge(pages).collect()}
    for page in pages.collect():
        host, path = plain_parts(page["url"])
        assert (got[page["page_id"]]["host"], got[page["page_id"]]["path"], got[page["page_id"]]["rule"]) == (host, path, plain_rule(host, path)[0])


def test_regression_knows_unseen_hosts():
    model = U.production_regression()
    bad = ["best-casino.example.net", "super-bets.example.net", "cheap-pills-online.example.com", "www.spam-farm.example.net", "poker-jackpot.example.net"]
    good = ["city-library.example.net", "www.thering.example.net", "m.tiontion.example.com", "school-news.example.net", "therha.example.net"]
    assert all(model.probability(h, "/en/77") >= 0.5 for h in bad)
    assert all(model.probability(h, "/en/77") < 0.5 for h in good)


def test_held_out_folds():
    """Hosts of a fold are unseen under any ending, prefix or path."""
    rows = U.labelled_urls()
    names = lambda url: next(n for n in U.host_and_path(url)[0].split(".") if n not in ("www", "m", "blog"))
    kinds = sorted({(names(u), y) for u, y in rows})
    fold = {name: k % 5 for k, (name, _) in enumerate(random.Random(3).sample(kinds, len(kinds)))}
    hits = {0: 0, 1: 0}
    for f in range(5):
        model = U.Regression().fit([r for r in rows if fold[names(r[0])] != f])
        for u, y in rows:
            if fold[names(u)] == f:
                hits[y] += (model.probability(*U.host_and_path(u)) >= 0.5) == bool(y)
    sizes = {y: sum(label == y for _, label in rows) for y in (0, 1)}
    assert hits[0] >= 0.95 * sizes[0] and hits[1] >= 0.75 * sizes[1]


def test_probabilities_against_a_plain_sum(spark):
    """The verdict's probability: weights of every different n-gram of host and path, by hand."""
    import math
    import re

    import xxhash

    model = U.production_regression()
    urls = [None, "http://best-casino.example.net/en/77", "https://city-library.example.com/", "http://x.org/a1b22?q"]
    got = {r["page_id"]: r["block_probability"] for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    for k, url in enumerate(urls):
        host, path = plain_parts(url)
        buckets = set()
        for seed, text in enumerate((f"^{host}$", "^" + re.sub("[0-9]+", "0", path) + "$")):
            for n in (3, 4, 5):
                buckets |= {xxhash.xxh64_intdigest(text[i : i + n].encode(), seed) % 65536 for i in range(len(text) - n + 1)}
        total = sum(model.weights[b] for b in buckets) / math.sqrt(max(len(buckets), 1)) + model.bias
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)))


def test_own_table(spark):
    rows = [(f"http://bad{k}.evilsite.net/x", 1) for k in range(20)] + [(f"http://n{k}.goodplace.net/x", 0) for k in range(20)] + [(None, None)]
    frame = spark.createDataFrame(rows, "url string, label int")
    model = U.regression_of(frame)
    pages = spark.createDataFrame([(1, "http://new.evilsite.net/y"), (2, "http://new.goodplace.net/y")], "page_id bigint, url string")
    assert [r["verdict"] for r in U.judge(pages, rules=(), regression=model).orderBy("page_id").collect()] == ["block", "allow"]
    with pytest.raises(ValueError):
        U.regression_of(frame.where("label = 1"))
    with pytest.raises(ValueError):
        U.regression_of(frame, max_rows=5)


def test_equal_rules_the_first_decides():
    assert U.Rules((("block", "a.org/x"), ("allow", "a.org/x"), ("allow", "a.org/")))("b.a.org", "/x/y") == ("a.org/x", "block")
    assert U.Rules(())("a.org", "/") is None
