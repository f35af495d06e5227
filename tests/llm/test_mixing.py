from __future__ import annotations

import math
from collections import Counter

import pytest
from compare import differences

from lectern.llm import mixing as G
from lectern.llm import queries


def table(make, sizes):
    """A source of so many one-document rows of ten words."""
    return make([(1000 * s + k, "w " * 10, "en", f"s{s}", 20) for s, n in enumerate(sizes) for k in range(n)])


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.queries()["op10_mix"](spark, sf), queries.oracle_sql()["op10_mix"], sf) == ""


@pytest.mark.parametrize(("share", "limit"), [(0.97, 100.0), (0.97, 2.0), (0.2, 4.0), (1.0, 1e9)])
def test_exponent(spark, share, limit):
    sizes = [900, 300, 90, 10]
    totals = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, tokens bigint")
    alpha = G.bisect_exponent(totals, G.Mixture(entropy_share=share, repetition_limit=limit))

    def entropy(a):
        w = [n**a for n in sizes]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    repeats = (max(sizes) / min(sizes)) ** (1 - alpha)
    assert repeats <= limit * (1 + 1e-6) or alpha == 1.0
    wanted = share * math.log(len(sizes))
    assert entropy(alpha) >= wanted - 1e-6 or repeats >= limit * (1 - 1e-6)
    if alpha < 1 and entropy(alpha) >= wanted + 1e-6:
        assert repeats >= limit * (1 - 1e-6)


def test_weights_are_realised_in_every_block(spark, make):
    sizes = [400, 100, 50]
    mixture = G.Mixture(entropy_share=0.99, repetition_limit=4.0, block_tokens=500, bucket_rows=30)
    rows = G.schedule(table(make, sizes), mixture).collect()
    copies = Counter(r["doc_id"] for r in rows)
    assert len(copies) == sum(sizes)  # nothing is dropped
    passes = {s: sum(n for k, n in copies.items() if k // 1000 == s) / sizes[s] for s in range(3)}
    assert passes[0] == 1.0 and max(passes.values()) <= 4.01 and passes[2] > passes[1] > 1
    weights = {s: passes[s] * sizes[s] / len(rows) for s in range(3)}
    blocks = {}
    for r in rows:
        blocks.setdefault(r["block_id"], []).append(r)
    for members in blocks.values():
        assert sorted(m["position"] for m in members) == list(range(len(members)))
        for s in range(3):
            assert abs(sum(m["source"] == f"s{s}" for m in members) - weights[s] * len(members)) <= 3
    again = G.schedule(table(make, sizes), mixture).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    orders = [[r["doc_id"] for r in sorted(rows, key=lambda r: (r["block_id"], r["position"])) if r["source"] == "s2" and r["epoch"] == e] for e in (0, 1)]
    assert set(orders[0]) == set(orders[1]) and orders[0] != orders[1]


def test_hard_rows(spark, make):
    rows = [(1, "a b", "en", None, 1), (1, "a b", "en", None, 1), (2, None, "en", "e", 1), (3, "", "en", "e", 1), (None, "x y z", "en", "q", 1), (4, "w", "en", "", 1)]
    docs = make(rows)
    out = G.mix(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    assert set(got) == {(r[0], r[1], r[3]) for r in rows} and got[(1, "a b", None)] % 2 == 0
    assert sum(got.values()) == G.schedule(docs).count()
    assert G.mix(make([])).count() == 0 and G.schedule(make([(1, None), (2, "")])).count() == 2


def test_mixed_rows_follow_the_blocks(spark, make):
    docs = table(make, [60, 20])
    mixture = G.Mixture(block_tokens=100)
    want = [r["doc_id"] for r in G.schedule(docs, mixture).orderBy("block_id", "position").collect()]
    assert [r["doc_id"] for r in G.mix(docs, mixture).collect()] == want


def test_rows_without_tokens_are_spread(spark, make):
    rows = [(k, "a b c d", "en", "full") for k in range(300)] + [(1000 + k, None if k % 2 else " ", "en", "empty") for k in range(400)]
    out = G.schedule(make([(i, t, lang, source, 1) for i, t, lang, source in rows], extra=False), G.Mixture(block_tokens=100)).where("source = 'empty'").collect()
    blocks = {r["block_id"] for r in out}
    assert len(out) == 400 and len(blocks) > 8
