from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import differences

from lectern.llm import lm_score as L
from lectern.llm import queries


def plain(texts, model):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(d[k : k + n]) for n in range(1, model.order + 1) for d in docs for k in range(len(d) - n + 1))
    total = sum(map(len, docs))

    def log(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        if counts[gram] >= model.min_count:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(model.backoff) + log(gram[1:])

    return [(len(d), sum(log(tuple(d[max(0, k - model.order + 1) : k + 1])) for k in range(len(d)))) for d in docs]


TEXTS = [None, "", " \n", "a", "a b a b a b", "the cat sat", "the cat sat on the mat", "a b", "É é É é", "x" * 5000 + " y", "b a b a\tc\x0bd", "w " * 3000]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("block", [40, 1 << 20])
@pytest.mark.parametrize("min_count", [1, 2])
def test_against_counters(spark, make, order, block, min_count):
    model = L.Model(order=order, block_bytes=block, min_count=min_count)
    got = {r["doc_id"]: r for r in L.score(make(list(enumerate(TEXTS))), model).collect()}
    for k, (n, log) in enumerate(plain(TEXTS, model)):
        assert got[k]["n_words"] == n and got[k]["log_score"] == pytest.approx(log, abs=1e-6)


def test_same_rows_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.queries()["op4_lm"](spark, sf), queries.oracle_sql()["op4_lm"], sf) == ""


def test_repeated_rows_and_nothing(spark, make):
    rows = L.score(make([(1, "a b"), (1, "a b"), (None, "a b")])).collect()
    assert len(rows) == 3 and len({r["log_score"] for r in rows}) == 1
    assert L.score(make([])).count() == 0


def test_planes():
    x = np.array([0, 1, -5, 2**62], np.int64)
    assert (L.from_planes(L.planes(x)) == x).all() and L.planes(x[:0]) == b""


def test_equal_rows_count_each_and_part(spark, make):
    rows = [(7, "so it goes on")] * 500 + [(8, "so it went")]
    model = L.Model(order=3, block_bytes=100)
    got = L.score(make(rows), model).collect()
    want = plain([t for _, t in rows], model)
    assert sorted((r["doc_id"], round(r["log_score"], 6)) for r in got) == sorted((i, round(s, 6)) for (i, _), (_, s) in zip(rows, want, strict=True))
    blocks = L.blocks_of(make(rows).repartition(20), 50)
    assert blocks.where("doc_id = 7").select("block").distinct().count() > 1


def test_words_built_to_collide(spark, make):
    """Two words of one length whose polynomial hashes agree modulo 2**64."""
    morse = [bin(k).count("1") & 1 for k in range(4_096)]
    one, two = ("".join("bL"[m ^ t] for m in morse) for t in (0, 1))
    texts = [one, one, two]
    got = {r["doc_id"]: r["log_score"] for r in L.score(make(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(3)] == pytest.approx([s for _, s in plain(texts, L.PRODUCTION)])


def test_registered_trigram_counts_everything(spark, make, tmp_path):
    make(list(enumerate(TEXTS)), extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.queries()["op4_lm_trigram"](spark, str(tmp_path)).collect()}
    for k, (n, log) in enumerate(plain(TEXTS, L.Model(order=3, min_count=1))):
        assert got[k]["n_words"] == n and got[k]["log_score"] == pytest.approx(log, abs=1e-3)
