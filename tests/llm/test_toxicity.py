from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lectern.llm import toxicity as X


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=2)) + "".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("bcdlmn", k=2))
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.choice([5, 40, 300]))]
        toxic = int(k % 6 == 0)
        for _ in range(2 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["zzvile", "qwnasty"]) + rng.choice(["", "ish", "ly", "!"])
        rows.append((k, " ".join(words), "en" if k % 2 else None, "s", 1))
        labels.append((k, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    return docs, dict((k, t) for k, _, t in labels), X.train(docs, frame)


def test_held_out_accuracy(trained):
    docs, labels, net = trained
    rows = X.scored(docs, net).collect()
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {k for k in labels if zlib.crc32(str(k).encode()) % 4 == 2}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in out]) >= 0.97


def test_scores_depend_on_text_alone(spark, trained, make):
    _, _, net = trained
    texts = [None, "", "zzvile", "  ", "a", "x" * 100_000, "zzvile " * 3, "word " * 30_000 + "zzvileish"]
    rows = make([(k, t) for k, t in enumerate(texts)] + [(9, "zzvile"), (9, "zzvile"), (None, "zzvile")])
    got = [(r["doc_id"], r["score"], r["held_out"]) for r in X.scored(rows, net).collect()]
    by = {k: s for k, s, _ in got}
    assert by[0] == by[1] == by[3] and by[0] < 0.3
    assert len({s for k, s, _ in got if k in (2, 9, None)}) == 1 and by[2] > 0.5 and by[7] > 0.5
    assert [h for k, _, h in got if k is None] == [False]


def test_batches_score_like_single_texts(trained):
    rows, _ = corpus(40, 5)
    _, _, net = trained
    texts = [r[1].encode() for r in rows]
    alone = [net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    together = net.scores(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.allclose(alone, together, atol=1e-6)


def test_clean_only(spark, trained, make):
    _, _, net = trained
    docs = make([(1, "zzvile you zzvile"), (2, "bado cabu"), (3, None)])
    out = X.clean_only(docs, net)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]
    assert X.clean_only(make([]), net).count() == 0


def test_training_text_is_bounded(spark):
    from dataclasses import replace

    rows, labels = corpus(300)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert X.train(docs, frame, replace(X.PRODUCTION, max_words=5_000)) is not None
    with pytest.raises(Exception, match="max_words leaves no training text of one class"):
        X.train(docs, frame, replace(X.PRODUCTION, max_words=4))
    # one huge labelled text and one id in very many rows keep no other text from training
    settings = replace(X.PRODUCTION, max_text_bytes=10_000)
    huge = spark.createDataFrame([(301, "zzvile " * 100_000, "en", "s", 1), *[(0, rows[0][1], None, "s", 1)] * 50], schema)
    more = spark.createDataFrame([*labels, (301, 1, 1)], "doc_id bigint, quality int, toxic int")
    known = X.labelled(docs.union(huge), more, settings)
    assert known.where("doc_id = 301").count() == 0 and known.where("doc_id = 0").count() == 1
    assert X.train(docs.union(huge), more, settings) is not None


def plain_score(net, text):
    """The network over one whole text, word by word."""
    words, bucket = [], X.Words(net.settings)
    for part in "".join(c if c.isalnum() or not c.isascii() else " " for c in text).split(" "):
        if part:
            row, _ = bucket(np.frombuffer(part.encode(), np.uint8), np.array([0, len(part.encode())]))
            words.append(net.embedding[row[0]].sum(axis=0))
    total = net.out_bias
    for w, (weights, bias) in enumerate(zip(net.filters, net.bias, strict=True)):
        width = len(weights)
        empty = [np.zeros(net.settings.size)] * (width - 1)
        padded = [*empty, *words, *empty]
        for f in range(net.settings.filters):
            best = max((sum(padded[at + j] @ weights[j][:, f] for j in range(width)) + bias[f] for at in range(len(padded) - width + 1)), default=0.0)
            total += max(best, 0.0) * net.out[w * net.settings.filters + f] * bool(words)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_scores_against_a_plain_network(spark, trained, make):
    _, _, net = trained
    texts = ["", "zzvile", "One two, zzvileish! x", "é ö zz\tvile\n0", *[r[1] for r in corpus(12, 8)[0]]]
    got = {r["doc_id"]: r["score"] for r in X.scored(make(list(enumerate(texts))), net).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], [plain_score(net, t) for t in texts], atol=1e-5)


def test_without_labels(spark, make):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = make([(1, "a b")])
    net = X.train(docs, labels)
    assert net is None
    assert [(r["score"], r["predicted"], r["rejected"]) for r in X.scored(docs, net).collect()] == [(0.0, 0, False)]
    assert X.clean_only(docs, net).count() == 1


def test_thresholds_by_language():
    scores = np.array([0.9, 0.8, 0.2, 0.1] * 30)
    found = X.calibrate(scores, np.array([1, 1, 0, 0] * 30), ["en"] * 120, X.PRODUCTION)
    assert found == {"en": 0.5}
    assert X.calibrate(scores[:8], np.array([1, 1, 0, 0] * 2), ["fr"] * 8, X.PRODUCTION) == {}


def test_given_labels(spark):
    """Held-out quality on the given table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = X.scored(docs, X.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.8 * sum(r["toxic"] for r in rows)
    assert hit >= 0.9 * sum(r["predicted"] for r in rows)
