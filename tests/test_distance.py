from __future__ import annotations

import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import distance as D
from lectern.operators import kernels as K


def pairs(spark, expression, rows):
    return [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(expression).collect()]


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_character_rates(spark):
    rows = [("abc", "abc"), ("abc", ""), ("ab", "abcd"), ("", "x"), ("తెలుగు", "తెలగు")]
    assert pairs(spark, D.cer("a", "b"), rows) == [0.0, 1.0, 1.0, None, 1 / 6]


def test_word_edits(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices("a b c d ee ff g".split(), k=rng.randrange(9))), " ".join(rng.choices("a b c d ee x y".split(), k=rng.randrange(9)))) for _ in range(300)]
    assert pairs(spark, D.word_edits("a", "b"), rows) == [edits(a.split(), b.split()) for a, b in rows]
    assert pairs(spark, D.wer("a", "b"), [("w", "x y z"), ("", "a")]) == [3.0, None]


def test_agreement(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh", k=300))
    near = long[:150] + "zz" + long[150:]
    rows = [("", ""), ("a", ""), ("tide", "diet"), ("diet", "tide"), ("same", "same"), (long, near)]
    got = pairs(spark, D.agreement("a", "b"), rows)
    assert got[:5] == [0.0, 0.0, 0.25, 0.5, 1.0]
    assert got[5] == SequenceMatcher(None, long, near).ratio() < 0.9 < SequenceMatcher(None, long, near, autojunk=False).ratio()


@settings(max_examples=200, deadline=None)
@given(st.text("ab é", max_size=90), st.text("abcé", max_size=90))
def test_bit_edits(a, b):
    assert D.bit_edits(a, b) == edits(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("abcde", max_size=30), st.text("abcdef", max_size=30))
def test_ratio(a, b):
    assert D.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_ratio_of_long_texts():
    rng = random.Random(8)
    letters = "etaoinshrdlu" * 9 + "vwxyzKLMNOPQ"
    for size in (199, 200, 201, 1500, 6000):
        a = "".join(rng.choices(letters, k=size))
        b = "".join(c if rng.random() < 0.8 else rng.choice(letters) for c in a) + a[: size // 7]
        assert D.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_long_texts_take_the_other_way(spark, monkeypatch):
    rng = random.Random(9)
    one = [rng.choice("a b c d ee ff é".split()) for _ in range(400)]
    two = [w if rng.random() < 0.7 else rng.choice(["a", "zz"]) for w in one]
    rows = [(" ".join(one), " ".join(two)), ("x", " ".join(one)), (" ".join(one), ""), (None, "a")]
    want = [None if a is None else (edits(a, b), edits(a.split(), b.split())) for a, b in rows]
    for cells in (D.CELLS, 500):
        monkeypatch.setattr(D, "CELLS", cells)
        assert [None if c is None else (c, w) for c, w in zip(pairs(spark, D.char_edits("a", "b"), rows), pairs(spark, D.word_edits("a", "b"), rows), strict=True)] == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60), st.integers(1, 8))
def test_components_by_flood(cells, width):
    import numpy as np

    height = -(-len(cells) // width)
    mask = np.zeros(height * width, bool)
    mask[: len(cells)] = cells
    mask = mask.reshape(height, width)
    left, n = {tuple(p) for p in np.argwhere(mask).tolist()}, 0
    labels = K.label_components(mask)
    while left:
        n += 1
        first = left.pop()
        todo, seen = [first], {first}
        while todo:
            y, x = todo.pop()
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            seen |= near
            todo += near
        assert len({labels[p] for p in seen}) == 1
    assert labels.max() == n


def test_many_pairs_at_once():
    import numpy as np

    from lectern.functions.edits import many_edits

    rng, pairs = random.Random(10), []
    for size in [*range(6), 63, 64, 65, 127, 200, 700, 2500] * 12:
        a = rng.choices(range(rng.choice([2, 30])), k=size)
        cut, to = sorted(rng.choices(range(size + 1), k=2))
        near = [x if rng.random() < 0.8 else 99 for x in a if rng.random() < 0.9]
        pairs += [(a, near), (near, a), (a, a[:cut] + a[to:]), (a, a[to:] + a[:cut]), (a, rng.choices(range(30), k=rng.randrange(size + 9)))]
    got = many_edits([(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b in pairs])
    assert got.tolist() == [D.bit_edits(a, b) for a, b in pairs]


def test_changed_lines_are_measured_together(spark):
    """Pairs of some hundred characters and more go to the batches, both distances in one go, and no other plan is left."""
    import pandas as pd

    from lectern.operators import metrics

    rng = random.Random(11)
    one = ["".join(rng.choices("etaoin shrdlu", k=300)).strip() for _ in range(40)] + ["", "same", "é x"]
    two = [t.translate(str.maketrans("aeo", "eoa")) for t in one[:40]] + ["x", "same", ""]
    got = D._both_edits.func(pd.Series(one), pd.Series(two))
    assert got["edits"].tolist() == [edits(a, b) for a, b in zip(one, two, strict=True)]
    assert got["word_edits"].tolist() == [edits(a.split(), b.split()) for a, b in zip(one, two, strict=True)]
    log = spark.createDataFrame([(k, "p", "ok", t) for k, t in enumerate(two)], "k int, input_path string, status string, text string")
    truth = spark.createDataFrame([(k, "page", t, "i") for k, t in enumerate(one)], "k int, page_key string, ground_truth_text string, image string")
    words = metrics.word_metrics(log, truth, ["k"])
    assert "levenshtein" not in words._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: (r["edits"], r["word_edits"]) for r in words.collect()} == {k: (edits(" ".join(a.split()), " ".join(b.split())), edits(a.split(), b.split())) for k, (a, b) in enumerate(zip(one, two, strict=True))}
