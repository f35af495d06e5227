from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lectern.llm import quality as Q

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


HARD = [None, "", " \n\t", "one", "é ß\u00a0x\u2003y", "a\nb\na\n\n a\na", "same line\r\nsame line\r\n\x0b\x0c", "x " * 40, "|#*$%&<> ok", "1 2 3 4 5 6 7 8 9 " * 3, "a b c d e f g h\na b c d e f g h", "\n".join(["l1", "l2"] * 5)]


def test_counts(spark, make):
    rng = random.Random(1)
    texts = [*HARD, *(" ".join(rng.choices("ab c\nd é &", k=rng.randrange(400))) for _ in range(60)), " ".join(rng.choices(["u", "v"], k=20_000))]
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in Q.statistics(make(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == [plain(t) for t in texts]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    for d in docs.collect():
        want, row = plain(d["text"]), got[d["doc_id"]]
        assert tuple(row[c] for c in COUNTS) == want
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row["base_failed"] and row["kept"])


def clean(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))


def test_outliers_go_and_clean_stay(spark, make):
    rng = random.Random(2)
    rows = [(k, clean(rng, rng.choice([20, 60, 200, 900])), "en" if k % 3 else None, f"s{k % 2}", 1) for k in range(300)]
    rows += [(1000 + k, " ".join(w + "%%%" for w in clean(rng, 90).split()), "en", "s0", 1) for k in range(20)]
    rows += [(2000, clean(rng, 5000), "en", "s1", 1), (3000, clean(rng, 50), "xx", "rare", 1), (3000, clean(rng, 50), "xx", "rare", 1)]
    got = {}
    for r in Q.judge(make(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r["kept"])
    assert all(got[k] == [True] for k in [*range(300), 2000]) and got[3000] == [True, True]
    assert not any(got[1000 + k][0] for k in range(20))
    assert Q.judge(make([])).count() == 0


def test_constant_groups(spark, make):
    text = clean(random.Random(3), 40)
    assert all(r["kept"] for r in Q.judge(make([(k, text) for k in range(80)])).collect())


def test_estimate_finds_the_middle(spark):
    """Concentration steps against numpy on a third of contamination."""
    rng = np.random.default_rng(4)
    good, bad = rng.multivariate_normal(np.zeros(Q.P), np.diag([1, 2, 3, 2, 1.0]), 400), rng.normal(20, 1, (100, Q.P))
    frame = spark.createDataFrame([("g", *map(float, r)) for r in np.r_[good, bad]], "grp string, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    estimate = Q._start(frame)
    for _ in range(Q.STEPS):
        estimate = Q._concentrate(frame, estimate, 1)
    row = estimate.first()
    assert np.abs([row[f"m{k}"] for k in range(Q.P)]).max() < 0.4
    measured = Q._measured(frame, estimate, 1).select("d2").toPandas()["d2"].to_numpy()
    assert measured[400:].min() > measured[:400].max()


@pytest.mark.parametrize(("p", "df", "x"), [(0.25, 5, 6.6257), (0.05, 1, 3.8415), (0.01, 4, 13.2767)])
def test_chi_squared(p, df, x):
    assert abs(Q.chi_squared_point(p, df) - x) < 1e-3


def test_a_planted_outlier_in_each_coordinate_alone(spark, make):
    rng = random.Random(5)
    word = lambda n=None: "".join(rng.choices("abcdefgh", k=n or rng.randrange(3, 8)))
    lines = lambda words: "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))
    rows = [(k, lines([word() for _ in range(rng.randrange(80, 121))])) for k in range(200)]
    few, passage = [word(5) for _ in range(5)], [word() for _ in range(14)]
    planted = {
        "word_length": lines([word(12) for _ in range(100)]),
        "symbols": lines([word(4) + "%" for _ in range(100)]),
        "dup_lines": "\n".join(rng.choices(few, k=100)),
        "repeats": lines([*passage, *(word() for _ in range(35)), *passage, *(word() for _ in range(37))]),
        "size": lines([word() for _ in range(4_000)]),
    }
    assert tuple(planted) == Q.FEATURES
    rows += [(1000 + k, text) for k, text in enumerate(planted.values())]
    got = {r["doc_id"]: r for r in Q.judge(make(rows)).collect()}
    assert not any(got[1000 + k]["base_failed"] for k in range(Q.P))
    assert [name for k, name in enumerate(planted) if got[1000 + k]["kept"]] == []
    assert all(got[k]["kept"] for k in range(200))


def test_scale_goes_both_ways():
    cov = np.diag(np.array(list(Q.FLOORS.values())) ** 2 * 100)
    point = Q.chi_squared_point(0.25, Q.P)
    for level in (point / 2, point * 2):
        assert np.allclose(Q.settled(cov, level), np.linalg.inv(cov) * point / level)
    assert np.allclose(Q.settled(cov * 0, 1e-9), np.diag(np.array(list(Q.FLOORS.values())) ** -2.0))


def plain_verdicts(rows):
    """kept of every row by loops over groups and plain matrices; the counts are given."""
    names = list(Q.FEATURES)
    floors = np.array([Q.FLOORS[n] for n in names])

    def vector(r):
        words, lines = max(r["n_words"], 1), max(r["n_lines"], 1)
        return [np.log(max(r["word_chars"], 1) / words), np.log1p(100 * r["n_symbols"] / words), np.log1p(100 * r["n_dup_lines"] / lines), np.log1p(100 * r["n_repeat_words"] / words), np.log(words)]

    def covering(values, share):
        """The least value that so large a share does not exceed."""
        ordered = np.sort(values)
        return ordered[int(np.ceil(share * len(ordered))) - 1]

    def inverse(cov):
        size, axes = np.linalg.eigh(cov / np.outer(floors, floors))
        return axes @ np.diag(1 / np.maximum(size, 1)) @ axes.T / np.outer(floors, floors), np.clip(size, 0, 1).sum()

    def quantile(df):
        """The point that 75 % of chi-squared values don't exceed, for any number of degrees, by a line between whole ones."""
        points = [0.0, 1.3233, 2.7726, 4.1083, 5.3853, 6.6257]
        return np.interp(df, range(6), points)

    passing = [r for r in rows if not (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])]
    by_own, by_lang = {}, {}
    for r in passing:
        by_own.setdefault((r["lang"], r["source"]), []).append(r)
    for (lang, _), members in by_own.items():
        if len(members) < 50:
            by_lang.setdefault(lang, []).extend(members)
    groups = [m for m in by_own.values() if len(m) >= 50] + [m for m in by_lang.values() if len(m) >= 50]
    rest = [r for m in by_lang.values() if len(m) < 50 for r in m]
    groups += [rest] if len(rest) >= 50 else []
    distance = {}
    for members in groups:
        x = np.array([vector(r) for r in members])
        steps = np.floor(x * 256)
        lo, mid, hi = (np.array([covering(steps[:, k], share) for k in range(5)]) / 256 for share in (0.25, 0.5, 0.75))
        centre, precision = mid, np.diag(1 / np.maximum((hi - lo) / 1.349, floors) ** 2)
        for step in range(5):
            d = np.einsum("ni,ij,nj->n", x - centre, precision, x - centre)
            bins = np.floor(np.log2(d + 1e-9) * 32)
            level = covering(bins, 0.75)
            if step == 4:
                break
            inner = x[bins <= level]
            centre, cov = inner.mean(axis=0), np.cov(inner.T, bias=True)
            precision = inverse(cov)[0]
        _, df = inverse(cov)
        if df >= 0.5:
            precision = inverse(cov * 2 ** ((level + 1) / 32) / quantile(df))[0]
        for r, v in zip(members, x - centre, strict=True):
            distance[r["doc_id"]] = v @ precision @ v
    cutoff = 20.515  # the chi-squared point of 0.001 with five degrees
    good = {r["doc_id"] for r in passing}
    return {r["doc_id"]: r["doc_id"] in good and distance.get(r["doc_id"], 0.0) <= cutoff for r in rows}, distance


def test_whole_table_against_plain_matrices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [r.asDict() for r in Q.statistics(docs).collect()]
    want, distance = plain_verdicts(rows)
    got = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    assert len(got) == len(rows) == len(want)
    for k, kept in want.items():
        if k in distance:
            assert got[k]["distance"] == pytest.approx(distance[k], rel=2e-3, abs=1e-6)
        assert got[k]["kept"] == kept or abs(distance[k] - 20.515) < 0.05
    assert 0.02 < sum(not v for k, v in want.items() if k in distance) / len(distance) < 0.2
