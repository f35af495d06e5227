"""Quality rules: plain rules first, then robust multivariate outliers per language and source.

Statistics come from the whole text as bytes: words, code points in words, symbols,
repeated lines, and words in 8-word windows that occur twice or more in the text.  A
text fails the base rules with fewer than 20 words or with over 30 % of its words in
repeated windows.  For the texts that pass, transformed statistic vectors are judged
within their language and source by the minimum covariance determinant: starting from
medians and quartiles, concentration steps take the mean and covariance of the
three quarters of the group with the smallest Mahalanobis distances; a text is rejected
when its final distance is beyond the cutoff.  The covariance is scaled, up or down, so that
the 75 % point of the distances is that of the chi-squared distribution with as many degrees
of freedom as coordinates vary; only then do the floors widen what is narrower.

Every estimate covers all rows: quantiles come from counts of finely quantised
values, and means and covariances from sums.

Scale: one map over the scan leaves a row of numbers per document; all later passes
are over that cut table.  Each step aggregates with partial sums, so a group with a third
of all rows costs one row per task and group.  The groups' estimates are broadcast
only below ``BROADCAST_GROUPS`` groups and joined otherwise.

Cases: a null or empty text has no words and fails; null lang or source are groups of
their own; groups with fewer than ``MIN_GROUP`` judged rows are pooled within their language,
and if these are still fewer, altogether; a pool that stays smaller rejects nothing; no direction's variance
is below its floor, so constant groups are defined;
repeated rows are judged each for itself; other columns are ignored.  Equal windows and
lines are told by 64-bit hashes within a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Poly, cut, mix, slices, text_bytes, tidy, told_apart, word_spans

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
COVERAGE, STEPS, MIN_GROUP = 0.75, 4, 50
BROADCAST_GROUPS = 50_000
#: Chi-squared tail beyond which a text is rejected.
TAIL = 1e-3
#: Lowest standard deviation of each coordinate, in its transformed unit; it stands in where most of a
#: group has one value.  Each coordinate's range holds values beyond the cutoff at its floor.
FLOORS = {"word_length": 0.08, "symbols": 0.35, "dup_lines": 0.7, "repeats": 0.7, "size": 0.5}
FEATURES = tuple(FLOORS)

STATS = "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


class Statistics:
    """The counts of each document of a slice."""

    def __init__(self) -> None:
        self._poly = Poly(8)
        self._weights = [np.uint64(pow(self._poly.base, k, 2**64)) for k in range(WINDOW)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        starts, ends, first = word_spans(data, offsets)
        n_docs, n_words = len(offsets) - 1, np.diff(first)
        prefix = self._poly.prefix(data)
        visible = ((data & 0xC0) != 0x80) & ~np.isin(data, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
        return [n_words, _sums(visible, offsets), _sums(_SYMBOL[data], offsets), *self._lines(data, offsets, starts, prefix), self._repeats(data, prefix, starts, ends, first, n_docs)]

    def _lines(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        breaks = np.flatnonzero(data == 0x0A)
        heads = np.concatenate([offsets[:-1], breaks + 1])
        docs = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
        order = np.lexsort((heads, docs))
        heads, docs = heads[order], docs[order]
        last = np.ones(len(heads), bool)
        last[:-1] = docs[1:] != docs[:-1]
        tails = np.where(last, offsets[docs + 1], np.append(heads[1:], 0) - 1)
        wordy = np.searchsorted(starts, tails) > np.searchsorted(starts, heads)
        heads, tails, docs = heads[wordy], tails[wordy], docs[wordy]
        keys = mix(told_apart(self._poly.spans(prefix, heads, tails), data, heads, tails) + mix(docs.astype(np.uint64) + np.uint64(1)))
        _, one = np.unique(keys, return_index=True)
        again = np.ones(len(keys), bool)
        again[one] = False
        n = len(offsets) - 1
        return np.bincount(docs[again], minlength=n), np.bincount(docs, minlength=n)

    def _repeats(self, data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n_docs: int) -> np.ndarray:
        n = len(starts)
        if n < WINDOW:
            return np.zeros(n_docs, np.int64)
        words = told_apart(mix(self._poly.spans(prefix, starts, ends)), data, starts, ends)
        docs = np.repeat(np.arange(n_docs), np.diff(first))
        size = n - WINDOW + 1
        keys = mix(docs[:size].astype(np.uint64) + np.uint64(1))
        for k, weight in enumerate(self._weights):
            keys = keys + words[k : size + k] * weight
        at = np.flatnonzero(docs[:size] == docs[WINDOW - 1 :])
        at = at[_repeated(keys[at])]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        return np.bincount(docs[np.cumsum(cover[:n]) > 0], minlength=n_docs)


def statistics(docs: DataFrame) -> DataFrame:
    """One row of counts per document; see :data:`STATS`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Statistics()
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            for lo, hi in slices(offsets):
                n_words, word_chars, n_symbols, n_dup, n_lines, n_repeat = of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                part = batch.slice(lo, hi - lo)
                numbers = [pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *numbers], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(tidy(count), STATS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics; shares are per word or line, in percent, on a logarithmic scale."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "symbols": F.log1p(100 * F.col("n_symbols") / words),
        "dup_lines": F.log1p(100 * F.col("n_dup_lines") / lines),
        "repeats": F.log1p(100 * F.col("n_repeat_words") / words),
        "size": F.log(words.cast("double")),
    }


def chi_squared_upper(x: float, df: int) -> float:
    """The probability beyond x, by recurrence over the degrees of freedom."""
    half = x / 2
    q, a = (math.exp(-half), 1.0) if df % 2 == 0 else (math.erfc(math.sqrt(half)), 0.5)
    while a < df / 2:
        q += math.exp(-half + a * math.log(half) - math.lgamma(a + 1)) if half > 0 else 0.0
        a += 1
    return q


def chi_squared_point(upper: float, df: int) -> float:
    """The x beyond which the probability is ``upper``."""
    lo, hi = 0.0, 2000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_squared_upper(mid, df) > upper else (lo, mid)
    return hi


P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Center, precision with floors, and covariance without.
ESTIMATE = "grp string, n bigint, " + ", ".join([f"m{i} double" for i in range(P)] + [f"{k}{i}_{j} double" for k in "pc" for i, j in PAIRS])
SETTLED = "grp string, " + ", ".join([f"m{i} double" for i in range(P)] + [f"p{i}_{j} double" for i, j in PAIRS])


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    fields = [part.strip().split(" ") for part in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def floored(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """The precision with every direction at its floor at least, and how many directions vary (parts count)."""
    floors = np.array(list(FLOORS.values()))
    unit = np.outer(floors, floors)
    size, axes = np.linalg.eigh(cov / unit)
    return (axes / np.maximum(size, 1)) @ axes.T / unit, float(np.clip(size, 0, 1).sum())


def settled(cov: np.ndarray, level: float) -> np.ndarray:
    """The final precision, where ``level`` is the distance that covers three quarters of the group."""
    precision, df = floored(cov)
    if df < 0.5:  # the floors alone make the distances
        return precision
    points = [0.0, *(chi_squared_point(1 - COVERAGE, k) for k in range(1, P + 1))]
    return floored(cov * (level / np.interp(df, range(P + 1), points)))[0]


def _small(groups: DataFrame, n_groups: int) -> DataFrame:
    return F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups


def _start(judged: DataFrame) -> DataFrame:
    """Medians and quartile ranges as a diagonal estimate, from counts of values quantised to 1/256."""
    long = judged.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f) * 256).alias("q")) for i, f in enumerate(FEATURES)])).alias("v"))
    counts = long.groupBy("grp", "v.i", "v.q").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("grp", "i").orderBy("q"))
    whole = F.sum("c").over(Window.partitionBy("grp", "i"))
    at = {name: F.min(F.when(F.col("upto") >= share * F.col("n"), F.col("q"))) / 256 for name, share in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))}
    points = counts.select("grp", "i", "q", upto.alias("upto"), whole.alias("n")).groupBy("grp", "i").agg(F.max("n").alias("n"), *[v.alias(k) for k, v in at.items()])
    floors = F.element_at(F.array(*map(F.lit, FLOORS.values())), F.col("i") + 1)
    spread = F.greatest((F.col("hi") - F.col("lo")) / 1.349, floors)
    wide = points.withColumn("precision", 1 / (spread * spread)).groupBy("grp").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("mid"))).alias(f"m{i}") for i in range(P)], *[F.max(F.when(F.col("i") == i, F.col("precision"))).alias(f"p{i}_{i}") for i in range(P)])
    return wide.where(F.col("n") >= MIN_GROUP).select("grp", "n", *[f"m{i}" for i in range(P)], *[F.col(f"p{i}_{j}") if i == j else F.lit(0.0).alias(f"p{i}_{j}") for i, j in PAIRS])


def _distance() -> Column:
    off = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    return sum((1 if i == j else 2) * F.col(f"p{i}_{j}") * off[i] * off[j] for i, j in PAIRS)


def _with_level(measured: DataFrame, n_groups: int) -> DataFrame:
    """Adds ``level``: the group's distance that covers three quarters of it, to 1/32 of a power of two."""
    counts = measured.groupBy("grp", "bin").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("grp").orderBy("bin"))
    whole = F.sum("c").over(Window.partitionBy("grp"))
    level = counts.select("grp", "bin", upto.alias("upto"), whole.alias("n")).where(F.col("upto") >= COVERAGE * F.col("n")).groupBy("grp").agg(F.min("bin").alias("level"))
    return measured.join(_small(level, n_groups), "grp")


def _measured(judged: DataFrame, estimate: DataFrame, n_groups: int) -> DataFrame:
    return judged.join(_small(estimate, n_groups), "grp").withColumn("d2", _distance()).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-9) * 32))


def _concentrate(judged: DataFrame, estimate: DataFrame, n_groups: int) -> DataFrame:
    """One concentration step."""
    inner = _with_level(_measured(judged, estimate, n_groups), n_groups).where("bin <= level")
    off = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    sums = [F.sum(off[i]).alias(f"s{i}") for i in range(P)] + [F.sum(off[i] * off[j]).alias(f"s{i}_{j}") for i, j in PAIRS] + [F.max(f"m{i}").alias(f"m{i}") for i in range(P)]
    moments = inner.groupBy("grp").agg(F.max("n").alias("n"), F.count("*").alias("h"), *sums)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                shift = np.array([r[f"s{i}"] for i in range(P)]) / r["h"]
                cov = np.zeros((P, P))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / r["h"] - shift[i] * shift[j]
                precision, _ = floored(cov)
                rows.append([r["grp"], r["n"], *[r[f"m{i}"] + shift[i] for i in range(P)], *[precision[i, j] for i, j in PAIRS], *[cov[i, j] for i, j in PAIRS]])
            yield _batch(rows, ESTIMATE)

    return moments.mapInArrow(invert, ESTIMATE)


def _settle(estimate: DataFrame, levels: DataFrame) -> DataFrame:
    """The last estimate, scaled by the group's level."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                cov = np.zeros((P, P))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
                precision = settled(cov, 2 ** ((r["level"] + 1) / 32))
                rows.append([r["grp"], *[r[f"m{i}"] for i in range(P)], *[precision[i, j] for i, j in PAIRS]])
            yield _batch(rows, SETTLED)

    return estimate.join(levels, "grp").mapInArrow(scale, SETTLED)


def _groups(table: DataFrame) -> DataFrame:
    """(own, grp): where each language and source is judged; groups too small for an estimate pool by language, then altogether."""
    sizes = table.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)
    sizes = sizes.select(F.to_json(F.struct("lang", "source")).alias("own"), F.to_json(F.struct("lang")).alias("by_lang"), "n", F.sum(small).over(Window.partitionBy("lang")).alias("pooled"))
    return sizes.select("own", F.when(F.col("n") >= MIN_GROUP, F.col("own")).when(F.col("pooled") >= MIN_GROUP, F.concat(F.lit("small "), "by_lang")).otherwise("small").alias("grp"))


def judge(docs: DataFrame) -> DataFrame:
    """The statistics with base_failed, distance (null without an estimate) and kept."""
    coordinates = vector()
    table = cut(statistics(docs).withColumn("base_failed", base_failed()))
    groups = cut(_groups(table))
    n_groups = groups.count()
    table = table.withColumn("own", F.to_json(F.struct("lang", "source"))).join(_small(groups, n_groups), "own", "left")
    judged = table.where("not base_failed").select("grp", *[c.alias(f) for f, c in coordinates.items()])
    estimate = cut(_start(judged))
    for _ in range(STEPS):
        estimate = cut(_concentrate(judged, estimate, n_groups))
    levels = cut(_with_level(_measured(judged, estimate, n_groups), n_groups).groupBy("grp").agg(F.max("level").alias("level")))
    final = _small(cut(_settle(estimate, levels)), n_groups)
    scored = table.withColumns(coordinates).join(final, "grp", "left")
    distance = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & F.coalesce(distance <= F.lit(chi_squared_point(TAIL, P)), F.lit(True))
    return scored.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), kept.alias("kept"))
