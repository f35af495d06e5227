"""Toxicity by a convolutional text classifier.

A word (letters and digits, A-Z lower-cased) is embedded as the sum of the hashed
embeddings of itself and of its first 4, 5 and 6 bytes, so that unseen forms of a known
stem are near it.  Filters of widths 1, 2 and 3 run over the words of the whole text; each
filter's maximum over the text, if positive, is a feature of a logistic output.  Weights
are trained in numpy by Adagrad; the first embedding coordinate starts as the smoothed
log odds of a bucket's document frequencies in the training texts.  Thresholds are
calibrated for each language on labelled texts that training has not seen; they decide
what :func:`clean_only` rejects and are no part of a score.

Scale: training uses at most ``max_toxic`` + ``max_clean`` labelled ids, taken in the
order of a hash, their texts of up to ``max_text_bytes``, and of these what fits into ``max_words``;
a text that doesn't fit is passed over, not the ones after it.  These bounds are the only
ones, and scores are of whole texts, however long.  Words are hashed in the executors and
one task of an executor trains, so no text comes to the driver.  The model has a fixed size (a few MB).
Scoring is a map over the scan; nothing is shuffled.

Cases: null and empty texts have no feature and score the bias; a label is toxic if any
row of its doc_id says so; null labels are ignored; a null doc_id is never held out nor
labelled; where the labels don't hold both classes, every score is 0; where only the bound
on words loses one of them, training raises an error; repeated rows train once and are
scored each for itself; an empty table gives an empty result; :func:`clean_only` carries
all columns, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, Poly, mix, slices, text_bytes, tidy, word_spans

_BETWEEN = np.ones(256, bool)
_BETWEEN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_BETWEEN[128:] = False
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    bucket_bits: int = 18
    size: int = 8  # of an embedding
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    epochs: int = 5
    rate: float = 0.05
    max_toxic: int = 4_000
    max_clean: int = 8_000
    max_text_bytes: int = 1 << 20  # longer labelled texts don't train; every text is scored whole
    max_words: int = 16_000_000  # of training texts in the task that trains, 16 bytes each
    threshold: float = 0.3
    least_calibration: int = 25  # toxic texts of a language; with fewer the threshold above holds
    seed: int = 3


PRODUCTION = Settings()


class Words:
    """Bucket numbers of each word and its stems: (words, 1 + len(STEMS)), and the first word of each text."""

    def __init__(self, settings: Settings):
        self._poly, self._shift = Poly(settings.seed), np.uint64(64 - settings.bucket_bits)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, _BETWEEN)
        prefix = self._poly.prefix(data)
        out = np.empty((len(starts), 1 + len(STEMS)), np.int64)
        for k, n in enumerate((None, *STEMS)):
            upto = ends if n is None else np.minimum(starts + n, ends)
            out[:, k] = mix(self._poly.spans(prefix, starts, upto) + np.uint64(k << 40)) >> self._shift
        return out, first


@dataclass
class Network:
    settings: Settings
    embedding: np.ndarray  # (buckets, size)
    filters: list[np.ndarray]  # by width: (width, size, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of all texts of a buffer."""
        words, parts = Words(self.settings), []
        for lo, hi in slices(offsets):
            parts.append(self._scores(*words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])))
        return np.concatenate(parts) if parts else np.zeros(0)

    def _scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        n_docs, each, edge = len(first) - 1, self.settings.filters, max(self.settings.widths) - 1
        features = np.zeros((n_docs, each * len(self.filters)), np.float32)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            # empty words stand before, between and after the texts
            counts = np.diff(first)
            at = first[:-1] + edge * (np.arange(n_docs) + 1)
            x = np.zeros((len(buckets) + edge * (n_docs + 1), self.settings.size), np.float32)
            place = np.arange(len(buckets)) + edge * (np.repeat(np.arange(n_docs), counts) + 1)
            for k in range(buckets.shape[1]):
                x[place] += self.embedding[buckets[:, k]]
            for w, (weights, bias) in enumerate(zip(self.filters, self.bias, strict=True)):
                width = len(weights)
                value = sum(x[j : len(x) - width + 1 + j] @ weights[j] for j in range(width)) + bias
                value = np.concatenate([value, np.full((width, each), -1.0, np.float32)])
                bounds = np.stack([at[some] - width + 1, at[some] + counts[some]], axis=1).reshape(-1)
                features[some, w * each : (w + 1) * each] = np.maximum(np.maximum.reduceat(value, bounds, axis=0)[::2], 0)
        total = (features * self.out).sum(axis=1) + self.out_bias
        # a product of matrices differs in its last bits with the texts beside a text; its score doesn't
        return np.round(1 / (1 + np.exp(-np.clip(total, -30, 30).astype(np.float64))), 6)


def _fresh(settings: Settings, docs: list[np.ndarray], toxic: np.ndarray) -> Network:
    rng = np.random.default_rng(settings.seed)
    n = 1 << settings.bucket_bits
    seen = np.zeros((2, n))
    for buckets, y in zip(docs, toxic, strict=True):
        seen[int(y), np.unique(buckets)] += 1
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    smooth = max(0.002, 1 / n_toxic)
    embedding = rng.normal(0, 0.02, (n, settings.size)).astype(np.float32)
    embedding[:, 0] = np.log((seen[1] / n_toxic + smooth) / (seen[0] / n_clean + smooth))
    filters = [rng.normal(0, 0.1, (w, settings.size, settings.filters)).astype(np.float32) for w in settings.widths]
    for weights in filters:
        weights[:, 0, :] += 0.5 / len(weights)
    bias = [np.full(settings.filters, -0.1, np.float32) for _ in filters]
    return Network(settings, embedding, filters, bias, np.full(settings.filters * len(filters), 0.2, np.float32), -2.0)


def fit(settings: Settings, docs: list[np.ndarray], toxic: np.ndarray) -> Network:
    """Trains on the bucket numbers of whole texts; ``toxic`` holds 0 and 1."""
    net = _fresh(settings, docs, toxic)
    rng = np.random.default_rng(settings.seed + 1)
    squares = [np.full_like(net.embedding, 1e-2), [np.full_like(w, 1e-2) for w in net.filters], [np.full_like(b, 1e-2) for b in net.bias], np.full_like(net.out, 1e-2)]
    out_square, each, rate = 1e-2, settings.filters, settings.rate
    columns = np.arange(each)
    weight = np.where(toxic == 1, 1.0, 0.5 + 0.5 * toxic.mean())
    edge = max(settings.widths) - 1
    for _ in range(settings.epochs):
        for d in rng.permutation(len(docs)):
            buckets = docs[d]
            n = len(buckets)
            if not n:
                continue
            x = np.zeros((n + 2 * edge, settings.size), np.float32)
            x[edge : edge + n] = net.embedding[buckets].sum(axis=1)
            features, at = np.zeros(each * len(net.filters), np.float32), []
            for w, (weights, bias) in enumerate(zip(net.filters, net.bias, strict=True)):
                width = len(weights)
                lo, hi = edge - width + 1, edge + n  # every window that holds a word
                value = sum(x[lo + j : hi + j] @ weights[j] for j in range(width)) + bias
                top = value.argmax(axis=0)
                at.append(top + lo)
                features[w * each : (w + 1) * each] = np.maximum(value[top, columns], 0)
            p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias, -30, 30)))
            slope = (p - toxic[d]) * weight[d]
            if abs(slope) < 1e-3:
                continue
            back = slope * net.out
            step = slope * features
            squares[3] += step**2
            net.out = np.maximum(net.out - rate * step / np.sqrt(squares[3]), 0)  # features only add to the evidence
            out_square += slope**2
            net.out_bias -= rate * slope / out_square**0.5
            for w, top in enumerate(at):
                live = np.flatnonzero(features[w * each : (w + 1) * each] > 0)
                if not len(live):
                    continue
                g = back[w * each : (w + 1) * each][live]
                weights = net.filters[w]
                squares[2][w][live] += g**2
                net.bias[w][live] -= rate * g / np.sqrt(squares[2][w][live])
                for j in range(len(weights)):
                    where = top[live] + j
                    dx = weights[j][:, live].T * g[:, None]
                    dw = x[where].T * g
                    squares[1][w][j][:, live] += dw**2
                    weights[j][:, live] -= rate * dw / np.sqrt(squares[1][w][j][:, live])
                    inside = (where >= edge) & (where < edge + n)
                    rows, dx = buckets[where[inside] - edge], dx[inside]
                    for k in range(rows.shape[1]):
                        np.add.at(squares[0], rows[:, k], dx**2)
                        np.add.at(net.embedding, rows[:, k], -rate * dx / np.sqrt(squares[0][rows[:, k]]))
    return net


def calibrate(scores: np.ndarray, toxic: np.ndarray, langs: list[str], settings: Settings) -> dict[str, float]:
    """For each language with enough toxic texts, the threshold with the best F1, in the middle of its gap."""
    found: dict[str, float] = {}
    langs_ = np.array([x or "" for x in langs])
    for lang in np.unique(langs_):
        mine = langs_ == lang
        s, y = scores[mine], toxic[mine]
        if y.sum() < settings.least_calibration:
            continue
        order = np.argsort(-s, kind="stable")
        s, hits = s[order], np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
        k = int(f1.argmax())
        below = s[k + 1] if k + 1 < len(s) else 0.0
        found[str(lang)] = float(np.clip((s[k] + below) / 2, 0.05, 0.95))
    return found


def held_out() -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings = PRODUCTION) -> DataFrame:
    """The texts that training may see, each different one of a doc_id once: doc_id, lang, toxic, turn (a hash), words, buckets.

    At most ``max_toxic`` and ``max_clean`` labelled ids, in the order of a hash, without texts of over
    ``max_text_bytes``.  Words are hashed where the texts are; only bucket numbers travel.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    turn = F.md5(F.col("doc_id").cast("string").cast("binary"))
    text = F.coalesce("text", F.lit(""))
    short = docs.where(F.octet_length(text) <= settings.max_text_bytes)
    known = known.join(short.select("doc_id"), "doc_id", "left_semi")
    taken = known.where("toxic = 1").orderBy(turn).limit(settings.max_toxic).union(known.where("toxic = 0").orderBy(turn).limit(settings.max_clean))
    rows = short.select("doc_id", "lang", text.alias("text")).join(F.broadcast(taken), "doc_id")  # bounded by the settings
    schema = "doc_id bigint, lang string, toxic int, turn string, text_hash bigint, words bigint, buckets binary"

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(settings)
        for batch in batches:
            data, offsets = text_bytes(batch.column(5))
            for lo, hi in slices(offsets):
                buckets, first = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                packed = [buckets[first[k] : first[k + 1]].astype(np.int32).tobytes() for k in range(hi - lo)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(np.diff(first)), pa.array(packed, pa.binary())], ["doc_id", "lang", "toxic", "turn", "text_hash", "words", "buckets"])

    return rows.select("doc_id", "lang", "toxic", turn.alias("turn"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(hash_words), schema).dropDuplicates(["doc_id", "text_hash", "words"])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = PRODUCTION) -> Network | None:
    """None where there aren't labelled texts of both classes outside the held-out fold.

    One task of an executor trains, over bounded rows; the driver sees the finished weights alone.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str | None, np.ndarray]] = []
        total, seen = 0, {0: 0, 1: 0}
        for batch in batches:  # in the order of the hash; a text that doesn't fit any more is passed over
            for lang, toxic, words, buckets in zip(*(batch.column(k) for k in range(4)), strict=True):
                seen[toxic.as_py()] += 1
                if total + words.as_py() <= settings.max_words:
                    total += words.as_py()
                    rows.append((toxic.as_py(), lang.as_py(), np.frombuffer(buckets.as_py(), np.int32).reshape(-1, 1 + len(STEMS))))
        fitting = {toxic for toxic, _, _ in rows}
        if fitting != {y for y, n in seen.items() if n}:
            raise ValueError("max_words leaves no training text of one class")
        if len(fitting) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_trained(settings, rows))], pa.binary())], ["network"])

    known = labelled(docs, labels, settings).repartition(1).sortWithinPartitions("turn", "doc_id", "text_hash")
    made = known.select("lang", "toxic", "words", "buckets").mapInArrow(tidy(learn), "network binary").collect()
    return pickle.loads(made[0]["network"]) if made else None


def _trained(settings: Settings, rows: list[tuple[int, str | None, np.ndarray]]) -> Network:
    """Trains and calibrates on (toxic, lang, bucket numbers)."""
    toxic = np.array([y for y, _, _ in rows])
    # every fifth text of a class calibrates, the others train
    turn = np.zeros(len(toxic), np.int64)
    for y in (0, 1):
        turn[toxic == y] = np.random.default_rng(settings.seed + y).permutation(int((toxic == y).sum()))
    learn = turn % 5 > 0
    if len(set(toxic[learn].tolist())) < 2:
        learn[:] = True
    net = fit(settings, [buckets for (_, _, buckets), on in zip(rows, learn, strict=True) if on], toxic[learn].astype(np.float64))
    check = np.flatnonzero(~learn)
    scores = np.concatenate([net._scores(rows[k][2].astype(np.int64), np.array([0, len(rows[k][2])])) for k in check]) if len(check) else np.zeros(0)
    net.thresholds = calibrate(scores, toxic[check], [rows[k][1] for k in check], settings)
    return net


def _batch_scores(net: Network | None, text: pa.Array) -> np.ndarray:
    return net.scores(*text_bytes(text)) if net else np.zeros(len(text))


def _rejects(net: Network | None, scores: np.ndarray, langs: list[str | None]) -> np.ndarray:
    if net is None:
        return np.zeros(len(scores), bool)
    return scores >= np.array([net.thresholds.get(x or "", net.settings.threshold) for x in langs])


def scored(docs: DataFrame, net: Network | None, threshold: float = PRODUCTION.threshold) -> DataFrame:
    """doc_id, held_out, score, predicted (by ``threshold``), rejected (by the language's threshold)."""
    kept = docs.select("doc_id", "lang", "text", held_out().alias("held_out"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _batch_scores(net, batch.column(2))
            columns = [batch.column(0), batch.column(3), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(_rejects(net, scores, batch.column(1).to_pylist()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "rejected"])

    return kept.mapInArrow(tidy(score), "doc_id bigint, held_out boolean, score double, predicted int, rejected boolean")


def clean_only(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")
    schema = ", ".join(f"_doc_{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = _rejects(net, _batch_scores(net, batch.column(text)), batch.column(lang).to_pylist())
            yield batch.filter(pa.array(~rejected))

    return docs.toDF(*[f"_doc_{k}" for k in range(len(names))]).mapInArrow(tidy(keep), schema).toDF(*names)
