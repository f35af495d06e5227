"""Removal of long repeated passages by a hash-compared suffix sort.

A text is a row of symbols, :data:`BYTES` or :data:`WORDS`.  Every symbol covered by a string
of ``length`` symbols that also starts anywhere else, in the same document or another, is
removed; strings are judged on the input.

1. Anchors.  Each window of ``length`` symbols has an anchor: the substring of ``gram`` symbols
   in it with the smallest hash.  Equal windows have equal anchors, so windows with different
   anchors need not be compared.  Neighbouring windows with equal anchors form a run;
   a run's windows together are its segment of the text.  Runs whose anchor occurs once
   are done with.
2. Equal segments are counted as one; all of their windows are repeated.  They are told by a
   keyed 128-bit BLAKE2 digest of their bytes, not by the polynomial hashes, which collide on
   Thue-Morse patterns whatever their base.
3. Where an anchor has several different segments, or repeats within one, the suffixes
   that start at their windows are sorted: a mergesort whose comparisons find the common
   extension of two suffixes by binary search over prefix polynomial hashes.  Neighbours in
   that order that agree over ``length`` symbols are checked byte by byte and marked.
4. Marked windows go back to all texts with that segment and are cut out.

Scale: the text is scanned twice for anchors (one in some 140 bytes, of a few dozen
bytes each).  Equal texts are one from then on: a text travels once per different text,
compressed, and serves both the sort and the cutting.  Nothing grows with the number of
pairs.  Copies collapse in partial aggregates.  An anchor with more than ``GROUP_SEGMENTS``
different segments is dealt out further by the hash of each window, which equal windows share.
Documents of over ``CHUNK`` symbols are scanned in overlapping chunks.

Cases: a null text counts as empty; texts shorter than ``length`` are left alone; rows with
equal doc_id and text are separate documents and so repeat each other; a null doc_id is
carried along; an empty table gives an empty result; :func:`cut_out` carries all other
columns, whatever their names.  A character of which only some bytes are removed goes
altogether when the rest is stored as text.  Words are ``[^\\x20\\x09-\\x0D]+``, compared without
what stands between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, Poly, cut, group_starts, mix, shuffle_partitions, slices, text_bytes, tidy, told_apart, whole_groups, word_spans

LENGTH, GRAM = 400, 128
CHUNK = 2 << 20
SCAN = 1 << 17  # bytes scanned at once: what fits a core's cache
GROUP_SEGMENTS = 4_096
SORT_WINDOWS = 1 << 18
SEGMENT_BYTES = 1 << 20  # of segments handed on at once
_PLACE = np.uint64((1 << 24) - 1)
_KEY = b"segments"


@dataclass(frozen=True)
class Unit:
    number: int
    length: int  # symbols of a repeated string
    gram: int  # symbols of an anchor


BYTES = Unit(0, LENGTH, GRAM)
#: A passage of fifty words, however few bytes they take.
WORDS = Unit(1, 50, 8)
UNITS = (BYTES, WORDS)

TEXT = ["th", "tk"]
RUNS = "th bigint, tk bigint, unit int, s int, n int, h bigint, d1 bigint, d2 bigint, twice boolean"
SEGMENT = ["unit", "h", "n", "d1", "d2"]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


class Symbols:
    """Texts as symbols: ``values`` (bytes, or hashes of words), the first of each text, and the bytes of any stretch of them.

    The bytes of words are joined by single spaces.
    """

    def __init__(self, unit: Unit, data: np.ndarray, offsets: np.ndarray, poly: Poly, prefix: np.ndarray | None = None):
        """``prefix``: the data's, where it is known already."""
        self.unit, self.data, self.offsets, self._poly, self._prefix = unit, data, offsets, poly, prefix
        if unit.number == BYTES.number:
            return
        starts, ends, self.offsets = word_spans(data, offsets)
        self.spans = starts, ends
        sizes = ends - starts
        self._ends = np.cumsum(sizes + 1) - 1
        self._starts = self._ends - sizes

    @cached_property
    def values(self) -> np.ndarray:
        if self.unit.number == BYTES.number:
            return self.data
        starts, ends = self.spans
        prefix = self._poly.prefix(self.data) if self._prefix is None else self._prefix
        return told_apart(mix(self._poly.spans(prefix, starts, ends)), self.data, starts, ends)

    @cached_property
    def plain(self) -> np.ndarray:
        if self.unit.number == BYTES.number:
            return self.data
        plain = np.full(int(self._ends[-1]) + 1 if len(self._ends) else 0, 0x20, np.uint8)
        letters = np.ones(len(plain), bool)
        letters[self._ends] = False
        plain[letters] = self.data[~SPACE[self.data]]
        return plain

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``plain`` the symbols a .. b - 1 stand."""
        return (a, b) if self.unit.number == BYTES.number else (self._starts[a], self._ends[b - 1])


def find_runs(unit: Unit, values: np.ndarray, offsets: np.ndarray, poly: Poly, prefix: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The runs of some texts: arrays first symbol, number of windows, anchor hash, whether the anchor repeats in it.

    ``prefix``: that of ``values``, where it is known already.
    """
    if len(values) < unit.length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = mix(poly.every(poly.prefix(values) if prefix is None else prefix, unit.gram) + np.uint64(unit.number << 32))
    least = grams & ~_PLACE
    least |= np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_minimum(least, unit.length - unit.gram + 1) & _PLACE).view(np.int64)
    # runs begin with a text's first window or where the anchor moves to another string; only there hashes are looked at
    moved = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    text = np.searchsorted(offsets, moved, side="right") - 1
    moved = moved[(moved + unit.length <= offsets[text + 1]) & (moved > offsets[text])]
    same = grams[anchor[moved]] == grams[anchor[moved - 1]]
    starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) >= unit.length], moved[~same]]))
    twice = np.zeros(len(starts), bool)
    twice[np.searchsorted(starts, moved[same], side="right") - 1] = True
    last = offsets[np.searchsorted(offsets, starts, side="right")] - unit.length + 1
    n = np.minimum(np.append(starts[1:], len(values)), last) - starts if len(starts) else starts
    return starts, n, grams[anchor[starts]], twice


def digests(symbols: Symbols, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of the segments of runs: (runs, 2) bigints."""
    a, b = symbols.bounds(starts, starts + n + symbols.unit.length - 1)
    view = memoryview(np.ascontiguousarray(symbols.plain))
    made = b"".join([hashlib.blake2b(view[x:y], digest_size=16, key=_KEY).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def runs(keyed: DataFrame, units: tuple[Unit, ...], told: bool) -> DataFrame:
    """See :data:`RUNS`, without ``told`` only h and twice; ``keyed`` has th, tk, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Poly(1)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            keys = [batch.column(k).to_numpy() for k in range(2)]
            for lo, hi in slices(offsets, SCAN):
                here = data[offsets[lo] : offsets[hi]]
                prefix = poly.prefix(here)
                for unit in units:
                    symbols = Symbols(unit, here, offsets[lo : hi + 1] - offsets[lo], poly, prefix)
                    size = int(symbols.offsets[-1])
                    step = CHUNK if hi - lo == 1 else max(size, 1)
                    for base in range(0, size - unit.length + 1, step):
                        upto = min(base + step + unit.length - 1, size)
                        known = prefix if unit.number == BYTES.number and upto - base == size else None
                        s, n, h, twice = find_runs(unit, symbols.values[base:upto], symbols.offsets if hi - lo > 1 else np.array([0, upto - base]), poly, known)
                        s = s + base
                        if not told:
                            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(twice)], ["h", "twice"])
                            continue
                        doc = np.searchsorted(symbols.offsets, s, side="right") - 1
                        d = digests(symbols, s, n)
                        numbers = [*[k[lo + doc] for k in keys], np.full(len(s), unit.number, np.int32), (s - symbols.offsets[doc]).astype(np.int32), n.astype(np.int32), h.view(np.int64), d[:, 0].copy(), d[:, 1].copy()]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(twice)], [x.strip().split(" ")[0] for x in RUNS.split(",")])

    return keyed.mapInArrow(tidy(scan), RUNS if told else "h bigint, twice boolean")


class SuffixSort:
    """Sorts the suffixes of a row of symbols that start at given positions, by their first ``unit.length`` symbols.

    ``starts`` come in groups (``bounds``) and are sorted within them.  ``data`` holds the symbols;
    ``symbols`` their bytes, where they aren't bytes themselves.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, bounds: np.ndarray, poly: Poly, symbols: Symbols | None = None):
        self.symbols = symbols or Symbols(BYTES, data, np.array([0, len(data)]), poly)
        self.data, self.starts, self.bounds, self.poly, self.length = data, starts, bounds, poly, self.symbols.unit.length
        self.prefix = poly.prefix(data)
        if data.dtype == np.uint8:  # suffixes are told apart by their first symbols before the mergesort
            padded = np.concatenate([data, np.zeros(8, np.uint8)])
            self.head, self.known = np.ndarray(len(data) + 1, dtype=">u8", buffer=padded.tobytes(), strides=(1,))[starts].astype(np.uint64), 8
        else:
            self.head, self.known = data[starts], 1
        self.full = poly.spans(self.prefix, starts, starts + self.length)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, less than the whole, of positions whose suffixes differ."""
        lo, hi = np.full(len(a), self.known), np.full(len(a), self.length)
        while len(a) and (hi - lo).max() > 1:
            mid = (lo + hi) >> 1
            equal = self.poly.spans(self.prefix, a, a + mid) == self.poly.spans(self.prefix, b, b + mid)
            lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid)
        return lo

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffix numbers with the same head."""
        sign = np.zeros(len(a), np.int8)
        open_ = np.flatnonzero(self.full[a] != self.full[b])
        if len(open_):
            p, q = self.starts[a[open_]], self.starts[b[open_]]
            common = self.extension(p, q)
            u, v = self.data[p + common], self.data[q + common]
            sign[open_] = (u > v).astype(np.int8) - (u < v).astype(np.int8)
        return sign

    def order(self) -> np.ndarray:
        """Suffix numbers in order.

        Suffixes of equal hashes take one place.  Groups are split by their suffixes' heads, then a bottom-up
        mergesort orders all parts at once.
        """
        group = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        alike, places = self._alike(group)
        first = alike[places[:-1]]
        order = first[np.lexsort((self.head[first], group[first]))]
        parts = group_starts(group[order], self.head[order])
        sizes = np.diff(parts)
        low, high = np.repeat(parts[:-1], sizes), np.repeat(parts[1:], sizes)
        run, largest = 1, int(sizes.max(initial=0))
        while run < largest:
            place = np.flatnonzero(high - low > run)
            base, end = low[place], high[place]
            block = (place - base) // run
            other = base + (block ^ 1) * run
            lo, hi = np.minimum(other, end), np.minimum(other + run, end)
            from_, right = lo.copy(), (block & 1).astype(bool)
            mine = order[place]
            live = np.flatnonzero(lo < hi)
            while len(live):  # how many of the other block come before each suffix
                mid = (lo[live] + hi[live]) >> 1
                sign = self.compare(order[mid], mine[live])
                before = np.where(right[live], sign <= 0, sign < 0)
                lo[live] = np.where(before, mid + 1, lo[live])
                hi[live] = np.where(before, hi[live], mid)
                live = live[lo[live] < hi[live]]
            target = base + (block >> 1) * 2 * run + (place - base - block * run) + (lo - from_)
            merged = order.copy()
            merged[target] = mine
            order, run = merged, run * 2
        if len(order) == len(alike):
            return order
        place = np.empty(len(group), np.int64)
        place[first] = np.arange(len(first))
        place = place[order]
        sizes = np.diff(places)[place]
        before = np.cumsum(sizes) - sizes
        return alike[np.repeat(places[place] - before, sizes) + np.arange(len(alike))]

    def _alike(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix numbers, those of one group with equal hashes of the whole length side by side and in rising order, and where each such set begins."""
        if not len(group):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        place = np.uint64((1 << len(group).bit_length()) - 1)
        keys = self.full & ~place
        keys |= np.arange(len(group), dtype=np.uint64)
        keys.sort()
        alike = (keys & place).view(np.int64)
        full, of = self.full[alike], group[alike]
        near = (keys[1:] ^ keys[:-1]) <= place
        if (near & ((full[1:] != full[:-1]) | (of[1:] != of[:-1]))).any():  # the upper bits have not told all apart
            alike = np.lexsort((self.full, group))
            full, of = self.full[alike], group[alike]
        return alike, group_starts(full, of)

    def repeated(self) -> np.ndarray:
        """Which suffixes agree with another of their group over the whole length."""
        order, marked = self.order(), np.zeros(len(self.starts), bool)
        if len(order) < 2:
            return marked
        near = np.ones(len(order) - 1, bool)
        near[self.bounds[1:-1] - 1] = False
        at = np.flatnonzero(near & (self.full[order[1:]] == self.full[order[:-1]]))
        if not self._verified(self.starts[order[at]], self.starts[order[at + 1]]):
            return self._by_bytes()
        marked[order[at]] = marked[order[at + 1]] = True
        return marked

    def _verified(self, p: np.ndarray, q: np.ndarray) -> bool:
        """Whether windows with equal hashes have equal bytes: the bytes themselves have the last word.

        Pairs of windows that overlap at the same distance are compared as one pair of stretches.
        """
        if not len(p):
            return True
        away = q - p
        order = np.lexsort((p, away))
        p, away = p[order], away[order]
        new = np.flatnonzero(np.r_[True, (away[1:] != away[:-1]) | (p[1:] > p[:-1] + self.length)])
        lo, hi, away = p[new], p[np.r_[new[1:], len(p)] - 1] + self.length, away[new]
        (a, b), (c, d), text = self.symbols.bounds(lo, hi), self.symbols.bounds(lo + away, hi + away), self.symbols.plain.tobytes()
        return all(text[w:x] == text[y:z] for w, x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True))

    def _by_bytes(self) -> np.ndarray:
        """The same by plain bytes, for the case that two hashes have collided."""
        seen: dict[tuple[int, bytes], list[int]] = {}
        a, b = self.symbols.bounds(self.starts, self.starts + self.length)
        for g in range(len(self.bounds) - 1):
            for k in range(self.bounds[g], self.bounds[g + 1]):
                seen.setdefault((g, self.symbols.plain[a[k] : b[k]].tobytes()), []).append(k)
        marked = np.zeros(len(self.starts), bool)
        for members in seen.values():
            marked[members] = len(members) > 1
        return marked


def _segments(texts: DataFrame, wanted: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """The bytes of wanted segments, one row per bucket of their windows; starts (null: every window)."""
    schema = "unit int, h bigint, bucket int, n int, d1 bigint, d2 bigint, counted boolean, bytes binary, starts binary"
    asked = wanted.groupBy(*TEXT).agg(F.collect_list(F.struct("unit", "h", "n", "d1", "d2", "counted", "s", "buckets")).alias("asked"))
    joined = texts.join(asked, TEXT).select("z", "asked")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, other, open_ = Poly(1), Poly(3), zstandard.ZstdDecompressor()
        for batch in batches:
            bounds, asked_here = batch.column(1).offsets.to_numpy(), batch.column(1).values
            number, n, s, buckets = (asked_here.field(k).to_numpy() for k in ("unit", "n", "s", "buckets"))
            rows: list[tuple[int, int, bytes, bytes | None]] = []  # which of those asked for, bucket, bytes, starts
            held = 0

            def made(rows: list[tuple], asked_here: pa.StructArray = asked_here) -> pa.RecordBatch:
                of, bucket, found, starts = zip(*rows, strict=True)
                part = asked_here.take(pa.array(of))
                columns = {"unit": part.field("unit"), "h": part.field("h"), "bucket": pa.array(bucket, pa.int32())}
                columns |= {name: part.field(name) for name in ("n", "d1", "d2", "counted")}
                columns |= {"bytes": pa.array(found, pa.binary()), "starts": pa.array(starts, pa.binary())}
                return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

            for k, packed in enumerate(batch.column(0)):
                data = np.frombuffer(open_.decompress(packed.as_py()), np.uint8)
                for unit in units:
                    mine = bounds[k] + np.flatnonzero(number[bounds[k] : bounds[k + 1]] == unit.number)
                    if not len(mine):
                        continue
                    symbols = Symbols(unit, data, np.array([0, len(data)]), poly)
                    upto = s[mine] + n[mine] + unit.length - 1
                    for a, end, lo, hi in zip(mine.tolist(), upto.tolist(), *(x.tolist() for x in symbols.bounds(s[mine], upto)), strict=True):
                        found = symbols.plain[lo:hi].tobytes()
                        if buckets[a] == 1:
                            parts = [(a, 0, found, None)]
                        else:
                            bucket = mix(other.every(other.prefix(symbols.values[s[a] : end]), unit.length)) % np.uint64(buckets[a])
                            parts = [(a, int(b), found, np.flatnonzero(bucket == b).astype(np.int32).tobytes()) for b in np.unique(bucket)]
                        for row in parts:
                            rows.append(row)
                            held += len(found) + len(row[3] or b"")
                            if held > SEGMENT_BYTES:
                                yield made(rows)
                                rows, held = [], 0
            if rows:
                yield made(rows)

    return joined.mapInArrow(tidy(extract), schema)


def _sorted_out(segments: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Repeated windows of segments as ranges: unit, h, n, d1, d2, lo, hi (of window starts, both included)."""
    dealt = segments.repartition(shuffle_partitions(segments.sparkSession), "unit", "h", "bucket").sortWithinPartitions("unit", "h", "bucket")
    by_number = {u.number: u for u in units}

    def mark(rows: pa.Table, poly: Poly) -> Iterator[pa.RecordBatch]:
        unit = by_number[rows["unit"][0].as_py()]
        data, offsets = text_bytes(rows["bytes"].cast(pa.large_binary()).combine_chunks().view(pa.large_string()))
        symbols = Symbols(unit, data, offsets, poly)
        n, given = rows["n"].to_numpy(), rows["starts"].to_pylist()
        inside = [np.arange(n[k]) if g is None else np.frombuffer(g, np.int32) for k, g in enumerate(given)]
        row = np.repeat(np.arange(len(n)), [len(x) for x in inside])
        inside = np.concatenate(inside).astype(np.int64)
        edges = group_starts(rows["h"].to_numpy()[row], rows["bucket"].to_numpy()[row])
        marked = SuffixSort(symbols.values, symbols.offsets[row] + inside, edges, poly, symbols).repeated() & ~rows["counted"].to_numpy(zero_copy_only=False)[row]
        at, of = inside[marked], row[marked]
        bounds = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[bounds[1:], len(at)] - 1 if len(at) else bounds
        found = rows.select(SEGMENT).take(pa.array(of[bounds]))
        yield from found.append_column("lo", pa.array(at[bounds])).append_column("hi", pa.array(at[last])).combine_chunks().to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Poly(1)
        for table in whole_groups(batches, ["unit", "h", "bucket"]):
            unit = table["unit"].to_numpy()
            bounds = group_starts(unit, table["h"].to_numpy(), table["bucket"].to_numpy())
            windows = np.concatenate([[0], np.cumsum(table["n"].to_numpy())])
            lo = 0
            while lo < len(bounds) - 1:  # whole groups of one unit, of about SORT_WINDOWS windows
                hi = max(lo + 1, int(np.searchsorted(windows[bounds], windows[bounds[lo]] + SORT_WINDOWS, side="right")) - 1)
                hi = min(hi, int(np.searchsorted(unit[bounds[:-1]], unit[bounds[lo]], side="right")))
                yield from mark(table.slice(bounds[lo], bounds[hi] - bounds[lo]), poly)
                lo = hi

    return dealt.mapInArrow(tidy(work), "unit int, h bigint, n int, d1 bigint, d2 bigint, lo bigint, hi bigint")


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two 64-bit hashes with different seeds."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("th"), F.xxhash64(F.lit(7), whole).alias("tk")]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """th, tk, z: every different text once, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            packed = [press.compress(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["th", "tk", "z"])

    keyed = docs.select(*_text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    return keyed.mapInArrow(tidy(pack), "th bigint, tk bigint, z binary").groupBy(*TEXT).agg(F.first("z").alias("z"))


def repeated_spans(docs: DataFrame, texts: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """th, tk, spans: for each text with any, the ranges [a, b) of symbols to remove, as they were found."""
    keyed = docs.select(*_text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    # written down before it is joined, so that Spark can split what a very common anchor brings to the join; likewise below
    again = cut(runs(keyed, units, False).groupBy("h").agg(F.count("*").alias("c"), F.max("twice").alias("twice")).where("c > 1 or twice").select("h"))
    kept = cut(runs(keyed, units, True).join(again, "h", "left_semi"))
    segments = cut(kept.groupBy(*SEGMENT).agg(F.count("*").alias("c"), F.min(F.struct("th", "tk", "s")).alias("one"), F.max("twice").alias("twice")))
    several = cut(segments.groupBy("h").agg(F.count("*").alias("m"), F.max("twice").alias("some_twice")).where("m > 1 or some_twice").select("h", "m"))
    wanted = segments.join(several, "h").select(*SEGMENT, (F.col("c") > 1).alias("counted"), "one.th", "one.tk", "one.s", F.ceil(F.col("m") / GROUP_SEGMENTS).cast("int").alias("buckets"))
    counted = segments.where("c > 1").select(*SEGMENT, F.lit(0).cast("bigint").alias("lo"), (F.col("n") - 1).cast("bigint").alias("hi"))
    marks = counted.union(_sorted_out(_segments(texts, wanted, units), units))
    length = F.element_at(F.create_map(*[F.lit(x) for u in units for x in (u.number, u.length)]), F.col("unit"))
    spans = kept.join(marks, SEGMENT).select(*TEXT, F.struct("unit", (F.col("s") + F.col("lo")).alias("a"), (F.col("s") + F.col("hi") + length).alias("b")).alias("span"))
    return spans.distinct().groupBy(*TEXT).agg(F.collect_list("span").alias("spans"))


def merge_spans(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges as maximal ones."""
    order = np.argsort(a, kind="stable")
    out: list[tuple[int, int]] = []
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _merged(column: pa.Array) -> Iterator[dict[int, list[tuple[int, int]]]]:
    """For each row of a spans column, its merged ranges by unit."""
    bounds, values = column.offsets.to_numpy(), column.values
    unit, a, b = (values.field(k).to_numpy() for k in range(3))
    null = column.is_null().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        lo, hi = (0, 0) if null[k] else (bounds[k], bounds[k + 1])
        yield {int(u): merge_spans(a[lo:hi][unit[lo:hi] == u], b[lo:hi][unit[lo:hi] == u]) for u in np.unique(unit[lo:hi])}


def _without(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for x, y in removed:
        kept.append(text[at:x])
        at = y
    return b"".join([*kept, text[at:]])


def digest(docs: DataFrame, units: tuple[Unit, ...] = UNITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by bytes; n_passages, n_passage_words: maximal repeated passages by words."""
    texts = distinct_texts(docs)
    spans = repeated_spans(docs, texts, units)
    schema = "th bigint, tk bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_words bigint"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, found in zip(batch.column(2), _merged(batch.column(3)), strict=True):
                text = open_.decompress(packed.as_py())
                removed, passages = found.get(BYTES.number, []), found.get(WORDS.number, [])
                rest = _without(text, removed) if removed else text
                rows.append((len(text), len(text) - len(rest), len(removed), hashlib.sha256(rest).hexdigest(), len(passages), sum(b - a for a, b in passages)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [x.strip().split(" ")[0] for x in schema.split(",")])

    measured = texts.join(spans, TEXT, "left").select(*TEXT, "z", "spans").mapInArrow(tidy(measure), schema)
    return docs.select("doc_id", *_text_key(F.col("text"))).join(measured, TEXT).drop(*TEXT)


def cut_out(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """``docs`` with the repeated passages removed from ``text``; a null text stays null."""
    names = docs.columns
    at = names.index("text")
    spans = repeated_spans(docs, distinct_texts(docs), (unit,)).toDF("_th", "_tk", "_spans")
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_doc_{k}") for k, c in enumerate(names)], *[c.alias(f"_{k}") for k, c in zip(TEXT, _text_key(F.col("text")), strict=True)])
    joined = renamed.join(spans, ["_th", "_tk"], "left").drop("_th", "_tk")
    schema = ", ".join(f"_doc_{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Poly(1)
        for batch in batches:
            null = batch.column(at).is_null().to_pylist()
            data, offsets = text_bytes(batch.column(at))
            texts: list[str | None] = []
            for k, found in enumerate(_merged(batch.column(len(names)))):
                text, removed = data[offsets[k] : offsets[k + 1]], found.get(unit.number, [])
                if removed and unit.number == WORDS.number:
                    starts, ends = Symbols(unit, text, np.array([0, len(text)]), poly).spans
                    removed = [(int(starts[a]), int(ends[b - 1])) for a, b in removed]
                texts.append(None if null[k] else _without(text.tobytes(), removed).decode("utf-8", "ignore"))
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [f"_doc_{k}" for k in range(len(names))])

    return joined.mapInArrow(tidy(rewrite), schema).toDF(*names)
