"""SimHash near-duplicates with pigeonring filtering.

A fingerprint bit is set when it is set in over half of the document's shingle
hashes.  Fingerprints within a budget of differing bits are linked, and linked ones form
components.  The bits are cut into a ring of segments.  If two fingerprints differ in
at most ``budget`` bits, some chain of consecutive segments starts so that its
first 1, 2, ... segments together stay within their proportional part of the budget.
The chain's first segments, whose part rounds down to no difference, are the index key;
the following segments' cumulative differences prune candidates before the full
Hamming check.

:data:`EXACT` (64 bits, budget 2, seven segments) loses no link.  :data:`SIMILAR` finds
texts with a similarity of 0.8 or more on five-word shingles: there such a pair differs
in about 15 % of the bits (``expected``), more than any selective key can guarantee, so the key
is an exact run of bits at many places; its length follows the number of documents so that
chance candidates stay in proportion to it.  Places are disjoint runs of one order of the 256
bits after another, and their number follows from the probability that one of them is
without a difference, so the recall asked for holds at every size.  The budget leaves room for
how a similarity of 0.8 scatters in 256 bits; what the chains and the Hamming check let
through is a candidate.  Candidates form trees, and inside a tree the texts' shingle sets decide:
whatever two texts of it have a similarity of 0.8 or more end in one group (:func:`alike`), so a
candidate that is refused costs no link.

Scale: equal texts (equal fingerprints for :data:`EXACT`) are one before anything is joined, so
thousands of copies are one row.  Keys travel as packed columns, one array per task and
partition.  Candidates are groups of equal (place, key); a task links a group in
place and emits the edges of a tree over it, shortest first, never its pairs.  Groups of over
``DENSE`` different 64-bit fingerprints go another exact way: two fingerprints differ in at most
two bits just when both are within one bit of some value, so each emits its 65 values and
those that share one (65 at most) are linked.  Texts travel compressed to the check of
similarities, and only those of a tree: each once, beside its tree and not beside its pairs, and what
comes back is fewer edges than texts.  A tree of over ``BLOCK`` bytes of text is dealt in blocks, and each two
blocks meet in one task, so no task holds more than two.  Components are found by joins.

Cases: null text counts as empty; texts without words have fingerprint zero and are
linked like any other, and are alike; a null doc_id never names a component unless all its
documents' ids are null; repeated rows keep their number; an empty table gives an empty
result; other columns are ignored, and carried by :func:`one_of_each`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, Poly, components, cut, group_starts, mix, shuffle_partitions, tidy, whole_groups, word_hashes
from lectern.llm.suffix_dedup import TEXT, _text_key, distinct_texts

DENSE = 4_096
SMALL = 48  # members of groups whose pairs are all compared at once
PAIRS = 1 << 20  # compared at once
SPREAD = 1 << 19  # keys packed together
BLOCK = 1 << 22  # bytes of text of a tree of candidates that are one block


@dataclass(frozen=True)
class Scheme:
    shingle: int
    words: int  # 64-bit words of a fingerprint
    budget: int  # differing bits
    segments: int = 7
    recall: float = 1.0  # below 1: keys are runs of bits at as many places as this needs ..
    expected: int = 0  # .. for this many differing bits
    similarity: float = 0.0  # of the shingle sets, which decides on candidates

    @property
    def bits(self) -> int:
        return 64 * self.words


EXACT = Scheme(shingle=3, words=1, budget=2)
#: A similarity of 0.8 is a cosine of 8/9 of the shingle sets, an angle of 0.1516 half turns.
#: 39 of 256 bits then, with a deviation of 5.7; the budget holds all but one pair in 80.
SIMILAR = Scheme(shingle=5, words=4, budget=52, recall=0.97, expected=39, similarity=0.8)


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, scheme: Scheme = EXACT) -> np.ndarray:
    """The fingerprint's 64-bit words, lowest first."""
    hashes = _hashes((text or "").encode().lower().split(), scheme.shingle)
    if scheme.words > 1:
        hashes = np.unique(hashes)  # similarity is of sets
    out = np.zeros(scheme.words, np.uint64)
    for k in range(scheme.words):
        h = mix(hashes + np.uint64(k)) if scheme.words > 1 else hashes
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT, keyed: bool = False) -> DataFrame:
    """doc_id, f0 .. (bigint words of the fingerprint), and if asked the key th, tk of the text."""
    names = [f"f{k}" for k in range(scheme.words)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), scheme) for t in batch.column(1)], np.uint64).reshape(-1, scheme.words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(prints[:, k].copy().view(np.int64)) for k in range(scheme.words)], *batch.columns[2:]], ["doc_id", *names, *more])

    more = TEXT if keyed else []
    return docs.select("doc_id", "text", *(_text_key(F.col("text")) if keyed else [])).mapInArrow(tidy(make), ", ".join(f"{n} bigint" for n in ("doc_id", *names, *more)))


def ring_bounds(bits: int, segments: int) -> list[int]:
    return [round(k * bits / segments) for k in range(segments + 1)]


def chain_mask(bits: int, segments: int, start: int, length: int) -> int:
    """The bits of ``length`` consecutive segments of the ring."""
    bounds, mask = ring_bounds(bits, segments), 0
    for k in range(start, start + length):
        k %= segments
        mask |= (1 << bounds[k + 1]) - (1 << bounds[k])
    return mask


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def runs_missed(scheme: Scheme, length: int, runs: int) -> float:
    """The probability that each of so many disjoint runs has a difference, when as many bits differ as expected."""
    bits, budget = scheme.bits, scheme.expected
    return sum((-1) ** k * math.comb(runs, k) * math.comb(bits - k * length, budget) for k in range(runs + 1)) / math.comb(bits, budget)


def run_turns(scheme: Scheme, length: int) -> tuple[int, int]:
    """How many orders of the bits are cut into runs wholly, and how many runs are taken from one more."""
    runs, allowed = scheme.bits // length, 1 - scheme.recall
    whole = runs_missed(scheme, length, runs)
    turns = 0
    while whole ** (turns + 1) > allowed:
        turns += 1
    return turns, next(k for k in range(runs + 1) if whole**turns * runs_missed(scheme, length, k) <= allowed)


class Places:
    """Where keys are taken and what a candidate must fulfil before the full check."""

    def __init__(self, scheme: Scheme, n: int):
        """``n``: number of different fingerprints."""
        bits = scheme.bits
        if scheme.recall >= 1:
            m, tau = scheme.segments, scheme.budget
            exact = max(length for length in range(1, m) if length * tau // m == 0)
            self.masks = [[chain_mask(bits, m, s, exact)] for s in range(m)]
            self.chains = [[(chain_mask(bits, m, s, length), length * tau // m) for length in range(exact + 1, m)] for s in range(m)]
        else:
            share = scheme.budget / bits
            length = min(48, max(8, math.ceil(math.log2(max(n, 2))) - 1))
            orders, starts = np.random.default_rng(19), range(0, bits - length + 1, length)
            turns, rest = run_turns(scheme, length)
            # the chain's next 64 bits may exceed their part of the budget by four deviations
            loose = share * 64 + 4 * math.sqrt(64 * share * (1 - share))
            self.masks, self.chains = [], []
            for runs in [len(starts)] * turns + [rest] * (rest > 0):
                order = orders.permutation(bits).tolist()
                ring = lambda at, k, order=order: sum(1 << order[(at + i) % bits] for i in range(k))
                self.masks += [[ring(s, length)] for s in starts[:runs]]
                self.chains += [[(ring(s + length, 64), int(loose))] for s in starts[:runs]]
        self.words, self.budget = scheme.words, scheme.budget
        self._most = [most for _, most in self.chains[0]]
        self._chain_masks = [np.stack([self._split(chain[k][0]) for chain in self.chains]) for k in range(len(self._most))]

    def _split(self, mask: int) -> np.ndarray:
        return np.array([mask >> 64 * k & (2**64 - 1) for k in range(self.words)], np.uint64)

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """One 64-bit key per fingerprint and place: (n, places)."""
        out = np.empty((len(prints), len(self.masks)), np.uint64)
        for p, (mask,) in enumerate(self.masks):
            key = np.zeros(len(prints), np.uint64)
            for k, part in enumerate(self._split(mask)):
                if part:
                    key = mix(key + (prints[:, k] & part) + np.uint64(k))
            out[:, p] = key
        return out

    def close(self, place: np.ndarray, differing: np.ndarray, budget: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs pass, and their distances: chain by chain, then all bits.  ``place``: of each pair."""
        alive = np.arange(len(differing))
        for masks, most in zip(self._chain_masks, self._most, strict=True):
            count = np.bitwise_count(differing[alive] & masks[place[alive]]).sum(axis=1, dtype=np.int64)
            alive = alive[count <= most]
        distance = np.bitwise_count(differing[alive]).sum(axis=1, dtype=np.int64)
        within = distance <= (self.budget if budget is None else budget)
        return alive[within], distance[within]

    def linked(self, place: int, one: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are within the budget of ``one``."""
        return self.close(np.full(len(others), place), others ^ one)[0]


def tree(ids: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> list[tuple[int, int]]:
    """The edges of the shortest spanning trees of some groups; a and b are places in ``ids``."""
    order = np.lexsort((distance, group))
    parent: dict[int, int] = {}
    out = []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[q] = p
            out.append((int(ids[x]), int(ids[y])))
    return out


def link_group(places: Places, place: int, ids: np.ndarray, prints: np.ndarray, budgets: list[int]) -> list[tuple[int, int]]:
    """Edges that connect a large group as all its links would, at most one per member, near ones first.

    For each of the growing ``budgets``, a member is compared with all others as long as one outside
    the largest component has not had its turn; so a link between two components is always
    seen from one side.
    """
    label, edges = np.arange(len(ids)), []
    for budget in budgets:
        waiting = np.ones(len(ids), bool)
        while True:
            largest = np.bincount(label).argmax()
            turn = np.flatnonzero(waiting & (label != largest))
            if not len(turn):
                break
            one = int(turn[0])
            waiting[one] = False
            others, distance = places.close(np.full(len(ids), place), prints ^ prints[one], budget)
            for other in others[np.argsort(distance, kind="stable")]:
                if label[other] != label[one]:
                    edges.append((int(ids[one]), int(ids[other])))
                    label[label == label[other]] = label[one]
    return edges


def crossing(places: Places, place: int, ids: np.ndarray, prints: np.ndarray, labels: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs of a group that are within the budget and have different labels; ids rise.  For measuring: no stage uses it."""
    for one in range(len(ids) - 1):
        others = one + 1 + np.flatnonzero(labels[one + 1 :] != labels[one])
        if len(others):
            found = others[places.linked(place, prints[one], prints[others])]
            if len(found):
                yield np.stack([np.full(len(found), ids[one]), ids[found]], axis=1)


def links(distinct: DataFrame, scheme: Scheme, n: int) -> DataFrame:
    """Edges (a, b) between ids of different rows (id, f0 ..) that connect what is within the budget."""
    names = [f"f{k}" for k in range(scheme.words)]
    places, partitions, words = Places(scheme, n), shuffle_partitions(distinct.sparkSession), scheme.words
    n_places = len(places.masks)
    step = max(1, SPREAD // n_places)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, step).columns]
                prints = np.stack([c.view(np.uint64) for c in columns[1 : 1 + words]], axis=1)
                place = np.tile(np.arange(n_places, dtype=np.uint16), len(prints))
                key = places.keys(prints).reshape(-1)
                row = np.repeat(np.arange(len(prints)), n_places)
                bucket = mix(key + place) % np.uint64(partitions)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(partitions + 1, dtype=np.uint64))
                packed = []
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                    mine = order[lo:hi]
                    packed.append(b"".join([key[mine].tobytes(), columns[0][row[mine]].tobytes(), prints[row[mine]].tobytes(), place[mine].tobytes()]))
                full = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed[k] for k in full], pa.binary())], ["bucket", "packed"])

    dealt = distinct.select("id", *names).mapInArrow(tidy(spread), "bucket int, packed binary").repartition(partitions, "bucket").select("packed")
    dense_too = scheme.recall >= 1
    budgets = [scheme.budget] if dense_too else [scheme.budget * k // 4 for k in (1, 2, 3, 4)]
    record = 8 * (2 + words) + 2
    kinds, each_has = [np.uint64, np.int64, np.uint64, np.uint16], [1, 1, words, 1]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in kinds]
        for batch in batches:
            for blob in batch.column(0):
                data = blob.as_buffer()
                size, at = len(data) // record, 0
                for part, kind, each in zip(parts, kinds, each_has, strict=True):
                    part.append(np.frombuffer(data, kind, size * each, at))
                    at += part[-1].nbytes
        key, ids, prints, place = (np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, kinds, strict=True))
        order = np.lexsort((ids, key, place))
        return [place[order].astype(np.int64), key[order], ids[order], prints.reshape(-1, words)[order]]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, key, ids, prints = unpacked(batches)
        bounds = group_starts(place, key)
        sizes = np.diff(bounds)
        found: list[tuple[int, int]] = []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
            i, j = np.triu_indices(size, 1)
            starts = bounds[:-1][sizes == size]
            for at in range(0, len(starts), per := max(1, PAIRS // len(i))):
                lo = starts[at : at + per, None]
                a, b = (lo + i).reshape(-1), (lo + j).reshape(-1)
                alive, distance = places.close(place[a], prints[a] ^ prints[b])
                found += tree(ids, np.repeat(lo[:, 0], len(i))[alive], a[alive], b[alive], distance)
        dense = []
        for g in np.flatnonzero(sizes > SMALL):
            lo, hi = bounds[g], bounds[g + 1]
            if dense_too and hi - lo > DENSE:
                dense.append(ids[lo:hi])
            else:
                found += link_group(places, int(place[lo]), ids[lo:hi], prints[lo:hi], budgets)
        a, b = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        for members in dense:
            yield pa.RecordBatch.from_arrays([pa.array(members), pa.nulls(len(members), pa.int64())], ["a", "b"])

    edges = cut(dealt.mapInArrow(tidy(join), "a bigint, b bigint").distinct())
    near = edges.where("b is not null")
    if not dense_too or not edges.where("b is null").head(1):
        return near
    crowded = edges.where("b is null").select(F.col("a").alias("id")).distinct().join(distinct, "id")
    values = F.array(F.col("f0"), *[F.col("f0").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    hubs = crowded.select("id", F.explode(values).alias("hub")).groupBy("hub").agg(F.collect_set("id").alias("ids"))  # at most 65 ids each
    stars = hubs.where(F.size("ids") > 1).select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b")
    return near.union(stars)


def shingle_set(text: bytes, shingle: int, poly: Poly) -> np.ndarray:
    """Sorted different hashes of a text's shingles; of its whole row of words if it has fewer."""
    words, _ = word_hashes(LOWER[np.frombuffer(text, np.uint8)], np.array([0, len(text)]), poly)
    if not len(words):
        return words
    width = min(shingle, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out + words[k : k + len(out)])
    return np.unique(out)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _partnered(size: np.ndarray, shared: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets, with so many of their elements in others too, may be alike to another by these two numbers."""
    reach = shared * (1 + 1 / similarity) - size + 1e-6  # the largest partner, if it had all that is shared
    order = np.argsort(size, kind="stable")
    most = np.maximum.accumulate(reach[order])
    second = np.maximum.accumulate(np.minimum(np.append(-np.inf, most[:-1]), reach[order]))
    upto = np.searchsorted(size[order], reach[order], side="right")
    at = np.maximum(upto - 1, 0)
    itself = (np.arange(len(order)) < upto) & (reach[order] >= most[at])
    out = np.zeros(len(size), bool)
    out[order] = (upto > 0) & (np.where(itself, second[at], most[at]) >= size[order])
    return out


class _Parts:
    """Labels of what is linked so far, and the edges that did it."""

    def __init__(self, n: int):
        self.label, self.members, self.edges = np.arange(n), [[k] for k in range(n)], []
        self.largest = 0

    def link(self, a: int, b: int) -> None:
        p, q = int(self.label[a]), int(self.label[b])
        if p == q:
            return
        self.edges.append((a, b))
        if len(self.members[p]) < len(self.members[q]):
            p, q = q, p
        self.label[self.members[q]] = p
        self.members[p] += self.members[q]
        self.members[q] = []
        if len(self.members[p]) > len(self.members[self.largest]):
            self.largest = p


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect sets as all pairs of at least that similarity would, fewer than there are sets.

    Elements in one set only count for its size alone, so sets with the same others are a class: what links with
    one of them links with its smallest.  Sets that by these counts have no partner go first, until none does.
    Then a class is compared with all that hold one of its rarest elements (so many that a partner can't do without
    all of them), as long as a class with sets outside the largest part has not had its turn: a link between
    two parts is always seen from one side.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    parts = _Parts(len(sets))
    none = np.flatnonzero(size == 0).tolist()
    for k in none[1:]:
        parts.link(none[0], k)
    owner = np.repeat(np.arange(len(sets)), size)
    element = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)[1].astype(np.int32)
    left = size > 0
    while left.any():
        shared = np.bincount(element)[element] > 1
        owner, element = owner[shared], element[shared]
        alive = np.flatnonzero(left)
        gone = alive[~_partnered(size[alive], np.bincount(owner, minlength=len(sets))[alive], similarity)]
        if not len(gone):
            break
        left[gone] = False
        owner, element = owner[left[owner]], element[left[owner]]
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    classes: dict[bytes, list[int]] = {}
    alive = np.flatnonzero(left)
    for k in alive[np.argsort(size[alive], kind="stable")].tolist():
        classes.setdefault(element[bounds[k] : bounds[k + 1]].tobytes(), []).append(k)  # in the order of their values
    of = list(classes.values())
    least = np.array([c[0] for c in of], np.int64)
    n_of = np.fromiter(map(len, of), np.int64, len(of))
    start_of, everyone = np.cumsum(n_of) - n_of, np.array([k for c in of for k in c], np.int64)
    width, small = np.diff(bounds)[least], size[least]
    element = element[_ranges(bounds[least], width)]
    owner, start = np.repeat(np.arange(len(of)), width), np.cumsum(width) - width
    common_first = np.bincount(element)
    element = element[np.lexsort((element, common_first[element], owner))]  # rarest first
    holders, first = owner[np.argsort(element, kind="stable")], np.append(0, np.cumsum(common_first))
    for k in range(len(of)):
        for x in of[k][1:]:
            if width[k] < similarity * (size[x] + small[k] - width[k]):
                break
            parts.link(of[k][0], x)
    mine = np.zeros(len(common_first), bool)
    turns = np.argsort(small - width * (1 + 1 / similarity) + small, kind="stable").tolist()
    while True:
        waiting = []
        for k in turns:
            if (parts.label[of[k]] == parts.largest).all():
                waiting.append(k)
                continue
            row = element[start[k] : start[k] + width[k]]
            rare = row[: max(0, width[k] - math.ceil(similarity * small[k] - 1e-6) + 1)]
            others = np.unique(holders[_ranges(first[rare], common_first[rare])])
            others = others[(others != k) & (np.minimum(width[others], width[k]) * (1 + similarity) + 1e-6 >= similarity * (small[others] + small[k]))]
            if not len(others):
                continue
            mine[row] = True
            common = np.add.reduceat(mine[element[_ranges(start[others], width[others])]], np.cumsum(width[others]) - width[others], dtype=np.int64)
            mine[row] = False
            near = common >= similarity * (small[k] + small[others] - common)
            others, common = others[near], common[near]
            if not len(others):
                continue
            found, each = everyone[_ranges(start_of[others], n_of[others])], np.repeat(common, n_of[others])
            found = found[each >= similarity * (small[k] + size[found] - each)]
            for y in found[parts.label[found] != parts.label[least[k]]].tolist():
                parts.link(of[k][0], y)
            for x in of[k][1:]:
                if parts.label[x] != parts.label[least[k]]:
                    best = np.argmax(common * (1 + 1 / similarity) - small[others])
                    if common[best] >= similarity * (size[x] + small[others[best]] - common[best]):
                        parts.link(int(least[others[best]]), x)
        if len(waiting) == len(turns):
            return parts.edges
        turns = waiting


def similar_edges(trees: DataFrame, nodes: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Edges that connect the texts of each tree (node, root) as their similarities of at least the scheme's do.

    ``nodes`` has id and the text's key.
    """
    both = trees.select(F.col("root").alias("tree"), F.col("node").alias("id")).union(trees.select(F.col("root").alias("tree"), F.col("root").alias("id")).distinct())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [zstandard.frame_content_size(z.as_py()) for z in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64())], ["tree", "id", "z", "size"])

    keyed = nodes.select("id", *TEXT).join(both, "id").join(distinct_texts(docs), TEXT)
    texts = cut(keyed.select("tree", "id", "z").mapInArrow(tidy(measure), "tree bigint, id bigint, z binary, size bigint"))
    blocks = texts.groupBy("tree").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    meet = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != block), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j")))
    alone = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j")))
    dealt = texts.join(blocks, "tree", "left").select("tree", "id", "z", F.explode(F.coalesce(meet, alone)).alias("m")).select("tree", "m.i", "m.j", "id", "z")
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "tree", "i", "j").sortWithinPartitions("tree", "i", "j", "id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, open_ = Poly(5), zstandard.ZstdDecompressor()
        for table in whole_groups(batches, ["tree", "i", "j"]):
            bounds = group_starts(*[table[k].to_numpy() for k in ("tree", "i", "j")])
            ids, z, out = table["id"].to_numpy(), table["z"], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = [shingle_set(open_.decompress(x.as_py()), scheme.shingle, poly) for x in z.slice(lo, hi - lo)]
                out += [(ids[lo + a], ids[lo + b]) for a, b in alike(sets, scheme.similarity)]
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return cut(dealt.mapInArrow(tidy(check), "a bigint, b bigint"))


def grouped(docs: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """doc_id, the fingerprint's words and component_id, one row per row of ``docs``."""
    names = [f"f{k}" for k in range(scheme.words)]
    if scheme.similarity:
        members, rooted, keys = _similar_groups(docs, scheme)
    else:
        members, keys = cut(fingerprints(docs, scheme)), names
        distinct = cut(members.groupBy(*names).agg(F.min("doc_id").alias("first_id")).withColumn("id", F.col("f0")))
        rooted = _rooted(distinct, links(distinct, scheme, distinct.count()))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = cut(rooted.join(named, "root").select(*keys, "component_id"))
    return members.join(ids, keys).select("doc_id", *names, "component_id")


def _rooted(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``distinct`` with the root of each row's component."""
    roots = components(edges)
    return distinct.join(roots, distinct["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id")).drop("node")


def _similar_groups(docs: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows' fingerprints and text keys, the different texts with first_id and root, and the key's columns."""
    members = cut(fingerprints(docs, scheme, keyed=True))
    names = [f"f{k}" for k in range(scheme.words)]
    # the numbers are written down with the rows, so they stay as they are
    distinct = cut(members.groupBy(*TEXT, *names).agg(F.min("doc_id").alias("first_id")).withColumn("id", F.monotonically_increasing_id()))
    trees = components(links(distinct, scheme, distinct.count()))
    return members, _rooted(distinct, similar_edges(trees, distinct, docs, scheme)), TEXT


def hex_digits(word: Column) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def one_of_each(docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """``docs`` without the documents that are near-duplicates of a kept one: one row of each component stays.

    It is the one with the smallest doc_id, null last, and of these the first by a hash of the text; a null text
    counts as empty, and an empty one is kept rather than it.
    """
    names = docs.columns
    _, rooted, _ = _similar_groups(docs, scheme)
    first = F.min(F.struct(F.isnull("first_id").alias("no_id"), "first_id", *TEXT)).alias("first")
    keep = rooted.groupBy("root").agg(first).select(F.col("first.first_id").alias("_keep"), *[F.col(f"first.{k}").alias(f"_{k}") for k in TEXT])
    # the key of a text is in one component, so this leaves one doc_id and text for each; of repeated rows one stays
    renamed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"_doc_{k}") for k, c in enumerate(names)]).alias("_row"), F.col("doc_id").alias("_id"), F.isnull("text").alias("_null"), *[c.alias(f"_{k}") for k, c in zip(TEXT, _text_key(F.col("text")), strict=True)])
    kept = renamed.join(keep, [*[renamed[f"_{k}"] == keep[f"_{k}"] for k in TEXT], renamed["_id"].eqNullSafe(keep["_keep"])], "left_semi")
    return kept.groupBy(*[f"_{k}" for k in TEXT]).agg(F.min_by("_row", "_null").alias("_row")).select(*[F.col(f"_row._doc_{k}").alias(c) for k, c in enumerate(names)])
