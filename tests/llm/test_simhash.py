from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash as S
from lectern.llm.common import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    counts = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints, ids, budget=2):
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[root(i)] = root(j)
    named = {}
    for k, i in enumerate(ids):
        if i is not None:
            named[root(k)] = min(named.get(root(k), i), i)
    return [named.get(root(k)) for k in range(len(prints))]


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in S.grouped(spark.createDataFrame(docs)).withColumn("hex", S.hex_digits(F.col("f0"))).collect()}
    prints = [plain_fingerprint(d["text"]) for d in docs]
    want = plain_components(prints, [d["doc_id"] for d in docs])
    assert [got[d["doc_id"]]["hex"] for d in docs] == ["%016x" % p for p in prints]
    assert [got[d["doc_id"]]["component_id"] for d in docs] == want


def test_hard_rows(spark, make):
    rows = [(5, None), (4, ""), (9, " \t\n"), (7, "One"), (8, "oNE"), (3, "a b"), (None, "a b"), (2, "x y z w"), (2, "x y z w"), (6, "É b c"), (10, "é b c"), (None, "only null")]
    got = S.grouped(make(rows)).select("doc_id", S.hex_digits(F.col("f0")).alias("hex"), "component_id").collect()
    want = plain_components([plain_fingerprint(t) for _, t in rows], [i for i, _ in rows])
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, "%016x" % plain_fingerprint(t), c)) for (i, t), c in zip(rows, want, strict=True))
    assert S.grouped(make([])).count() == 0


def clouds(rng, n):
    """Fingerprints in chains and balls, so that groups are large and components long."""
    out = set()
    for _ in range(n // 40):
        one = rng.getrandbits(64)
        for _ in range(20):
            one ^= 1 << rng.randrange(64)
            out.add(one)
            out.add(one ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    return sorted(out)


@pytest.mark.parametrize("dense", [4_096, 3])
def test_links_lose_nothing(spark, monkeypatch, dense):
    monkeypatch.setattr(S, "DENSE", dense)
    prints = clouds(random.Random(dense), 600)
    signed = [S._signed(p) for p in prints]
    frame = spark.createDataFrame([(p, p) for p in signed], "id bigint, f0 bigint")
    roots = {r["node"]: r["root"] for r in components(S.links(frame, S.EXACT, len(prints))).collect()}
    want = plain_components(prints, signed)
    assert [roots.get(p, p) for p in signed] == want


def test_pigeonring_passes_every_close_pair():
    rng = random.Random(7)
    places = S.Places(S.EXACT, 1)
    for _ in range(500):
        one = rng.getrandbits(64)
        other = one ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3)))
        pair = np.array([[one], [other]], np.uint64)
        keys = places.keys(pair)
        assert any(keys[0, p] == keys[1, p] and len(places.linked(p, pair[0], pair[1:])) for p in range(keys.shape[1]))
        far = one ^ sum(1 << b for b in rng.sample(range(64), 3))
        assert not any(len(places.linked(p, pair[0], np.array([[far]], np.uint64))) for p in range(keys.shape[1]))


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 70), (70, 90), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {90: 70, 100: 70}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts(spark, make):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [[word() for _ in range(300)] for _ in range(150)]
    rows, pairs = [(2 * k, " ".join(b)) for k, b in enumerate(base)], []
    for k, b in enumerate(base):
        copy = list(b)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(300)] = word()
        rows.append((2 * k + 1, " ".join(copy)))
        pairs.append((2 * k, jaccard(" ".join(b), " ".join(copy))))
    got = {r["doc_id"]: r["component_id"] for r in S.grouped(make(rows), S.SIMILAR).collect()}
    near = [k for k, j in pairs if j >= 0.8]
    assert len(near) > 100
    assert sum(got[k] == got[k + 1] for k in near) >= 0.95 * len(near)
    assert len(set(got.values())) >= 150  # different texts stay apart


def test_one_of_each(spark, make):
    text = " ".join(f"w{k}" for k in range(60))
    docs = make([(4, text), (2, text), (2, text), (9, "other words here"), (None, "null id"), (None, "null id"), (7, None), (6, "")])
    out = S.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted([("2", text), ("9", "other words here"), ("None", "null id"), ("6", "")])


def test_one_of_each_keeps_unrelated_texts_of_one_doc_id(spark, make):
    texts = [" ".join(f"{t}{k}" for k in range(60)) for t in "abcdef"]
    docs = make([(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (1, texts[4]), (1, texts[5]), (9, texts[5])])
    assert sorted(r["text"] for r in S.one_of_each(docs).collect()) == sorted(texts)


@pytest.mark.parametrize("n", [20_000, 300_000, 15_000_000, 1_000_000_000])
def test_recall_at_the_expected_difference_holds_at_every_size(n):
    rng = np.random.default_rng(n)
    places, bits, tries = S.Places(S.SIMILAR, n), S.SIMILAR.bits, 1_000
    flips = np.zeros((tries, bits), np.uint8)
    flips[np.arange(tries)[:, None], np.argsort(rng.random((tries, bits)), axis=1)[:, : S.SIMILAR.expected]] = 1
    ones = rng.integers(0, 2**64, (tries, S.SIMILAR.words), np.uint64)
    others = ones ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    same = places.keys(ones) == places.keys(others)
    found = np.zeros(tries, bool)
    for p in range(same.shape[1]):
        at = np.flatnonzero(same[:, p] & ~found)
        if len(at):
            found[at[places.linked(p, ones[at], others[at])]] = True
    assert found.mean() >= 0.95


def plain_similar_groups(texts, least=0.8):
    """Components of all pairs by exact similarity."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    parent, close = list(range(len(texts))), {}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for shingle in s or {None}:
            holders.setdefault(shingle, []).append(k)
    for members in holders.values():
        for i in members:
            for j in members:
                if i < j and (i, j) not in close:
                    close[i, j] = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0
    near = {p: j for p, j in close.items() if j >= least}
    for i, j in near:
        parent[root(j)] = root(i)
    return [root(k) for k in range(len(texts))], near


def test_recall_and_precision_on_given_documents(spark):
    docs = [d for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    wanted, near = plain_similar_groups([d["text"] for d in docs])
    got = {r["doc_id"]: r["component_id"] for r in S.grouped(spark.createDataFrame(docs), S.SIMILAR).collect()}
    ids = [d["doc_id"] for d in docs]
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [p for p, j in near.items() if low <= j < high]
        assert sum(got[ids[i]] == got[ids[j]] for i, j in band) >= 0.9 * len(band)
    by = {}
    for k, d in enumerate(ids):
        by.setdefault(got[d], set()).add(wanted[k])
    assert all(len(roots) == 1 for roots in by.values())  # nothing is grouped that exact similarity does not link


def test_pairs_at_the_limit(spark, make):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, near, far = [], [], []
    while min(len(near), len(far)) < 120:
        base = [word() for _ in range(400)]
        other = list(base)
        for at in rng.sample(range(400), rng.randrange(6, 14)):
            other[at] = word()
        j, k = jaccard(" ".join(base), " ".join(other)), len(rows)
        if 0.7 <= j < 0.85:
            rows += [(k, " ".join(base)), (k + 1, " ".join(other))]
            (near if j >= 0.8 else far).append(k)
    got = {r["doc_id"]: r["component_id"] for r in S.grouped(make(rows), S.SIMILAR).collect()}
    assert sum(got[k] == got[k + 1] for k in near) >= 0.9 * len(near)
    assert not any(got[k] == got[k + 1] for k in far)


def test_large_groups_are_trees(spark, make):
    rng = random.Random(22)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(k, " ".join([*base[:199], f"end{k}"])) for k in range(300)]
    frame = S.grouped(make(rows), S.SIMILAR)
    assert {r["component_id"] for r in frame.collect()} == {0}
    assert [r["doc_id"] for r in S.one_of_each(make(rows)).collect()] == [0]


def test_a_refused_edge_costs_no_link(spark, make, monkeypatch):
    """Candidates are linked as trees before their texts are compared; a bridge that is refused must not part alike texts."""
    bits = np.zeros((3, 4), np.uint64)
    bits[1, 3], bits[2, 3] = 1, 3  # 0 - 1 - 2 is the shortest tree; 0 and 2 are two bits apart
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join(f"other{k}" for k in range(100)), " ".join([*words[:99], "end"])]
    assert jaccard(texts[0], texts[2]) >= 0.8 > jaccard(texts[0], texts[1])
    frame = make(list(enumerate(texts)))

    def given(docs, scheme, keyed):
        rows = spark.createDataFrame([(k, *row) for k, row in enumerate(bits.view(np.int64).tolist())], "id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
        return docs.select("doc_id", *S._text_key(S.F.col("text"))).join(rows, S.F.col("doc_id") == rows["id"]).select("doc_id", "f0", "f1", "f2", "f3", *S.TEXT)

    monkeypatch.setattr(S, "fingerprints", given)
    assert {r["doc_id"]: r["component_id"] for r in S.grouped(frame, S.SIMILAR).collect()} == {0: 0, 1: 1, 2: 0}


def test_crossing_pairs_of_a_large_group():
    rng = np.random.default_rng(5)
    places, n = S.Places(S.SIMILAR, 20_000), 90
    prints = np.zeros((n, 4), np.uint64)
    prints[:, 0] = rng.integers(0, 2**63, n, dtype=np.uint64)
    labels = rng.integers(0, 5, n)
    got = [tuple(p) for pairs in S.crossing(places, 0, np.arange(n) * 3, prints, labels) for p in pairs.tolist()]
    want = [(3 * i, 3 * j) for i in range(n) for j in range(i + 1, n) if labels[i] != labels[j] and len(places.linked(0, prints[i], prints[j : j + 1]))]
    assert sorted(got) == want and want


def linked(n, edges):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return [root(k) for k in range(n)]


def test_alike_against_all_pairs():
    rng = random.Random(31)
    for turn in range(400):
        n, rare, sets = rng.choice([3, 10, 40, 80]), rng.choice([4, 10**6]), []
        for _ in range(rng.choice([1, 2])):
            base = [rng.randrange(10**6) for _ in range(n)]
            for _ in range(rng.randrange(1, 40)):
                copy = [*base[: max(1, n - rng.randrange(n // 2 + 1))], *(rng.randrange(10**6) for _ in range(rng.randrange(n // 3 + 1)))] if turn % 3 == 0 else list(base)
                at = rng.randrange(n)
                for k in range(at, min(len(copy), at + rng.randrange(n // 8 + 2))):
                    copy[k] = rng.randrange(rare)
                sets.append(np.unique(np.array(copy if rng.randrange(30) else [], np.uint64)))
        rng.shuffle(sets)
        plain = [set(s.tolist()) for s in sets]
        near = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])}
        edges = S.alike(sets, 0.8)
        assert {(min(e), max(e)) for e in edges} <= near
        assert linked(len(sets), edges) == linked(len(sets), near)
        assert len(edges) < len(sets)


def one_word_changed(rng, n):
    """Candidates of each other, of which only those with changes within two words of each other are similar."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts = []
    for k in range(n):
        at = 4 + 6 * rng.randrange(12)
        texts.append(" ".join([*base[:at], f"x{k}", *base[at + 1 :]]))
    return texts


@pytest.mark.parametrize("block", [None, 20_000])
def test_trees_are_linked_by_similarity(spark, make, monkeypatch, block):
    if block:
        monkeypatch.setattr(S, "BLOCK", block)  # the tree is some ten blocks then
    texts = one_word_changed(random.Random(32), 300)
    wanted, _ = plain_similar_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in S.grouped(make(list(enumerate(texts))), S.SIMILAR).collect()}
    assert [got[w] for w in wanted] == [got[k] for k in range(len(texts))]
    assert len(set(got.values())) == len(set(wanted)) == 12


def query_numbers(spark):
    queries = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [queries.apply(k).executionId() for k in range(queries.size())]


def join_rows(spark, since):
    """Rows out of each join of the queries after number ``since``."""
    store = spark._jsparkSession.sharedState().statusStore()
    out = []
    for number in [k for k in query_numbers(spark) if k > since]:
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for n in range(nodes.size()):
            metrics = nodes.apply(n).metrics()
            for m in range(metrics.size() if "Join" in nodes.apply(n).name() else 0):
                value = values.get(metrics.apply(m).accumulatorId())
                if metrics.apply(m).name() == "number of output rows" and value.isDefined():
                    out.append(int(value.get().replace(",", "")))
    return out


def test_refused_candidates_make_no_pairs(spark, make):
    """A group of candidates that are mostly not similar: joins made a row for nearly each of its 44,850 pairs."""
    docs = make(list(enumerate(one_word_changed(random.Random(33), 300))))
    since = max(query_numbers(spark), default=-1)
    S.grouped(docs, S.SIMILAR).collect()
    rows = join_rows(spark, since)
    assert rows and max(rows) <= 10 * 300  # the trees of the places have up to a few edges for each text
