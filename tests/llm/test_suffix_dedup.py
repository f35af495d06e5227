from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from lectern.llm import suffix_dedup as S
from lectern.llm.common import Poly


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(n))


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha256) of each text by looking at every window."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for s in range(len(d) - S.LENGTH + 1):
            seen[d[s : s + S.LENGTH]] = seen.get(d[s : s + S.LENGTH], 0) + 1
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, int)
        for s in range(len(d) - S.LENGTH + 1):
            if seen[d[s : s + S.LENGTH]] > 1:
                cover[s] += 1
                cover[s + S.LENGTH] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def hard_texts():
    rng = random.Random(1)
    long, passage, other = prose(rng, 400), prose(rng, 120), prose(rng, 90)
    edited = long[:700] + "X" + long[701:]
    return [
        None, "", "short", "a" * 399, "a" * 400, "b" * 401, "b" * 900,  # empty, short, periodic
        long, long, edited, long + " tail", "head " + long,  # copies and near copies
        prose(rng, 50) + passage + prose(rng, 60), prose(rng, 20) + passage, passage + prose(rng, 30) + passage,
        other + prose(rng, 30) + other, ("xyz" * 300) + passage[:450], "yzx" * 200, passage[:399] + "!", "q" + passage[1:400],
        "é" * 300, "éé" * 150 + "z", prose(rng, 3000) + passage,
    ]


def test_against_every_window(spark, make):
    texts = hard_texts()
    got = {r["doc_id"]: tuple(r)[1:5] for r in S.digest(make(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_hot_groups_are_dealt_further(spark, make, monkeypatch):
    monkeypatch.setattr(S, "GROUP_SEGMENTS", 2)
    rng = random.Random(2)
    passage = prose(rng, 150)
    texts = [prose(rng, 30) + passage + prose(rng, 30) for _ in range(12)]
    got = {r["doc_id"]: tuple(r)[1:5] for r in S.digest(make(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_long_documents_in_chunks(spark, make, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 700)
    monkeypatch.setattr(S, "SCAN", 500)
    texts = hard_texts()
    got = {r["doc_id"]: tuple(r)[1:5] for r in S.digest(make(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_repeated_rows_and_null_ids(spark, make):
    text = prose(random.Random(3), 200)
    rows = S.digest(make([(1, text), (1, text), (None, "x" * 10), (None, text[:500])])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 0), (-1, len(text[:500].encode())), (1, len(text.encode())), (1, len(text.encode()))]
    assert S.digest(make([])).count() == 0


def test_cut_out_keeps_columns_and_characters(spark, make):
    rng = random.Random(4)
    passage = "é" * 250  # 500 bytes
    texts = [None, "z" + passage, "yy" + passage + "é tail", prose(rng, 9)]
    docs = make(list(enumerate(texts)))
    out = {r["doc_id"]: r for r in S.cut_out(docs).collect()}
    assert S.cut_out(docs).columns == docs.columns
    assert (out[0]["text"], out[1]["text"], out[2]["text"], out[3]["text"]) == (None, "z", "yy tail", texts[3])
    assert out[3]["h"] == "x"


@pytest.mark.parametrize("seed", range(5))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99 + seed, 3_000).astype(np.uint8)
    data[1000:1600] = data[100:700]
    starts = np.sort(rng.choice(len(data) - S.LENGTH, 900, replace=False))
    bounds = np.array([0, 100, 101, 500, 900])
    sort = S.SuffixSort(data, starts, bounds, Poly(1))
    order, text = sort.order(), data.tobytes()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        assert sorted(order[lo:hi]) == list(range(lo, hi))
        windows = [text[starts[k] : starts[k] + S.LENGTH] for k in order[lo:hi]]
        assert windows == sorted(windows)
    assert (sort.repeated() == sort._by_bytes()).all()


def test_colliding_hashes_are_found_out(monkeypatch):
    data = np.frombuffer(b"a" * 450 + b"b" * 450, np.uint8)
    sort = S.SuffixSort(data, np.array([0, 450]), np.array([0, 2]), Poly(1))
    sort.full[:] = 7
    sort.head[:] = 7
    assert not sort.repeated().any()


def passages(texts):
    """(maximal passages, words in them) of each text by looking at every window of fifty words."""
    words, length = [(t or "").encode().split() for t in texts], S.WORDS.length
    seen = {}
    for w in words:
        for s in range(len(w) - length + 1):
            seen[tuple(w[s : s + length])] = seen.get(tuple(w[s : s + length]), 0) + 1
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone[s : s + length] = True
        out.append((int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), int(gone.sum())))
    return out


def wordy_texts():
    rng = random.Random(5)
    passage, short = prose(rng, 51), " ".join(rng.choices("abcdefgh", k=50))
    spaced = passage.replace(" ", "\n \t", 7)
    return [*hard_texts(), prose(rng, 30) + " " + passage + " " + prose(rng, 9), spaced, "x " + short, short + " y", "a " * 49, "a " * 50, "a " * 51, "B " * 120, " ".join(passage.split()[:49])]


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 60, "SCAN": 500}, {"GROUP_SEGMENTS": 2}])
def test_passages_against_every_window(spark, make, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(S, name, value)
    texts = wordy_texts()
    got = {r["doc_id"]: (r["n_passages"], r["n_passage_words"]) for r in S.digest(make(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == passages(texts)


def test_cut_out_by_words(spark, make):
    rng = random.Random(6)
    passage = prose(rng, 60)
    docs = make([(1, "one  " + passage + "\ttwo"), (2, passage.replace(" ", "\n", 3)), (3, " ".join(passage.split()[:49])), (None, None)])
    out = {r["doc_id"]: r["text"] for r in S.cut_out(docs, S.WORDS).collect()}
    assert out == {1: "one  \ttwo", 2: "", 3: " ".join(passage.split()[:49]), None: None}


def colliding():
    """Two texts without a common string of 400 bytes whose polynomial hashes modulo 2**64 agree, whatever the base."""
    gram = min((bytes([a]) * 64 + bytes(random.Random(k).choices(range(48, 58), k=64)) for k, a in enumerate(range(65, 91))), key=len)
    morse = [bin(k).count("1") & 1 for k in range(64)]
    out = []
    for turned in (0, 1):
        text = b""
        for period in range(32):
            text += gram + bytes(b"bL"[m ^ morse[period] ^ turned] for m in morse) + bytes([97 + period % 26, 48 + period // 26]) * 32
        out.append(text.decode())
    return out


def test_colliding_polynomials_remove_nothing(spark, make):
    one, two = colliding()
    poly, lengths = Poly(1), [len(one)]
    prefix = [poly.prefix(np.frombuffer(t.encode(), np.uint8)) for t in (one, two)]
    at = np.array([0])
    assert poly.spans(prefix[0], at, at + lengths[0]) == poly.spans(prefix[1], at, at + lengths[0]) and one != two
    got = {r["doc_id"]: tuple(r)[1:5] for r in S.digest(make([(0, one), (1, two)])).collect()}
    assert [got[k] for k in range(2)] == brute([one, two])
    assert not any(n for _, n, _, _ in got.values())


class Rows:
    """Stands for a DataFrame: the function that would be mapped over it."""

    def mapInArrow(self, mapper, schema):
        return mapper

    def __getattr__(self, name):
        return lambda *columns: self


def test_a_long_text_is_not_copied_for_its_runs():
    text = prose(random.Random(7), 60_000)
    table = pa.table({"th": [1], "tk": [2], "text": [text]})
    before = pa.total_allocated_bytes()
    held = [(batch.num_rows, pa.total_allocated_bytes() - before) for batch in S.runs(Rows(), S.UNITS, True)(iter(table.to_batches()))]
    assert sum(n for n, _ in held) > 2_000
    assert max(size for _, size in held) < 8 * len(text.encode())  # one copy for each run would be over 100 million bytes


def test_overlapping_windows_are_verified_once():
    rng = np.random.default_rng(8)
    passage = rng.integers(97, 123, 20_000).astype(np.uint8)
    data = np.concatenate([passage, passage])
    at = np.arange(len(passage) - S.LENGTH + 1)
    sort = S.SuffixSort(data, np.concatenate([at, at + len(passage)]), np.array([0, 2 * len(at)]), Poly(1))
    tracemalloc.start()
    assert sort._verified(at, at + len(passage))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_096 * S.LENGTH  # what a block of windows takes as bytes
    for wrong in (0, 10_000, len(passage) - 1):
        kept, data[wrong] = data[wrong], 0
        assert not sort._verified(at, at + len(passage))
        data[wrong] = kept
    data[0] = 0
    assert sort._verified(at[1:], at[1:] + len(passage))  # no window has the first byte


def test_equal_suffixes_take_one_place(monkeypatch):
    rng = np.random.default_rng(9)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    data = np.tile(text, 40)
    starts = np.sort(np.concatenate([600 * k + np.arange(0, 200) for k in range(40)]))
    compared = []
    compare = S.SuffixSort.compare
    monkeypatch.setattr(S.SuffixSort, "compare", lambda self, a, b: compared.append(len(a)) or compare(self, a, b))
    sort = S.SuffixSort(data, starts, np.array([0, len(starts)]), Poly(1))
    order, whole = sort.order(), data.tobytes()
    assert sorted(order) == list(range(len(starts)))
    windows = [whole[starts[k] : starts[k] + S.LENGTH] for k in order]
    assert windows == sorted(windows)
    assert sum(compared) < len(starts)
    assert sort.repeated().all()


def test_hashes_that_agree_in_their_upper_bits():
    data = np.random.default_rng(10).integers(97, 123, 3_000).astype(np.uint8)
    data[1_500:2_500] = data[:1_000]
    starts = np.array([0, 5, 9, 1_500, 1_505, 1_509, 2_600])
    for bounds in ([0, 7], [0, 3, 7]):  # one group, and equal windows in two
        sort = S.SuffixSort(data, starts, np.array(bounds), Poly(1))
        sort.full = np.array([6, 5, 4, 6, 5, 4, 3], np.uint64)
        assert sort.repeated().tolist() == ([True] * 6 + [False] if len(bounds) == 2 else [False] * 7)


@pytest.mark.parametrize("limit", [1 << 20, 2_000])
def test_segments_of_many_texts_come_together(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "SEGMENT_BYTES", limit)
    rng = random.Random(11)
    texts = [prose(rng, 150) for _ in range(300)]
    fields = ["unit", "h", "n", "d1", "d2", "counted", "s", "buckets"]
    asked = [[dict(zip(fields, (u, k, 2 + u, 5, 6, u == 1, 3 + u, 1 + 2 * (k % 9 == 0)), strict=True)) for u in (0, 1)] for k in range(300)]
    types = pa.struct([pa.field(f, pa.bool_() if f == "counted" else pa.int64() if f in ("h", "d1", "d2") else pa.int32()) for f in fields])
    table = pa.table({"z": [zstandard.compress(t.encode()) for t in texts], "asked": pa.array(asked, pa.list_(types))})
    got = list(S._segments(Rows(), Rows(), S.UNITS)(iter(table.to_batches())))
    rows = [r for batch in got for r in batch.to_pylist()]
    for k, text in enumerate(texts):
        for unit, whole in ((0, text.encode()[3 : 3 + 2 + 399]), (1, b" ".join(text.encode().split()[4 : 4 + 3 + 49]))):
            here = [r for r in rows if (r["unit"], r["h"]) == (unit, k)]
            assert {(r["n"], r["d1"], r["d2"], r["counted"], r["bytes"]) for r in here} == {(2 + unit, 5, 6, unit == 1, whole)}
            if k % 9:
                assert [(r["bucket"], r["starts"]) for r in here] == [(0, None)]
            else:  # every window once
                assert sorted(x for r in here for x in np.frombuffer(r["starts"], np.int32)) == list(range(2 + unit))
    assert len(got) == 1 if limit > 2_000 else 50 < len(got) < 300
