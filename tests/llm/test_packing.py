from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing as K
from lectern.llm.queries import tokeniser

TOKENISER = tokeniser()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, docs, tokenizer, size=1024):
    want = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        head = len(ids) % size if len(ids) > size else len(ids)
        cuts = ([0] if head else []) + list(range(head, len(ids), size))
        for piece, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(str, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows))) == sorted(map(str, want))
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(r["length"] for r in rows)


def test_hard_texts(spark, make, tokenizer):
    texts = [None, "", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "a" * 5000, " \n\n  x\t", "it's we'll", "日本語 émoji 😀" * 400, "\x00\x01", " ".join("word%d" % k for k in range(3000))]
    docs = [*enumerate(texts), (2, texts[2]), (None, "null id")]
    check(K.pack(make(docs), **TOKENISER).collect(), docs, tokenizer)
    assert K.pack(make([]), **TOKENISER).count() == 0


def test_whole_table_is_nearly_full(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, total = check(K.pack(docs, **TOKENISER).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)
    assert n <= 1.005 * -(-total // 1024)


def test_several_tasks(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(K.pack(docs.repartition(5, "doc_id"), **TOKENISER, window=20, open_bins=4).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)


@pytest.mark.parametrize("open_bins", [1, 2, 7, 1000])
def test_best_fit_is_best_and_bounded(open_bins):
    rng = random.Random(open_bins)
    lengths = [rng.randrange(1, 65) for _ in range(500)]
    numbers, offsets = K.best_fit(lengths, 64, open_bins)
    used, is_open = {}, {}  # a plain version that looks at every open bin
    for length, number, offset in zip(lengths, numbers, offsets, strict=True):
        fits = [64 - used[b] for b in is_open if 64 - used[b] >= length]
        if fits:
            assert 64 - used[number] == min(fits)
        else:
            assert number not in used
            if len(is_open) >= open_bins and length < 64:
                fullest = max(used[b] for b in is_open)
                closed = next(b for b in is_open if used[b] == fullest)
                del is_open[closed]
            used[number] = 0
        assert offset == used[number]
        used[number] += length
        is_open.pop(number, None)
        is_open[number] = True  # equally full ones close in the order of their last change
        if used[number] == 64:
            del is_open[number]
        assert len(is_open) <= open_bins
    assert max(used.values()) <= 64


def test_the_bound_acts_and_sequences_are_full(spark, tokenizer):
    """The registered bound of open bins, on a table large enough to reach it."""
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(6_000).collect()]
    encode = K.Encoder(TOKENISER["ranks_path"], TOKENISER["pattern"])
    lengths = [n for text in docs for _, n in K.piece_bounds(len(encode(text or "")) + 1, 1024)]
    fit, most = K.BestFit(1024, 512), 0
    for at in range(0, len(lengths), 1024):
        for length in sorted(lengths[at : at + 1024], reverse=True):
            fit(length)
            most = max(most, fit.n_open)
    assert most == 512 and fit.n_closed > 0
    assert fit.n_bins <= 1.003 * -(-sum(lengths) // 1024)
