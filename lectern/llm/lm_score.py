"""Language-model scores of documents by stupid backoff over the corpus's own n-gram counts.

A word's score is the count of its n-gram over the count of the n-gram's context; where
the n-gram has occurred fewer than ``min_count`` times in the whole corpus, it backs off
to the next shorter one at a factor of ``backoff``; a single word's score is its count over
all words.  The first words of a document use the context there is.  A document's score
is the sum of the logarithms.

Relationally: documents are exploded into n-grams (64-bit hashes), one row per block of
documents and n-gram with its count there; the count table, partitioned by hash, is their
aggregate; it is joined back to the rows (both in one window over the hash), and each block sums the
logarithms per document.

Scale: one plan at every size.  All n-grams of all documents are counted.  A block has an
n-gram once however often it occurs, so a very common one costs a row per block.  To the table and back
the rows of a block and bucket (a range of hashes) travel as one array: hashes and counts there, and only
the totals, in the order of the hashes, back; between, Spark explodes, counts and joins them.
Blocks hold ``block_bytes`` of text and there are as many buckets as blocks, so neither grows with the
corpus.  Arrays get shorter as blocks get more, down to one n-gram each, some three times the bytes.
Texts travel once, compressed, into blocks; that exchange serves both
counting and scoring.  Equal rows of a batch travel as one, and those of different batches go to
different blocks.  A very long text is one block and is scored whole.

Cases: words are ``[^\\x20\\x09-\\x0D]+`` as written; a null text counts as empty; texts
without words score 0 and have no mean; repeated rows count and score each for
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Poly, group_starts, mix, shuffle_partitions, slices, tidy, whole_groups, word_hashes

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Model:
    order: int = 2
    min_count: int = 1
    backoff: float = 0.4
    block_bytes: int = 4 << 20


#: The model of the SQL.
PRODUCTION = Model()
#: Contexts of two words.
TRIGRAM = Model(order=3)


def planes(values: np.ndarray) -> bytes:
    """Eight-byte values as byte planes, which compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.int64)


def bucket_edges(n_buckets: int) -> np.ndarray:
    """Where each of so many equal ranges of signed hashes begins."""
    return np.array([(k << 64) // n_buckets - (1 << 63) for k in range(n_buckets)], np.int64)


class Grams:
    """Hashes of the n-grams that end at each word of some compressed texts."""

    def __init__(self, packed: pa.ChunkedArray, order: int):
        open_ = zstandard.ZstdDecompressor()
        texts = [open_.decompress(z.as_py()) for z in packed]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        poly = Poly(4)
        parts, counts = [], []
        for lo, hi in slices(offsets):
            hashes, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], poly)
            parts.append(hashes)
            counts.append(np.diff(first))
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        before = np.arange(len(words)) - np.repeat(self.first[:-1], self.n_words)  # words of the document before each
        self.ends = [np.flatnonzero(before >= n - 1) for n in range(1, order + 1)]
        self.hashes = [words]
        for n in range(2, order + 1):
            at = self.ends[n - 1]
            whole = np.zeros(len(words), np.uint64)
            whole[at] = mix(self.hashes[-1][at - 1] * np.uint64(0x9E3779B97F4A7C15) + words[at] + np.uint64(n))
            self.hashes.append(whole)

    def of(self, n: int) -> np.ndarray:
        return self.hashes[n - 1][self.ends[n - 1]]


def blocks_of(docs: DataFrame, n_blocks: int) -> DataFrame:
    """block, doc_id, n_same, z: the texts, compressed; equal rows of a batch are one."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, data = batch.column(0).to_pylist(), batch.column(1)
            keys = np.stack([batch.column(k).to_numpy() for k in (2, 3)], axis=1).view(np.uint64)
            salt = keys.sum(dtype=np.uint64)  # of the batch: equal rows of different batches part
            same: dict[tuple, list[int]] = {}
            for k, key in enumerate(map(tuple, keys.tolist())):
                same.setdefault((ids[k], key), []).append(k)
            rows = [members[0] for members in same.values()]
            block = (mix(keys[rows, 0] + mix(keys[rows, 1] + salt)) % np.uint64(n_blocks)).astype(np.int32)
            packed = [press.compress((data[k].as_py() or "").encode()) for k in rows]
            columns = [pa.array(block), batch.column(0).take(pa.array(rows, pa.int64())), pa.array([len(m) for m in same.values()], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "n_same", "z"])

    whole = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64("doc_id", whole), F.xxhash64(F.lit(7), whole)).mapInArrow(tidy(deal), "block int, doc_id bigint, n_same bigint, z binary")


def score(docs: DataFrame, model: Model = PRODUCTION) -> DataFrame:
    """doc_id, n_words, log_score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.sum(F.octet_length(text)).alias("bytes"), F.sum(F.regexp_count(text, F.lit(WORD))).alias("words")).first()
    n_blocks = max(1, -(-(whole["bytes"] or 0) // model.block_bytes))
    all_words, order, min_count = whole["words"] or 0, model.order, model.min_count
    back = math.log(model.backoff)
    blocks = blocks_of(docs, n_blocks)

    def asked_by(table: pa.Table) -> tuple[Grams, np.ndarray, list[np.ndarray], np.ndarray]:
        """A block's n-grams: the different hashes in order, where those of each order are among them, and their counts."""
        grams = Grams(table["z"], order)
        times = np.repeat(table["n_same"].to_numpy(), grams.n_words)
        parts = [grams.of(n).view(np.int64) for n in range(1, order + 1)]
        hashes, where = np.unique(np.concatenate(parts), return_inverse=True)
        weights = np.concatenate([times[ends] for ends in grams.ends])
        counts = np.bincount(where, weights=weights, minlength=len(hashes)).astype(np.int64)
        return grams, hashes, np.split(where, np.cumsum([len(x) for x in parts])[:-1]), counts

    def count(table: pa.Table) -> pa.Table:
        _, hashes, _, counts = asked_by(table)
        at = np.append(np.searchsorted(hashes, bucket_edges(n_blocks)), len(hashes))
        full = np.flatnonzero(np.diff(at))
        bounds = pa.array(np.append(at[full], at[-1]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (hashes, counts)]
        return pa.table({"bucket": pa.array(full.astype(np.int32)), "block": pa.array(np.full(len(full), table["block"][0].as_py(), np.int32)), "hash": lists[0], "n": lists[1]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (bucket, block, total) as one array for each bucket and block."""
        for table in whole_groups(batches, ["bucket", "block"]):
            bucket, block, total = (table[c].to_numpy() for c in ("bucket", "block", "total"))
            bounds = group_starts(bucket, block)
            packed = [planes(total[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[bounds[:-1]]), pa.array(bucket[bounds[:-1]]), pa.array(packed, pa.binary())], ["block", "bucket", "totals"])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        grams, _, places, _ = asked_by(table)
        totals = [from_planes(x.as_py()) for x in answers.sort_by("bucket")["totals"]]
        total = np.concatenate(totals) if totals else np.zeros(0, np.int64)
        n_words = len(grams.hashes[0])
        logs = context = np.zeros(n_words)
        for n, where in enumerate(places, 1):
            counts = total[where]
            if n > 1:
                counts = np.where(counts >= min_count, counts, 0)
            here = np.zeros(n_words)
            here[grams.ends[n - 1]] = counts
            if n == 1:
                logs = np.log(here / max(all_words, 1), where=here > 0, out=np.zeros(n_words))
            else:
                found = np.flatnonzero(here)
                lower = logs.copy()
                lower[grams.ends[n - 1]] += back
                lower[found] = np.log(here[found] / context[found - 1])
                logs = lower
            context = here
        sums = np.zeros(len(grams.n_words))
        some = np.flatnonzero(grams.n_words)
        if len(some):
            sums[some] = np.add.reduceat(logs, grams.first[some])
        return pa.table({"doc_id": table["doc_id"], "n_same": table["n_same"], "n_words": pa.array(grams.n_words, pa.int64()), "log_score": pa.array(sums)})

    dealt = blocks.groupBy("block").applyInArrow(count, "bucket int, block int, hash array<bigint>, n array<bigint>")
    # arrays are a fraction of the rows that they become, so these are dealt more thinly than what else is shuffled
    dealt = dealt.repartition(4 * shuffle_partitions(docs.sparkSession), "bucket")
    asked = dealt.select("bucket", "block", F.inline(F.arrays_zip("hash", "n")))
    # the table's aggregate and its join to the rows are one window: what a bucket holds is in one partition, so neither shuffles again
    total = F.sum("n").over(Window.partitionBy("hash", "bucket"))
    found = asked.select("bucket", "block", "hash", total.alias("total"))
    answers = found.sortWithinPartitions("bucket", "block", "hash").select("bucket", "block", "total").mapInArrow(tidy(pack), "block int, bucket int, totals binary")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id bigint, n_same bigint, n_words bigint, log_score double")
    return scored.select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_same")), "n_words", "log_score").drop("col")


def score_sql(model: Model = PRODUCTION) -> str:
    """For order 2."""
    m = model
    return f"""
with texts as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
words as (select r, unnest(ws) as w, unnest(range(len(ws))) as k from texts),
pairs as (select r, k, w, lag(w) over (partition by r order by k) as v from words),
ones as (select w, count(*) as c from words group by w),
twos as (select v, w, count(*) as c from pairs where v is not null group by v, w having count(*) >= {m.min_count}),
n as (select count(*) as n from words),
logs as (
  select p.r, case when p.v is null then ln(o.c / n.n) when t.c is not null then ln(t.c / o1.c) else ln({m.backoff}) + ln(o.c / n.n) end as s
  from pairs p cross join n join ones o on o.w = p.w left join ones o1 on o1.w = p.v left join twos t on t.v = p.v and t.w = p.w)
select doc_id, cast(len(ws) as bigint) as n_words, round(coalesce(sum(s), 0), 3) as log_score
from texts left join logs using (r) group by texts.r, doc_id, ws"""
