"""Helpers shared by the training-data operators.

Text is handled as the UTF-8 bytes that Arrow already holds: a batch of texts is
one byte buffer and its offsets, so tokenising and hashing are numpy operations
over the whole buffer and not loops over Python strings.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker (whole documents).
SLICE_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and intermediate tables: the session's.

    Where it is unset and everything runs in one process (tests), a temporary one; on a cluster such a
    folder would be another one on each machine, so there it is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tidy(mapper: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapper`` for a worker that lives on after it: freed memory goes back to the system, not to the worker's next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapper(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of whole documents of about ``limit`` bytes each; a longer document comes alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each document (len+1).

    ``between``: another table of the bytes between words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = between[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, space[:-1]
    before |= border[:n]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    after |= border[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all of them."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)
    return h


class Poly:
    """Prefix polynomial hashes modulo 2**64 of byte strings.

    Bytes are first mapped to random 64-bit values.  As the base is odd it has an
    inverse, so the hash of any substring is two lookups and two products.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = (int(rng.integers(0, 2**62)) << 3 | 5) & (2**64 - 1)
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(2 * len(self.up), n + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Of bytes, or of 64-bit symbols as they are."""
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.values[data] if data.dtype == np.uint8 else data) * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; position-free, not mixed."""
        return (prefix[ends] - prefix[starts]) * self.down[starts]

    def every(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes."""
        n = max(0, len(prefix) - k)
        return (prefix[k:] - prefix[:n]) * self.down[:n]


#: Polynomials modulo 2**64 tell apart what is no longer than this; longer strings can be built to collide.
LONG = 128


def told_apart(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``hashes`` of data[start:end] with those of long strings replaced by digests."""
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        made = b"".join([hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        hashes[long] = np.frombuffer(made, np.uint64)
    return hashes


def word_hashes(data: np.ndarray, offsets: np.ndarray, poly: Poly) -> tuple[np.ndarray, np.ndarray]:
    """A mixed 64-bit hash of each word, and the first word of each document (len+1)."""
    starts, ends, first = word_spans(data, offsets)
    return told_apart(mix(poly.spans(poly.prefix(data), starts, ends)), data, starts, ends), first


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no group of equal ``keys`` is split between tables."""
    carry: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table, same = pa.Table.from_batches([batch]), np.ones(batch.num_rows, bool)
        for key in keys:
            values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last or carry and any(carry[-1][k][-1] != table[k][0] for k in keys):
            head = pa.concat_tables([*carry, table.slice(0, last)]) if last else pa.concat_tables(carry)
            carry = [table.slice(last)]
            yield head
        else:
            carry.append(table)
    if carry:
        yield pa.concat_tables(carry)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours begins, and the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), n)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b bigint): root is the smallest node that it is linked with.

    Alternates two steps until nothing changes: each node passes its smallest neighbour
    to its larger ones, then to its smaller ones.  Both are aggregates and joins over the
    edges, cut after each round.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).union(pairs.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = cut(large)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v <> u").distinct()
        small = cut(small)
        # a fixed point is a forest of stars: every node has one edge, and no root is a node
        facts = small.agg(F.count("*").alias("n"), F.countDistinct("v").alias("nodes")).first()
        if facts["n"] == facts["nodes"] and not small.join(small.select(F.col("v").alias("u")), "u", "left_semi").head(1):
            return small.select(F.col("v").alias("node"), F.col("u").alias("root"))
        pairs = small
