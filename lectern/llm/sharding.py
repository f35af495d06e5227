"""Consistent sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size
(start and stride from its name's digest).  The shards take turns, each claiming the
first slot of its order that is still free, until the table is full.  So all shards
hold the same number of slots to within one, and when a shard comes or goes few other
slots change hands.  A row is placed by hashing its key to a slot and looking the slot
up.

Native: the table is a literal of ``size`` entries, at most :data:`MAX_SLOTS`, whatever
the data; it is broadcast and joined, so placement reads only the key column and
shuffles nothing.  Only this bounded table is computed on the driver.

Cases: null keys count as the empty string and are placed; repeated rows land in the
same shard; an empty table gives an empty result; columns of the input named ``slot``
or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the broadcast table: a few MB.
MAX_SLOTS = 1_000_003
PRODUCTION_SHARDS, PRODUCTION_SLOTS = 64, 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=8)
def lookup_table(shards: tuple[str, ...], size: int) -> tuple[int, ...]:
    """The shard number of each slot."""
    if not _is_prime(size) or size < len(shards) or size > MAX_SLOTS or not shards:
        raise ValueError(f"the table's size must be a prime between the number of shards and {MAX_SLOTS}")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    at = [int(d[:15], 16) % size for d in digests]
    stride = [int(d[16:31], 16) % (size - 1) + 1 for d in digests]
    table, left = [-1] * size, size
    while left:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + stride[shard]) % size
            table[at[shard]] = shard
            left -= 1
            if not left:
                break
    return tuple(table)


def shard_names(n: int) -> tuple[str, ...]:
    return tuple(f"shard-{k}" for k in range(n))


def table_frame(spark: SparkSession, table: tuple[int, ...]) -> DataFrame:
    """The table as (slot, shard) rows."""
    entries = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(entries).alias("slot", "entry")).select(F.col("slot").cast("bigint").alias("slot"), F.col("entry").cast("int").alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(size)


def place(df: DataFrame, key: str, n_shards: int = PRODUCTION_SHARDS, size: int = PRODUCTION_SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``."""
    table = table_frame(df.sparkSession, lookup_table(shard_names(n_shards), size))
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(table), "slot", "left")


def write_shards(df: DataFrame, key: str, path: str, n_shards: int = PRODUCTION_SHARDS, files_per_shard: int = 1) -> None:
    """Writes ``df`` as one folder per shard; a shard's rows are spread over its files by slot."""
    placed = place(df, key, n_shards).withColumn("part", F.col("slot") % files_per_shard)
    placed.repartition(n_shards * files_per_shard, "shard", "part").drop("slot", "part").write.partitionBy("shard").mode("overwrite").parquet(path)


def place_sql(n_shards: int = PRODUCTION_SHARDS, size: int = PRODUCTION_SLOTS) -> str:
    entries = ",".join(map(str, lookup_table(shard_names(n_shards), size)))
    return f"""
with placed as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % {size} as slot from documents),
entries as (select string_split('{entries}', ',') as e)
select doc_id, slot, cast(e[slot + 1] as integer) as shard from placed, entries"""
