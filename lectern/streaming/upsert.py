"""The append log as a stream: the latest record per key, kept up to date.

Each micro-batch is reduced to its latest record per key and merged with the table so
far, so a record that arrives twice or late leaves the same table as the batch query over
the whole log.  The table is split into buckets by key: a batch rewrites those that its keys fall
into and leaves the others, and what it has replaced twice over is removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.logs import latest

BUCKETS = 64


def merge(current: DataFrame | None, batch: DataFrame, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """The latest record of each key of both."""
    fresh = latest(batch, keys, pos)
    return fresh if current is None else latest(current.unionByName(fresh), keys, pos)


def keep_latest(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], pos: str = "pos", buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps ``table`` (a folder) at the latest record per key; ``buckets`` stays as it was at first.

    Each batch writes new versions of its buckets and then their numbers; a batch that is run again after a
    failure finds the versions before it.  A reader of the version before is not disturbed.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _versions(spark, table)
        if any(number in versions for versions in known.values()):
            return
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets``
        before = _read(spark, table, {b: known[b][-1] for b in touched if b in known})
        merged = merge(before, rows, [*keys, "_bucket"], pos)
        merged.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/data/_version={number}")
        if touched:
            spark.createDataFrame([(number, b) for b in touched], "version bigint, bucket int").coalesce(1).write.mode("append").json(f"{table}/_versions")
        for bucket in touched:
            for version in known.get(bucket, [])[:-1]:
                _path(spark, f"{table}/data/_version={version}/_bucket={bucket}", delete=True)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, name: str, delete: bool = False) -> bool:
    """Whether there is such a path; removes it if asked."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.delete(path, True) if delete else store.exists(path)


def _versions(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """The versions of each bucket in order: a row per batch and bucket that it touched."""
    if not _path(spark, f"{table}/_versions"):
        return {}
    rows = spark.read.schema("version bigint, bucket int").json(f"{table}/_versions").groupBy("bucket").agg(F.sort_array(F.collect_set("version")).alias("versions")).collect()
    return {r["bucket"]: r["versions"] for r in rows}


def _read(spark: SparkSession, table: str, versions: dict[int, int]) -> DataFrame | None:
    """The buckets at these versions, with ``_bucket``."""
    paths = [f"{table}/data/_version={v}/_bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.option("basePath", f"{table}/data").parquet(*paths).drop("_version") if paths else None


def current_version(spark: SparkSession, table: str) -> int | None:
    """The number of the last batch that changed the table."""
    return max((v[-1] for v in _versions(spark, table).values()), default=None)


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    found = _read(spark, table, {b: v[-1] for b, v in _versions(spark, table).items()})
    if found is None:
        raise ValueError(f"{table} has no version yet")
    return found.drop("_bucket")
