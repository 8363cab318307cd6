"""Incremental work: what changed since the last run, and keyed merges into snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.functions.text import is_blank
from quarrymill.runtime import stored


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the last by ``order``. Rows without a key are dropped; nulls in the order come first.

    Aggregates before the shuffle, so a key that holds a large share of the rows is one row per task.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    by = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(whole, by).alias("_row")).select("_row.*")


def stored_hashes(state: DataFrame, ids: DataFrame, key: str, hash_: str) -> DataFrame:
    """(key, hash) of those of ``ids`` that are stored with a hash; repeated ids count once."""
    return state.where(~is_blank(F.col(hash_))).join(ids.select(key).distinct(), key, "left_semi").select(key, hash_)


def with_status(new: DataFrame, state: DataFrame, key: str, hash_: str) -> DataFrame:
    """``new`` with ``status``: new, changed or unchanged. Stored rows without a hash count as absent."""
    old = state.where(~is_blank(F.col(hash_))).select(F.col(key).alias("_k"), F.col(hash_).alias("_h"))
    status = F.when(F.col("_h").isNull(), "new").when(F.col("_h").eqNullSafe(F.col(hash_)), "unchanged").otherwise("changed")
    return new.join(old, new[key] == F.col("_k"), "left").withColumn("status", status).drop("_k", "_h")


def pending(new: DataFrame, state: DataFrame, key: str, hash_: str) -> DataFrame:
    """Rows to be worked on again; put before any costly step, so that it never sees unchanged rows."""
    return with_status(new, state, key, hash_).where("status <> 'unchanged'")


def counters(df: DataFrame, status: Column, names: tuple[str, ...]) -> DataFrame:
    """One row with a count for each status."""
    return df.agg(*(F.count_if(status == n).alias(n) for n in names))


def merged(state: DataFrame, updates: DataFrame, key: str, *order: str) -> DataFrame:
    """Insert or replace by key; the last of several updates wins, nothing is ever deleted."""
    fresh = last_wins(updates, key, *order) if order else updates.dropDuplicates([key])
    return state.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def not_yet(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known; null keys stay."""
    return df.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def only_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_semi")


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """``df`` with ``batch``: consecutive rows in ``order``, ``size`` to a batch, counted from 0.

    Numbers come from ranks within range partitions and the partitions' totals, so no task sees all rows.
    """
    spread = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    # stored, as a range exchange that runs twice need not cut at the same places
    spread = stored(spread.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order))), "spread")
    before = spread.groupBy("_p").count().withColumn("_b", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return spread.join(F.broadcast(before), "_p").withColumn("batch", F.floor((F.col("_b") + F.col("_i") - 1) / size)).drop("_p", "_i", "_b")


class Snapshots:
    """A keyed table in buckets by key; a merge writes the buckets it touches anew and leaves the others as they are.

    ``root`` must be a folder all executors share. What is current is named by a small file that is replaced
    last, so a failed merge leaves the old state; a folder that is read is never written to. ``vacuum`` removes
    what is no longer current.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = 64):
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> dict[str, str]:
        """Bucket to the version that holds it."""
        if not self._fs.exists(self._path(f"{self.root}/CURRENT")):
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0])

    def _read(self, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{v}/_bucket={b}" for b, v in sorted(parts.items())))

    def read(self) -> DataFrame:
        """The current state; empty with the declared schema before the first merge."""
        return self._read(self._current())

    def merge(self, updates: DataFrame, key: str, *order: str) -> str:
        """Merge and switch to the new version; its name. Without ``order`` any of several updates of a key wins."""
        now = self._current()
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets))
        updates = stored(updates.withColumn("_bucket", bucket), "updates")
        touched = {str(r["_bucket"]) for r in updates.select("_bucket").distinct().collect()}  # at most one row a bucket
        want = {f.name: f.dataType for f in self._read({}).schema.fields}
        old = self._read({b: v for b, v in now.items() if b in touched})
        new = merged(old, updates.drop("_bucket"), key, *order).select(*(F.col(c).cast(t).alias(c) for c, t in want.items()))
        name = f"v-{uuid.uuid4().hex}"
        new.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        out = self._fs.create(self._path(f"{self.root}/CURRENT"), True)
        out.write(bytearray(json.dumps(now | dict.fromkeys(touched, name)).encode()))
        out.close()
        return name

    def vacuum(self) -> int:
        """Remove buckets that are no longer current; how many. For times when no one reads an older state."""
        now, gone = self._current(), 0
        for version in self._fs.listStatus(self._path(self.root)):
            name = version.getPath().getName()
            if name.startswith("v-"):
                for part in self._fs.listStatus(version.getPath()):
                    b = part.getPath().getName()
                    if b.startswith("_bucket=") and now.get(b.removeprefix("_bucket=")) != name:
                        gone += bool(self._fs.delete(part.getPath(), True))
                if name not in now.values():
                    self._fs.delete(version.getPath(), True)
        return gone


def check_dimension(vectors: DataFrame, column: str, dimension: int) -> DataFrame:
    """``vectors``, failing on the first vector that has another number of entries."""
    return vectors.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == dimension), F.col(column)).otherwise(F.raise_error(F.lit(f"a vector does not have {dimension} entries")).cast(vectors.schema[column].dataType)))
