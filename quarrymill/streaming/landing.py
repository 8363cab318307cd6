"""Records that land in a folder, merged into a snapshot as they come.

A file stream sees each new file once and never sees a file that is rewritten in place, so landing folders
are append-only (``slug-run.json``); refreshes of fixed names go through the batch diff instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.operators import chunking
from quarrymill.operators.state import Snapshots, with_status
from quarrymill.sources.records import PROFILE


def chunk_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of chunks from profile documents in ``folder``."""
    files = spark.readStream.schema(PROFILE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return chunking.profile_chunks(chunking.substantive(files))


def merge_stream(chunks: DataFrame, store: Snapshots, checkpoint: str, embed=None) -> StreamingQuery:
    """Merge what has landed since the last run and stop. Replaying a batch changes nothing: the merge is by key."""

    def batch(df: DataFrame, _: int) -> None:
        new = with_status(df.dropDuplicates(["vector_id"]), store.read(), "vector_id", "content_hash").where("status <> 'unchanged'").drop("status")
        if not new.isEmpty():
            store.merge(new.withColumn("values", embed(F.col("text"))) if embed else new, "vector_id")

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_requests(results: DataFrame, late: str = "21 days") -> DataFrame:
    """Requests and matches per client and hour of a stream or table of retrieval results; rows later than ``late`` are dropped by a stream."""
    rows = results.withWatermark("asked_at", late) if results.isStreaming else results
    return rows.groupBy(F.window("asked_at", "1 hour").alias("w"), "client").agg(F.count("*").alias("n_results"), F.approx_count_distinct("request_id").alias("n_requests")).select(F.col("w.start").alias("hour"), "client", "n_results", "n_requests")
