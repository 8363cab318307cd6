"""Vectors: cosine as a column, and exact top-k by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_BYTES = 32 << 20


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if one is null, of another length or all zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / norm)


def _best(ids: list, vectors: list[np.ndarray], batches: Iterator[tuple[pa.Array, pa.Array]], k: int) -> dict[int, list[tuple[float, object]]]:
    """(falling score, id) of the k best rows of (ids, vectors) batches for each query by number, ties by id; vectors of another length play no part."""
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for d in {len(v) for v in vectors}:
        at = [i for i, v in enumerate(vectors) if len(v) == d and np.all(np.isfinite(v)) and v.any()]
        if at:
            m = np.stack([vectors[i] for i in at])
            by_size[d] = (at, m / np.linalg.norm(m, axis=1, keepdims=True))
    best: dict[int, list] = {}
    for keys, lists in batches:
        names = keys.to_pylist()
        size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), int)
        flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
        ends = np.cumsum(np.r_[0, size])
        for d, (at, m) in by_size.items():
            rows_ = np.flatnonzero(size == d)
            if not len(rows_):
                continue
            x = flat[ends[rows_][:, None] + np.arange(d)]
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            rows_, x = rows_[ok], x[ok] / norm[ok][:, None]
            if not len(rows_):
                continue
            s = m @ x.T
            for i, row in zip(at, s):
                cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -2.0
                got = [(-float(row[j]), names[rows_[j]]) for j in np.flatnonzero(row >= cut)]
                best[i] = sorted(best.get(i, []) + got)[:k]
    return best


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, query_vec: str, corpus_id: str, corpus_vec: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, score, rank): the k entries of largest cosine for each query, ties by id.

    Exact. Queries that fit into one block of ``block_bytes`` go to the tasks that scan the corpus, and every
    task sends on its best k per query only. More queries are cut into blocks, as is the corpus, and each pair
    of blocks meets in a task of its own: nothing passes through the driver, and a task holds two blocks. Null,
    empty, zero and wrongly sized vectors take no part on either side; a query that is itself in the corpus
    finds itself.
    """
    spark = corpus.sparkSession
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v")).where(F.size("v") > 0)
    base = corpus.select(F.col(corpus_id).alias("id"), F.col(corpus_vec).alias("v")).where(F.size("v") > 0)
    size = lambda df: (lambda r: int(r["n"] or 0) * int(r["d"] or 1) * 8)(df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first())
    form = f"q {dict(queries.dtypes)[query_id]}, id {dict(corpus.dtypes)[corpus_id]}, score double"
    types = (to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(corpus.schema[corpus_id].dataType))

    def rows_of(ids: list, best: dict[int, list]) -> list[pa.Array]:
        out = [(ids[i], n, -s) for i, hits in best.items() for s, n in hits]
        return [pa.array([o[0] for o in out], types[0]), pa.array([o[1] for o in out], types[1]), pa.array([o[2] for o in out], pa.float64())]

    blocks = max(1, -(-size(q) // block_bytes))
    if blocks == 1:
        rows = q.collect()  # one block, of bounded size
        shared = spark.sparkContext.broadcast(([r["q"] for r in rows], [np.asarray(r["v"], float) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            yield pa.RecordBatch.from_arrays(rows_of(ids, _best(ids, vectors, ((b.column(0), b.column(1)) for b in batches), k)), ["q", "id", "score"])

        near = base.mapInArrow(run, form)
    else:
        parts = max(1, -(-size(base) // block_bytes))
        block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = base.select("id", "v", block("id", parts).alias("i"), every(blocks).alias("j"))
        right = q.select("q", "v", every(parts).alias("i"), block("q", blocks).alias("j"))

        def meet(c: pa.Table, a: pa.Table) -> pa.Table:
            ids = a.column("q").to_pylist()
            rows = ((b.column("id"), b.column("v")) for b in c.combine_chunks().to_batches(10_000))
            return pa.table(rows_of(ids, _best(ids, [np.asarray(v, float) for v in a.column("v").to_pylist()], rows, k)), ["q", "id", "score"])

        near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, form)
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), "id", "score", "rank")
