"""Problem 9: items into containers of fixed capacity, as full as possible.

Method: sum-of-squares online packing. For each item, of all fill levels with an open container (and the
empty container) the one is chosen that leaves the smallest sum of squared counts of partially filled
containers; the counts are kept in an array with one entry per level, so a choice is one vector operation
whatever the number of containers.

Shards are packed side by side. What stays partially filled is at most what the last round left; those
containers are packed again as whole items, many shards to one task, until one shard is left or a round
closes no container. Only (container, fill) of open containers travels, never the documents, and the
number of rounds is logarithmic in the number of shards.

Only an item over the capacity is split: into full containers and a rest that is packed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.runtime import stored

CAPACITY = 2048
SHARD_TOKENS = 8_000_000
MERGE = 16
OPEN_LIMIT = 200_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(container, offset) of each item of 1..capacity, in the order given, and the fill of each container."""
    level = np.zeros(capacity + 1, np.int64)  # open containers by fill; 0 and full ones do not count
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        last = capacity - s
        # change of the sum of squares when a container of fill h becomes one of fill h + s
        gain = 2 * level[s:].copy()
        gain[1:] += 2 - 2 * level[1 : last + 1]
        gain[0] += 1
        gain[last] -= 2 * level[capacity] + 1  # a full container leaves the sum
        best = np.flatnonzero(level[: last + 1] > 0) if last else np.empty(0, np.int64)
        h = 0
        if len(best):
            # ties: the fuller container
            k = best[::-1][np.argmin(gain[best[::-1]])]
            h = int(k) if gain[k] <= gain[0] else 0
        if h:
            c = open_at[h].pop()
            level[h] -= 1
        else:
            c = len(fill)
            fill.append(0)
        where[i], offset[i] = c, fill[c]
        fill[c] += s
        if fill[c] < capacity:
            level[fill[c]] += 1
            open_at[fill[c]].append(c)
    return where, offset, np.asarray(fill, np.int64)


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard_size: int = SHARD_TOKENS) -> DataFrame:
    """One row per placed part: key, part_no, n_parts, part_size, container string, offset.

    Items of size null, 0 or less have no part and no row. An item over the capacity has parts of full
    capacity, each alone in its container, and a rest. Keys need not be unique; equal rows are items each.
    """
    it = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("size > 0")
    parts = stored(
        it.withColumn("n_parts", F.ceil(F.col("size") / capacity))
        .select("key", "n_parts", "size", F.posexplode(F.sequence(F.lit(1), F.col("n_parts"))).alias("part_no", "_i"))
        .withColumn("part_size", F.least(F.lit(capacity), F.col("size") - F.col("part_no") * capacity))
        .select("key", "part_no", "n_parts", "part_size"),
        "parts",
    )
    total = parts.where(F.col("part_size") < capacity).agg(F.sum("part_size")).first()[0] or 0
    shards = max(1, -(-total // shard_size))
    full = parts.where(F.col("part_size") == capacity).select("key", "part_no", "n_parts", "part_size", F.concat(F.lit("full-"), F.col("key").cast("string"), F.lit("-"), "part_no", F.lit("-"), F.monotonically_increasing_id()).alias("container"), F.lit(0).cast("long").alias("offset"))
    schema = "key " + dict(parts.dtypes)["key"] + ", part_no int, n_parts long, part_size long, bin string, at long, fill long"

    def first(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "key", "part_no"], kind="stable")
        where, offset, fill = sum_of_squares(pdf["part_size"].to_numpy(), capacity)
        return pd.DataFrame({"key": pdf["key"], "part_no": pdf["part_no"], "n_parts": pdf["n_parts"], "part_size": pdf["part_size"], "bin": [f"{k[0]}-{c}" for c in where], "at": offset, "fill": fill[where]})

    rest = parts.where(F.col("part_size") < capacity).withColumn("_h", F.xxhash64("key", "part_no", "part_size"))
    placed = stored(rest.withColumn("shard", F.pmod(F.hash("_h"), F.lit(int(shards)))).groupBy("shard").applyInPandas(first, schema), "placed")
    # rounds over open containers: (bin, root, at, fill)
    moves = placed.where(F.col("fill") < capacity).groupBy("bin").agg(F.max("fill").alias("fill")).select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"), "fill")
    width, n_round = int(shards), 0
    while width > 1:
        # a task never gets more than OPEN_LIMIT open containers; where that many stay open, merging further gains nothing
        n_open = moves.where(F.col("fill") < capacity).count()
        narrow = max(-(-width // MERGE), -(-n_open // OPEN_LIMIT))
        if narrow >= width:
            break
        width = narrow
        n_round += 1

        def again(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            roots = pdf.drop_duplicates("root").sort_values(["fill", "root"], ascending=[False, True], kind="stable")
            where, offset, fill = sum_of_squares(roots["fill"].to_numpy(), capacity)
            new = dict(zip(roots["root"], zip(where.tolist(), offset.tolist())))
            return pd.DataFrame({"bin": pdf["bin"], "root": [f"r{width}-{k[0]}-{new[x][0]}" for x in pdf["root"]], "shift": [s + new[x][1] for x, s in zip(pdf["root"], pdf["shift"])], "fill": [int(fill[new[x][0]]) for x in pdf["root"]]})

        open_, closed = moves.where(F.col("fill") < capacity), moves.where(F.col("fill") >= capacity)
        merged = open_.withColumn("_s", F.pmod(F.hash("root"), F.lit(width))).groupBy("_s").applyInPandas(again, "bin string, root string, shift long, fill long")
        moves = stored(closed.unionByName(merged), f"round{n_round}")
    out = (
        placed.join(moves.select("bin", "root", "shift"), "bin", "left")
        .select("key", "part_no", "n_parts", "part_size", F.coalesce("root", "bin").alias("container"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
    )
    return full.unionByName(out).withColumnRenamed("key", key)
