"""Problem 2: the k most similar vectors of every vector, by an inverted multi-index.

Method: vectors of unit length are cut into two halves; each half is quantised by its own centroids, so K
and K centroids name K * K cells. A query visits cells in the order of the summed distance of the two halves,
taken from a heap, until the visited cells hold enough entries; those entries are reranked by their exact
cosine in double precision.

Centroids are fitted on a bounded sample (SAMPLE); every vector is indexed. Equal vectors are one entry until
the end, so a hot group of copies costs nothing in the index. A cell of more than BLOCK entries is cut into
blocks that are compared apart, so no task holds more than a block and the queries stream past it. Queries and
a cell meet in tiles of at most TILE products: a cell grows with the collection, what it takes at once does not.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.runtime import discard, slots, stored

SAMPLE = 40_000
CELLS_ROOT = 0.25
EFFORT = 7.0
MOST_CENTROIDS = 2_048
#: Entries that lie together: a query sends its vector once to each slab it visits, whatever the number of cells there. Changes no result.
SLAB = 65_536
BLOCK = 16_384
#: Products of queries and entries, rows of a result and pairs compared exactly that are held at once. They change no result.
TILE, ROWS, PAIRS = 1 << 20, 1 << 16, 1 << 13


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; an empty one moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32).copy()
    for _ in range(rounds):
        d = half_distances(x, c)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        far = np.argsort(-d[np.arange(len(x)), own])
        for e, j in enumerate(np.flatnonzero(n == 0)):
            s[j], n[j] = x[far[e]], 1
        c = s / n[:, None]
    return c


def half_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0)


def visit(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in the order of d1[i] + d2[j], from a heap, until they hold ``enough`` entries. counts: K1 x K2."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    n1, n2 = len(o1), len(o2)
    heap = [(s1[0] + s2[0], 0, 0)]
    reached = [0] * n1  # in row i, the columns before reached[i] were taken
    out, have = [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * n2 + o2[j]
        n = counts[cell]
        if n:
            out.append(cell)
            have += n
        reached[i] = j + 1
        if j + 1 < n2 and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < n1 and reached[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f4").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def entries(df: DataFrame, key: str, vec: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(members: key, entry, idx, copies; vectors: entry, vec bytes, copies), equal vectors under one entry.

    ``idx`` numbers the first ``most`` copies by key; all others have most + 1.

    Null, all-zero and not finite vectors, and vectors with a null number, take no part.
    """
    good = (F.size(vec) > 0) & F.exists(vec, lambda v: v != 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    src = df.select(F.col(key).alias("key"), F.col(vec).cast("array<float>").alias("vec")).where(F.col(vec).isNotNull() & good & F.col("key").isNotNull())

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(v, "<f4") for v in _lists(b.column(1))]
            # minus zero equals zero
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(v + np.float32(0)).tobytes() for v in rows], pa.binary())], ["key", "vec"])

    flat = stored(src.mapInArrow(raw, f"key {src.schema['key'].dataType.simpleString()}, vec binary"), "vectors")
    signed = flat.select("key", F.xxhash64("vec").alias("h"), F.sha2("vec", 256).alias("sig"))
    classes = stored(signed.groupBy("h", "sig").agg(F.count("*").alias("copies"), F.min("key").alias("rep")), "groups")
    # only the first of many copies need a number: each task keeps no more of a group before the shuffle
    first = signed.withColumn("idx", F.row_number().over(W.partitionBy("h", "sig").orderBy("key"))).where(F.col("idx") <= most).select("key", "idx")
    reps = stored(flat.join(classes.select(F.col("rep").alias("key"), "copies"), "key").select("key", F.monotonically_increasing_id().alias("entry"), "vec", "copies"), "entries")
    groups = classes.join(reps.select(F.col("key").alias("rep"), "entry"), "rep").select("h", "sig", "entry", "copies")
    named = signed.join(groups, ["h", "sig"]).join(first, "key", "left").select("key", "entry", F.coalesce("idx", F.lit(most + 1)).alias("idx"), "copies")
    named = stored(named, "named")
    discard(flat, classes)
    return named, reps.select("entry", "vec", "copies")


def _lists(col: pa.Array) -> Iterator[np.ndarray]:
    values = col.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.r_[0, np.asarray(col.value_lengths())])
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:]))


def chain(c: np.ndarray) -> np.ndarray:
    """An order of centroids in which each is followed by the nearest one left, so that near ones have near numbers."""
    if not c.size:
        return np.arange(len(c))
    left, order = np.ones(len(c), bool), [int(np.argmin(c[:, 0]))]
    while len(order) < len(c):
        left[order[-1]] = False
        d = ((c - c[order[-1]]) ** 2).sum(axis=1)
        order.append(int(np.where(left, d, np.inf).argmin()))
    return np.array(order, np.int64)


def slabs_of(counts: np.ndarray, most: int = SLAB) -> np.ndarray:
    """Slab of each cell: consecutive cells, together at most ``most`` entries unless one cell has more."""
    out = np.empty(len(counts), np.int32)
    slab = held = 0
    for c, n in enumerate(counts.tolist()):
        if held and held + n > most:
            slab, held = slab + 1, 0
        out[c] = slab
        held += n
    return out


def tile_pairs(x: np.ndarray, entry: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of base, cosine) of the k best entries of each query and their equals, with cosine >= least, tile by tile.

    Products in single precision rule out what can't be among them; all others are compared in double precision.
    ids: entry of each row of base, sorted; an entry doesn't meet itself.
    """
    n = len(base)
    b = _unit(base).astype(np.float32)
    slack = (x.shape[1] + 8) * 2.0**-24  # more than products of unit vectors lose in single precision
    for lo in range(0, len(x), step := max(1, TILE // n)):
        s = _unit(x[lo : lo + step]).astype(np.float32) @ b.T
        own = np.searchsorted(ids, entry[lo : lo + step])
        there = np.flatnonzero(ids[np.minimum(own, n - 1)] == entry[lo : lo + step])
        s[there, own[there]] = -2
        hit = s >= max(least - slack, -1.5)
        many = np.flatnonzero(hit.sum(axis=1) > k)
        if len(many):
            t = s[many]
            hit[many] &= t >= np.partition(t, n - k, axis=1)[:, n - k, None] - 2 * slack
            crowded = many[hit[many].sum(axis=1) > 4 * k]  # too close for single precision
            if len(crowded):
                t = np.where(s[crowded] == -2, -2, _unit(x[lo + crowded]) @ _unit(base).T)
                hit[crowded] = t >= np.maximum(np.partition(t, n - k, axis=1)[:, n - k, None], max(least, -1.5))
        i, j = np.nonzero(hit)
        for p in range(0, len(i), PAIRS):
            at, to = i[p : p + PAIRS] + lo, j[p : p + PAIRS]
            score = np.einsum("ij,ij->i", _unit(x[at]), _unit(base[to]))
            good = score >= least
            yield at[good], to[good], score[good]


def reranked(batches: Iterator[pa.RecordBatch], dim: int, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """(q, n, score, copies) of queries (side 1) and the entries (side 0) of the cells they visit, sorted by slab, part and side."""
    at, block, sorted_block = None, [], None
    out, n_out = [], 0
    for b in batches:
        slab, part, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("slab", "part", "side"))
        entry, m = b.column("entry").to_numpy(zero_copy_only=False), b.column("copies").to_numpy(zero_copy_only=False)
        x = _matrix(b.column("vec"), dim)
        cells = b.column("cells").to_pylist()
        cuts = np.flatnonzero(np.r_[True, (np.diff(slab) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0), True])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            name = (slab[lo], part[lo])
            if side[lo] == 0:
                if at != name:
                    at, block, sorted_block = name, [], None
                block.append((np.frombuffer(b"".join(cells[lo:hi]), "<i4"), entry[lo:hi], m[lo:hi], x[lo:hi]))
                continue
            if at != name:
                continue  # no entry fell into this part
            if sorted_block is None:
                cell, ids, copies, base = (np.concatenate(c) for c in zip(*block))
                block = []
                o = np.lexsort((ids, cell))
                sorted_block = cell[o], ids[o], copies[o], base[o]
            cell, ids, copies, base = sorted_block
            want = np.frombuffer(b"".join(cells[lo:hi]), "<i4")
            who = np.repeat(np.arange(lo, hi), [len(c) // 4 for c in cells[lo:hi]])
            o = np.argsort(want, kind="stable")
            want, who = want[o], who[o]
            edge = np.flatnonzero(np.r_[True, np.diff(want) != 0, True])
            for p, q in zip(edge[:-1], edge[1:]):
                first, last = np.searchsorted(cell, [want[p], want[p] + 1])
                if first == last:
                    continue
                w = who[p:q]
                for i, j, score in tile_pairs(x[w], entry[w], base[first:last], ids[first:last], k, least):
                    if not len(i):
                        continue
                    out.append((entry[w][i], ids[first:last][j], score, copies[first:last][j]))
                    n_out += len(i)
                    if n_out >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["q", "n", "score", "copies"])
                        out, n_out = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["q", "n", "score", "copies"])


def nearest_entries(vectors: DataFrame, k: int, least: float = -1.0, effort: float = EFFORT) -> DataFrame:
    """(q, n, score, copies, rank): for each entry the k most similar others among those visited, with score >= least.

    A query visits cells until they hold effort * sqrt(number of entries); cells hold CELLS_ROOT * sqrt(number)
    on average, so the number of visited cells is the same at every size. Vectors of different lengths have no
    cosine: those of each length are searched among themselves.
    """
    spark = vectors.sparkSession
    sizes = [r["d"] for r in vectors.select((F.octet_length("vec") / 4).cast("int").alias("d")).distinct().collect()]  # lengths that occur
    parts = [_nearest_of(vectors.where(F.octet_length("vec") == 4 * d), d, k, least, effort) for d in sorted(sizes)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "q long, n long, score double, copies long, rank int")


def _nearest_of(vectors: DataFrame, dim: int, k: int, least: float, effort: float) -> DataFrame:
    """The same for vectors of one length."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    total = vectors.count()
    # the share of the entries whose hash falls into SAMPLE of ``total``
    part = vectors if total <= SAMPLE else vectors.where(F.pmod(F.xxhash64("entry"), F.lit(total)) < SAMPLE)
    sample = part.select("entry", "vec").toPandas().sort_values("entry")["vec"]
    x = _unit(np.frombuffer(b"".join(sample), "<f4").reshape(-1, dim)).astype(np.float32)
    half = dim // 2
    enough = int(max(10 * k, effort * total**0.5))
    kk = int(np.clip(round((total / (CELLS_ROOT * total**0.5)) ** 0.5), 1, MOST_CENTROIDS))
    c1, c2 = kmeans(x[:, :half], kk), kmeans(x[:, half:], kk)
    c1, c2 = c1[chain(c1)], c2[chain(c2)]
    k2 = len(c2)
    books = sc.broadcast((c1, c2))  # at most MOST_CENTROIDS rows each

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b1, b2 = books.value
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_matrix(b.column("vec"), dim)).astype(np.float32)
            cell = half_distances(u[:, :half], b1).argmin(axis=1) * k2 + half_distances(u[:, half:], b2).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("entry"), b.column("vec"), b.column("copies")], ["cell", "entry", "vec", "copies"])

    indexed = stored(vectors.mapInArrow(assign, "cell int, entry long, vec binary, copies long"), "index")
    counts = np.zeros(len(c1) * k2, np.int64)
    for r in indexed.groupBy("cell").count().collect():  # one row a cell, at most MOST_CENTROIDS squared
        counts[r["cell"]] = r["count"]
    tasks = max(slots(spark), int(total * 5 // 100_000) + 1)
    slab_of_cell = slabs_of(counts, int(np.clip(total // tasks, BLOCK // 8, SLAB)))
    tables = sc.broadcast((counts, slab_of_cell))
    names = ["slab", "part", "side", "entry", "vec", "copies", "cells"]
    form = "slab int, part int, side byte, entry long, vec binary, copies long, cells binary"

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b1, b2 = books.value
        count, slab_of = tables.value
        n, slab_list = count.tolist(), slab_of.tolist()
        for b in batches:
            v = b.column("vec")
            u = _unit(_matrix(v, dim)).astype(np.float32)
            d1, d2 = half_distances(u[:, :half], b1), half_distances(u[:, half:], b2)
            for lo in range(0, len(u), 2000):
                row, slab, part, cells = [], [], [], []
                for i in range(lo, min(lo + 2000, len(u))):
                    to: dict[int, list[int]] = {}
                    for c in visit(d1[i], d2[i], n, enough):
                        to.setdefault(slab_list[c], []).append(c)
                    for s, cs in to.items():
                        raw = np.asarray(cs, "<i4").tobytes()
                        for p in range(max(-(-n[c] // BLOCK) for c in cs)):
                            row.append(i)
                            slab.append(s)
                            part.append(p)
                            cells.append(raw)
                m, take = len(row), pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(slab, pa.int32()), pa.array(part, pa.int32()), pa.array(np.ones(m, np.int8)), b.column("entry").take(take), v.take(take), pa.array(np.zeros(m, np.int64)), pa.array(cells, pa.binary())], names)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, slab_of = tables.value
        for b in batches:
            cell = b.column("cell").to_numpy(zero_copy_only=False)
            many = np.maximum(-(-count[cell] // BLOCK), 1)
            e = b.column("entry").to_numpy(zero_copy_only=False)
            part = (((e * 0x9E3779B1) & 0x7FFFFFFF) >> 7) % many
            raw = [x.tobytes() for x in cell.astype("<i4")]
            yield pa.RecordBatch.from_arrays([pa.array(slab_of[cell]), pa.array(part.astype(np.int32)), pa.array(np.zeros(len(e), np.int8)), b.column("entry"), b.column("vec"), b.column("copies"), pa.array(raw, pa.binary())], names)

    near = (
        indexed.mapInArrow(held, form)
        .unionByName(indexed.mapInArrow(asked, form))
        .repartitionById(tasks, F.pmod(F.col("slab") + F.col("part") * 7919, F.lit(tasks)))
        .sortWithinPartitions("slab", "part", "side")
        .mapInArrow(lambda batches: reranked(batches, dim, k, least), "q long, n long, score double, copies long")
    )
    best = W.partitionBy("q").orderBy(F.desc("score"), "n")
    near = stored(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "near")
    discard(indexed)
    return near


def similar_pairs(df: DataFrame, key: str, vec: str, k: int = 10, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, score), a < b, of cosine at least ``least`` where one is among the k most similar others of the other.

    Copies of a vector are each other's most similar vectors; among equals the smaller keys come first.
    """
    members, vectors = entries(df, key, vec, k)
    near = nearest_entries(vectors, k, least)
    own = vectors.select(F.col("entry").alias("q"), F.col("copies").alias("own"))
    before = F.coalesce(F.sum("copies").over(W.partitionBy("q").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = near.join(own, "q").withColumn("room", F.lit(k) - (F.col("own") - 1) - before).where("room > 0").select("q", "n", "score", "room")
    q = members.select(F.col("entry").alias("q"), F.col("key").alias("kq"))
    n = members.select(F.col("entry").alias("n"), F.col("key").alias("kn"), F.col("idx").alias("in"))
    cross = room.join(q, "q").join(n, "n").where("in <= room").select(F.least("kq", "kn").alias("a"), F.greatest("kq", "kn").alias("b"), "score")
    many = members.where("copies > 1")
    copies = (
        many.select("entry", F.col("key").alias("ka"), F.col("idx").alias("ia"))
        .where(F.col("ia") <= k)
        .join(many.select("entry", F.col("key").alias("kb"), F.col("idx").alias("ib")), "entry")
        .where("ia < ib")
        .select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.lit(1.0).alias("score"))
    )
    return cross.groupBy("a", "b").agg(F.max("score").alias("score")).unionByName(copies)
