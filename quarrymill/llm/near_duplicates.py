"""Problem 3: groups of texts that differ by small edits, as an exact set-similarity join.

Method: vertical partitioning. All n-grams are put into one global order (rare first) and the order is cut
into fragments. A text sends to each fragment only the part of its prefix that falls there; a fragment
counts partial overlaps of the pairs it sees, and the counts are summed per pair over the fragments. A pair
whose sum can no longer reach the threshold is dropped; for the rest the overlap of the whole sets is taken.

Nothing is approximate: the prefix lengths, the length filter and the position bound are all implied by the
threshold, for any global order. The order comes from a table of gram counts with a bounded number of slots,
which is what makes it small enough to hand to every task at any input size; slots hold sums over all rows,
and a shared slot only makes the order less sharp, never the result wrong. Fragments are cut so that each
gets about as many places of prefixes, counted over all texts; a gram that is in the prefix of very many texts
is a fragment of its own and is cut further, by pairs of blocks of texts, so no task sees all of them.

Each text also carries a parity bitmap of its set. The bits in which two bitmaps differ bound the number of
grams the sets do not share from below, so most pairs that only share stock phrases end in the fragment in
which they meet; no pair that reaches the threshold can be lost by it.

Equal sets are one class before the join, so copies cost nothing until the result is expanded. Grams are
hashes of GRAM_BYTES bytes; two different grams of one pair fall together with a chance of about 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.counts import batch_of, summed
from quarrymill.llm.groups import components
from quarrymill.llm.words import WordHash, gram_set, words_of
from quarrymill.runtime import discard, slots, stored

#: Slots of the gram order, one for GRAMS_A_SLOT grams of the corpus within these bounds; they change no result.
ORDER_SLOTS, MOST_SLOTS, GRAMS_A_SLOT = 1 << 18, 1 << 22, 64
#: Places in prefixes that make a fragment; a slot with more than SPLIT of them is dealt out by pairs of blocks of texts.
FRAGMENT, SPLIT = 250_000, 50_000
GRAM_BYTES = 5
BITMAP = 256
#: Sets of more than LONG grams carry a wider bitmap as well.
LONG, WIDE = 128, 1024
PAIR_BLOCK = 4_000_000
MOST_TASKS = 20_000


def pack_grams(g: np.ndarray) -> bytes:
    """The low GRAM_BYTES bytes of each hash."""
    return np.ascontiguousarray(g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]).tobytes()


def unpack_grams(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, GRAM_BYTES)
    whole = np.zeros((len(part), 8), np.uint8)
    whole[:, :GRAM_BYTES] = part
    return whole.view("<u8").ravel()


def gram_sets(df: DataFrame, key: str, text: str, size: int, least_words: int) -> DataFrame:
    """One row per text of at least ``least_words`` words: key, sig (of the set), n, grams (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            ids, sig, n, grams = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(t)
                if len(w) < max(least_words, size):
                    continue
                g = gram_set(w, size, hashes)
                ids.append(i)
                sig.append(blake2b(g.tobytes(), digest_size=16).digest())
                g = np.unique(g & np.uint64((1 << 8 * GRAM_BYTES) - 1))
                n.append(len(g))
                grams.append(pack_grams(g))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sig, pa.binary()), pa.array(n, pa.int32()), pa.array(grams, pa.binary())], ["key", "sig", "n", "grams"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null and key is not null")
    # a text of w words has at least 2w - 1 characters
    return rows.where(F.length("text") >= 2 * least_words - 1).mapInArrow(run, "key long, sig binary, n int, grams binary")


def gram_order(sets: DataFrame, n_slots: int) -> np.ndarray:
    """Counts of all grams of all sets by slot, summed in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_slots, np.int64)
        for b in batches:
            if b.num_rows:
                every = unpack_grams(b"".join(b.column(0).to_pylist())) & np.uint64(n_slots - 1)
                total += np.bincount(every.astype(np.int64), minlength=n_slots)
        yield batch_of({"grams": total})

    return summed(sets.select("grams").mapInArrow(run, "kind string, part int, at binary, n binary"), {"grams": n_slots})["grams"]


def _prefix(g: np.ndarray, rank: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(slot, place in ``g``) of the grams of a set in its prefix, rare first."""
    slot = (g & np.uint64(len(rank) - 1)).astype(np.int64)
    o = np.argsort((rank[slot].astype(np.int64) << 20) + ((g >> np.uint64(20)).astype(np.int64) & 0xFFFFF), kind="stable")
    o = o[: len(g) - int(_ceil(t * len(g))) + 1]
    return slot[o], o


def prefix_places(reps: DataFrame, rank, n_slots: int, t: float) -> np.ndarray:
    """How many prefixes hold a gram of each slot, over all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_slots, np.int64)
        for b in batches:
            got = [_prefix(unpack_grams(raw), rank.value, t)[0] for raw in b.column(0).to_pylist()]
            if got:
                total += np.bincount(np.concatenate(got), minlength=n_slots)
        yield batch_of({"places": total})

    return summed(reps.select("grams").mapInArrow(run, "kind string, part int, at binary, n binary"), {"places": n_slots})["places"]


def fragments_of(places: np.ndarray, most: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment of each slot, number of blocks of each fragment) for slots in their order."""
    heavy = places > split
    light = np.where(heavy, 0, places)
    frag = ((np.cumsum(light) - light) // most).astype(np.int32)
    frag = np.unique(frag, return_inverse=True)[1].astype(np.int32)
    n = int(frag.max()) + 1
    frag[heavy] = n + np.arange(heavy.sum())
    return frag, np.r_[np.ones(n, np.int64), -(-places[heavy] // split)]


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def _ceil(x: np.ndarray | float) -> np.ndarray:
    return np.ceil(x - 1e-9)


def similar_classes(reps: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """Pairs (a, b) of representatives whose sets reach ``threshold`` in Jaccard similarity, a < b.

    ``reps`` has key, n and grams, one row per distinct set.
    """
    spark = reps.sparkSession
    sc = spark.sparkContext
    t = threshold
    rank = np.empty(len(counts), np.int32)
    order = np.argsort(counts, kind="stable")
    rank[order] = np.arange(len(counts), dtype=np.int32)
    ranks = sc.broadcast(rank)  # at most MOST_SLOTS entries
    places = prefix_places(reps, ranks, len(counts), t)
    frag_of_rank, blocks = fragments_of(places[order], int(np.clip(places.sum() // slots(spark), 1, FRAGMENT)), SPLIT)
    frag_of_slot = np.empty(len(counts), np.int32)
    frag_of_slot[order] = frag_of_rank
    # fragments and their pairs of blocks are dealt out in turn, not by hash, which would give some tasks several
    before = np.cumsum(blocks * (blocks + 1) // 2)
    tasks = max(slots(spark), min(int(before[-1]), MOST_TASKS))
    shared = sc.broadcast((frag_of_slot, blocks, np.r_[0, before[:-1]]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rk, (fr, cut, first) = ranks.value, shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1 << 15):
                b = whole.slice(lo, 1 << 15)
                keys = b.column("key").to_numpy(zero_copy_only=False).astype("<i8")
                ns = b.column("n").to_numpy(zero_copy_only=False).astype("<i4")
                tok, own, at, frg = [], [], [], []
                bits = np.zeros((len(keys), BITMAP // 8), np.uint8)
                wide = np.zeros((len(keys), WIDE // 8), np.uint8)
                for k, raw in enumerate(b.column("grams").to_pylist()):
                    g = unpack_grams(raw)
                    n = len(g)
                    index = n - int(_ceil(2 * t / (1 + t) * n)) + 1
                    odd = np.bincount((g >> np.uint64(20)).astype(np.int64) & (WIDE - 1), minlength=WIDE) & 1
                    bits[k] = np.packbits(odd.reshape(-1, BITMAP).sum(axis=0) & 1)
                    if n > LONG:
                        wide[k] = np.packbits(odd)
                    slot, o = _prefix(g, rk, t)
                    tok.append(((g[o] >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype("<u4"))
                    own.append(np.full(len(o), k, "<u2"))
                    p = np.arange(len(o), dtype="<u4")
                    at.append(p * 2 + (p < index))
                    frg.append(fr[slot])
                if not tok:
                    continue
                tok, own, at, frg = map(np.concatenate, (tok, own, at, frg))
                by = np.argsort(frg, kind="stable")
                there_ = np.unique(frg)
                cuts = np.searchsorted(frg[by], np.r_[there_, frg.max() + 1])
                rows = []
                for f, lo_, hi_ in zip(there_.tolist(), cuts, cuts[1:]):
                    if cut[f] == 1:
                        parts = [(by[lo_:hi_], [(0, 0)])]
                    else:  # each block meets itself and every other once
                        block = _block_of(keys[own[by[lo_:hi_]]], cut[f])
                        parts = [(by[lo_:hi_][block == h], [(min(h, j), max(h, j)) for j in range(cut[f])]) for h in np.unique(block).tolist()]
                    for w, to in parts:
                        # the texts of this fragment once, their grams by place in that list
                        there, place = np.unique(own[w], return_inverse=True)
                        width = 2 if at[w].max() < 1 << 16 else 4
                        row = (tok[w].tobytes(), place.astype("<u2").tobytes(), at[w].astype(f"<u{width}").tobytes(), width, keys[there].tobytes(), ns[there].tobytes(), bits[there].tobytes(), wide[there[ns[there] > LONG]].tobytes())
                        rows += [(int(first[f] + j * (j + 1) // 2 + i) % tasks, f, i, j, int(cut[f]), *row) for i, j in to]
                kinds = [pa.int32()] * 5 + [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], ["task", "frag", "i", "j", "blocks", "tok", "own", "at", "width", "key", "n", "bits", "wide"])

    def overlaps(key: tuple, table: pa.Table) -> pa.Table:
        def column(name: str, kind: str) -> list[np.ndarray]:
            return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]

        tok = np.concatenate(column("tok", "<u4"))
        at = np.concatenate([np.frombuffer(x, f"<u{w}").astype(np.int64) for x, w in zip(table.column("at").to_pylist(), table.column("width").to_pylist())])
        keys, sizes = column("key", "<i8"), column("n", "<i4")
        shift = np.cumsum([0, *map(len, keys)])
        doc = np.concatenate([p.astype(np.int64) + s for p, s in zip(column("own", "<u2"), shift)])
        bits = np.concatenate(column("bits", "<u8")).reshape(-1, BITMAP // 64)
        wide = np.concatenate(column("wide", "<u8")).reshape(-1, WIDE // 64)
        keys, sizes = np.concatenate(keys), np.concatenate(sizes).astype(np.int64)
        wide_at = np.cumsum(sizes > LONG) - 1
        apart = key[2].as_py() != key[3].as_py()
        block = _block_of(keys, table.column("blocks")[0].as_py()) if apart else None
        own, n = keys[doc], sizes[doc]
        # within a gram: by size, then key; a text then meets only those not smaller than itself
        o = np.lexsort((own, n, tok))
        tok, own, n, at, doc = tok[o], own[o], n[o], at[o], doc[o]
        new = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        end = np.r_[new[1:], len(tok)]
        stop = np.repeat(end, end - new)
        first = np.arange(len(tok)) + 1
        # the smaller text of a pair counts only with its index prefix; the larger one may be up to n / t
        reach = np.where((at & 1) == 1, stop - first, 0)
        lead = np.flatnonzero(reach > 0)
        out = []
        parts = _blocks(reach[lead], PAIR_BLOCK)
        for lo, hi in parts:
            i = np.repeat(lead[lo:hi], reach[lead[lo:hi]])
            start = np.repeat(np.cumsum(reach[lead[lo:hi]]) - reach[lead[lo:hi]], reach[lead[lo:hi]])
            j = i + 1 + (np.arange(len(i)) - start)
            ok = n[i] >= t * n[j] - 1e-9
            if apart:  # pairs within a block are counted elsewhere
                ok &= block[doc[i]] != block[doc[j]]
            i, j = i[ok], j[ok]
            need = _ceil(t / (1 + t) * (n[i] + n[j]))
            pi, pj = (at[i] >> 1).astype(np.int64), (at[j] >> 1).astype(np.int64)
            ok = np.minimum(pi, pj) + 1 + np.minimum(n[i] - pi, n[j] - pj) - 1 >= need
            i, j, pi, pj, need = i[ok], j[ok], pi[ok], pj[ok], need[ok]
            ok = n[i] + n[j] - _differ(bits, doc[i], doc[j]) >= 2 * need
            i, j, pi, pj, need = i[ok], j[ok], pi[ok], pj[ok], need[ok]
            both = np.flatnonzero((n[i] > LONG) & (n[j] > LONG))
            ok = np.ones(len(i), bool)
            ok[both] = n[i[both]] + n[j[both]] - _differ(wide, wide_at[doc[i[both]]], wide_at[doc[j[both]]]) >= 2 * need[both]
            i, j, pi, pj = i[ok], j[ok], pi[ok], pj[ok]
            if not len(i):
                continue
            out.append(_sum_pairs(own[i], own[j], n[i], n[j], np.ones(len(i), np.int64), pi, pj))
        if not out:
            return _pair_table(*(np.empty(0, np.int64) for _ in range(7)))
        return _pair_table(*(_sum_pairs(*(np.concatenate(c) for c in zip(*out))) if len(out) > 1 else out[0]))

    form = "task int, frag int, i int, j int, blocks int, tok binary, own binary, at binary, width int, key binary, n binary, bits binary, wide binary"
    sent = reps.select("key", "n", "grams").mapInArrow(spread, form).repartitionById(tasks, "task")
    pairs = sent.groupBy("task", "frag", "i", "j").applyInArrow(overlaps, "x long, y long, nx int, ny int, cnt int, px int, py int")
    possible = (
        pairs.groupBy("x", "y")
        .agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.sum("cnt").alias("cnt"), F.max("px").alias("px"), F.max("py").alias("py"))
        .where(F.col("cnt") + F.least(F.col("nx") - F.col("px") - 1, F.col("ny") - F.col("py") - 1) >= F.ceil(F.lit(t / (1 + t)) * (F.col("nx") + F.col("ny")) - 1e-9))
        .select("x", "y")
    )
    possible = stored(possible, "candidates")
    whole = reps.select("key", F.col("grams"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_numpy(zero_copy_only=False), b.column("y").to_numpy(zero_copy_only=False)
            gx, gy = b.column("gx"), b.column("gy")
            keep = np.zeros(len(x), bool)
            for k in range(len(x)):
                p, q = unpack_grams(gx[k].as_py()), unpack_grams(gy[k].as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[k] = both >= t * (len(p) + len(q) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], ["a", "b"])

    return (
        possible.join(whole.select(F.col("key").alias("x"), F.col("grams").alias("gx")), "x")
        .join(whole.select(F.col("key").alias("y"), F.col("grams").alias("gy")), "y")
        .select("x", "y", "gx", "gy")
        .mapInArrow(check, "a long, b long")
    )


def _differ(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of i and j differ."""
    out = np.zeros(len(i), np.int64)
    for word in range(bits.shape[1]):
        column = np.ascontiguousarray(bits[:, word])
        out += np.bitwise_count(column[i] ^ column[j])
    return out


def _blocks(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about ``limit`` at most (one item may exceed it)."""
    if not len(sizes):
        return []
    cum = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(cum, np.arange(limit, cum[-1], limit)))
    edges = np.unique(np.r_[0, cuts, len(sizes)])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _sum_pairs(x, y, nx, ny, cnt, px, py):
    o = np.lexsort((y, x))
    x, y = x[o], y[o]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return x[new], y[new], nx[o][new], ny[o][new], np.add.reduceat(cnt[o], new), np.maximum.reduceat(px[o], new), np.maximum.reduceat(py[o], new)


def _pair_table(x, y, nx, ny, cnt, px, py) -> pa.Table:
    c = lambda v: pa.array(v.astype(np.int32))
    return pa.table({"x": pa.array(x.astype(np.int64)), "y": pa.array(y.astype(np.int64)), "nx": c(nx), "ny": c(ny), "cnt": c(cnt), "px": c(px), "py": c(py)})


def near_duplicates(df: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """Similar texts as (membership, links).

    membership: key, rep: every text with at least ``least_words`` (and ``size``) words under the smallest
    key of its equal sets. links: a, b with a < b, all pairs of representatives whose sets of ``size``-word
    runs have a Jaccard similarity of at least ``threshold``.

    Null and short texts have no row. Keys must be unique. Other columns of ``df`` play no part. An empty
    input gives empty results.
    """
    sets = stored(gram_sets(df, key, text, size, least_words), "grams")
    ranked = sets.groupBy("sig").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    member = stored(sets.select("key", "sig").join(ranked, "sig").select("key", "rep", "copies"), "classes")
    reps = stored(sets.join(member.where("key = rep").select("key"), "key", "left_semi"), "representatives")
    total = sets.agg(F.sum("n")).first()[0] or 0
    counts = gram_order(sets, int(np.clip(1 << int(total // GRAMS_A_SLOT).bit_length(), ORDER_SLOTS, MOST_SLOTS)))
    discard(sets)
    return member, similar_classes(reps, counts, threshold)


def duplicate_pairs(member: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair a < b of similar texts, copies expanded; linear in the number of pairs asked for."""
    m = member.select("key", "rep")
    # a hot class is as many rows of one key on either side; adaptive execution splits such keys of a sort-merge join
    many = member.where("copies > 1").select("key", "rep")
    same = many.alias("l").join(many.alias("r"), (F.col("l.rep") == F.col("r.rep")) & (F.col("l.key") < F.col("r.key"))).select(F.col("l.key").alias("a"), F.col("r.key").alias("b"))
    cross = (
        links.join(m.select(F.col("rep").alias("a"), F.col("key").alias("ka")), "a")
        .join(m.select(F.col("rep").alias("b"), F.col("key").alias("kb")), "b")
        .select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    )
    return same.unionByName(cross)


def duplicate_groups(member: DataFrame, links: DataFrame) -> DataFrame:
    """(key, group, n_links): one row per text; group is the smallest key its links lead to, n_links those of its class."""
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n"))
    found = components(links)
    return (
        member.join(ends, "rep", "left")
        .join(found.select(F.col("node").alias("rep"), "group"), "rep", "left")
        .select("key", F.coalesce("group", "rep").alias("group"), F.coalesce("n", F.lit(0)).alias("n_links"))
    )
