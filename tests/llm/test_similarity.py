"""Near duplicates, similar vectors, names: against brute force and worked cases."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import groups, names, near_duplicates, similar_vectors
from quarrymill.llm.near_duplicates import pack_grams, unpack_grams


def brute(texts, size, t, least):
    sets = {}
    for k, x in texts.items():
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if len(w) >= max(least, size):
            sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def reworked(n, seed, words=60):
    """Texts with a third of all in one group of copies and edits, some stock phrases, and odd ones."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [r.choice(vocab) for _ in range(words)]
    out = {}
    for i in range(n):
        if i % 3 == 0:
            x = base[:]
            for _ in range(r.randrange(12)):
                x[r.randrange(len(x))] = r.choice(vocab)
            if r.random() < 0.3:
                x += [r.choice(vocab) for _ in range(r.randrange(40))]
        elif i % 3 == 1:
            x = ["the", "usual", "stock", "phrase", "of", "all"] * 3 + [r.choice(vocab) for _ in range(r.randrange(5, 300))]
        else:
            x = [r.choice(vocab) for _ in range(r.randrange(0, 90))]
        out[i] = " ".join(x)
    out[n], out[n + 1], out[n + 2], out[n + 3] = None, "", "ONE word-run; ONE word_run 漢字 ½", out[0].upper()
    return out


@pytest.mark.parametrize(("size", "t", "least"), [(3, 0.5, 50), (5, 0.8, 0), (1, 0.6, 0)])
def test_pairs_equal_brute_force(spark, size, t, least):
    texts = reworked(150, size)
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in texts.items()], "chunk_id long, text string, key string, rep string").repartition(6)
    member, links = near_duplicates.near_duplicates(df, "chunk_id", "text", size, t, least)
    got = [tuple(r) for r in near_duplicates.duplicate_pairs(member, links).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, size, t, least)
    assert {r["key"] for r in member.collect()} == {k for k, v in texts.items() if len(re.findall(r"[^\W_]+", (v or "").lower())) >= max(least, size)}


def test_hot_grams_are_dealt_out_by_blocks(spark, monkeypatch):
    texts = reworked(120, 5)
    df = spark.createDataFrame(list(texts.items()), "id long, t string").repartition(4)
    want = brute(texts, 3, 0.5, 20)
    for split in (1, 7):
        monkeypatch.setattr(near_duplicates, "SPLIT", split)
        member, links = near_duplicates.near_duplicates(df, "id", "t", 3, 0.5, 20)
        got = [tuple(r) for r in near_duplicates.duplicate_pairs(member, links).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_fragments_are_even():
    places = np.array([5, 5, 0, 900, 5, 5, 300, 5] * 4)
    frag, blocks = near_duplicates.fragments_of(places, 10, 250)
    assert [int(places[frag == f].sum()) for f in np.flatnonzero(blocks == 1)] == [10] * 10
    assert sorted(blocks[blocks > 1]) == [2] * 4 + [4] * 4 and len(np.unique(frag)) == len(blocks)


def test_groups_follow_the_links(spark):
    texts = reworked(90, 11)
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    member, links = near_duplicates.near_duplicates(df, "id", "t", 3, 0.5, 50)
    got = {r["key"]: r["group"] for r in near_duplicates.duplicate_groups(member, links).collect()}
    group = {k: k for k in got}
    for a, b in sorted(brute(texts, 3, 0.5, 50)):
        x, y = group[a], group[b]
        group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    assert got == group


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame([*chain, *star, (5000, 5001), (5001, 5000), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["group"] for r in groups.components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1301)}, 5000: 5000, 5001: 5000}
    assert groups.components(df.limit(0)).count() == 0


def test_near_duplicates_of_nothing(spark):
    member, links = near_duplicates.near_duplicates(spark.createDataFrame([], "id long, t string"), "id", "t")
    assert member.count() == 0 and links.count() == 0


def test_very_long_text(spark):
    r = random.Random(1)
    x = [str(r.randrange(10**6)) for _ in range(70_000)]
    y = x[:]
    for i in range(0, len(y), 70):
        y[i] = "z"
    df = spark.createDataFrame([(1, " ".join(x)), (2, " ".join(y)), (3, " ".join(x[:100]))], "id long, t string")
    member, links = near_duplicates.near_duplicates(df, "id", "t", 3, 0.8)
    assert [tuple(p) for p in links.collect()] == [(1, 2)]


def test_grams_pack():
    g = np.array([0, 1, 2**40 - 1, 255 << 32], np.uint64)
    assert (unpack_grams(pack_grams(g)) == g).all()


def pairs_by_brute_force(vecs, k, least):
    keys = sorted(key for key, v in vecs.items() if v is not None and any(v))
    u = np.array([vecs[key] for key in keys], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(keys)):
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-s[i, j], keys[j]))[:k]
        out |= {tuple(sorted((keys[i], keys[j]))) for j in order if s[i, j] >= least}
    return out


def test_similar_vectors_reach_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 1500)] + 0.35 * rng.normal(size=(1500, 24))
    vecs = {f"v{i:05d}": [float(np.float32(a)) for a in r] for i, r in enumerate(x)}
    for i in range(5):
        vecs[f"copy{i}"] = vecs["v00007"]
    vecs |= {"null": None, "zero": [0.0] * 24, "empty": []}
    df = spark.createDataFrame([(k, v, 1) for k, v in vecs.items()], "vector_id string, vec array<float>, entry int").repartition(5)
    got = {tuple(r)[:2] for r in similar_vectors.similar_pairs(df, "vector_id", "vec", 10, 0.8).collect()}
    want = pairs_by_brute_force({k: v for k, v in vecs.items() if v}, 10, 0.8)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert {p for p in want if p[0].startswith("copy") and p[1].startswith("copy")} <= got


def test_many_copies_stay_linear(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(1000, [1.0, float("nan")]), (1001, None)], "id long, v array<float>")
    got = {tuple(r)[:2] for r in similar_vectors.similar_pairs(df, "id", "v", 10, 0.8).collect()}
    # among equals the smaller keys come first: every entry meets the first ten
    assert got == {(i, j) for i in range(10) for j in range(i + 1, 300)}
    assert similar_vectors.similar_pairs(df.limit(0), "id", "v").count() == 0


def test_a_full_cell_is_compared_in_tiles():
    # all entries lie in one cell, as in a dense place of a large collection: products are held tile by tile
    rng = np.random.default_rng(3)
    n, dim = 6000, 8
    x = (rng.normal(size=(n, dim)) * 0.3 + 1).astype(np.float32)
    ids, cell = np.arange(n, dtype=np.int64), np.zeros(1, "<i4").tobytes()

    def batch(side, lo, hi):
        m = hi - lo
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(m, np.int32)), pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, side, np.int8)), pa.array(ids[lo:hi]), pa.array([v.tobytes() for v in x[lo:hi]]), pa.array(np.ones(m, np.int64)), pa.array([cell] * m)],
            ["slab", "part", "side", "entry", "vec", "copies", "cells"],
        )

    batches = [batch(0, 0, 3000), batch(0, 3000, n), batch(1, 0, 4000)]
    tracemalloc.start()
    got = [(r["q"], r["n"], r["score"]) for b in similar_vectors.reranked(iter(batches), dim, 3, 0.5) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4000 * n * 8 / 2  # less than half of all products at once
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    best = {(q, s) for q in range(0, 4000, 97) for s in np.round(np.sort(np.where(ids == q, -2, u[q] @ u.T))[-3:], 12)}
    top = {}
    for q, m, s in got:
        assert q != m
        top.setdefault(q, []).append(s)
    assert len(top) == 4000 and {(q, s) for q in range(0, 4000, 97) for s in np.round(sorted(top[q])[-3:], 12)} == best


def test_heap_visits_cells_in_order():
    rng = np.random.default_rng(0)
    d1, d2 = rng.random(7), rng.random(9)
    counts = [1] * 63
    got = similar_vectors.visit(d1, d2, counts, 63)
    sums = [d1[c // 9] + d2[c % 9] for c in got]
    assert sorted(got) == list(range(63)) and sums == sorted(sums)


LABS = [(1, "Lab for Relational Curriculum Forensics", "RCFL"), (2, "Adaptive Kernel Planning Research Group", "AKPR"), (3, "Center for Adaptive Speech and Translation", "ASTC"), (4, "Functional Glacier Sampling Laboratory", None)]


def test_labs(spark):
    cases = {
        "Lab for Relational Curriculum Forensics": 1, "RCFL": 1, "Director, RCFL": 1, "RCFL, Havenmoor": 1, "Rela. Curriculum Foren. Lab": 1, "RelationalCurriculum Forensics Lab": 1, "Forensics, Curriculum (Relational) Lab": 1,
        "Curriculum Forensics Lab": 1, "member of the Lab for Relational Curriculum Forensics (since 2019)": 1, "Lab for Relatitnal Currriculum Forensics": 1, "LAB FOR RELATIONAL CURRICULUM FORENSICS": 1, "Adap. Kernel Plann. Research Group": 2,
        "Adaptive Speech Translation Centre": 3, "Functional Glacier Sampling": 4, "Sparse Curriculum Forensics Lab": None, "Adaptive Kernel Tracking Research Group": None, "Reading Circle": None, "": None, None: None, " ": None,
    }
    labs = spark.createDataFrame(LABS, "lab_id long, lab_name string, acronym string")
    df = spark.createDataFrame([(k,) for k in cases] * 2, "s string")
    got = {r["spelling"]: r["lab_id"] for r in names.attribute_groups(df, labs, "s", "lab_id", "lab_name", "acronym", ["Havenmoor"]).collect()}
    assert got == {k: v for k, v in cases.items() if v}
    assert names.attribute_groups(df, labs.limit(0), "s", "lab_id", "lab_name", "acronym").count() == 0


def test_persons(spark):
    site = lambda s, i: [("w", f"https://h/~{s}{i}/")]
    rows = [
        (1, "Renée Séizothex", None, site("seizothex", 1), ["a"]), (2, "Seizothex, Renee", None, None, ["a"]), (3, "Dr. Renée Seizothex, PhD", [], [], None), (4, "Renée Siezothex", None, None, None), (5, "R. Seizothex", None, None, ["a"]),
        (6, "Robert Seizothex", None, None, ["b"]), (7, "Bob Seizothex", ["robert.seizothex@x.edu"], None, ["b"]), (8, None, None, None, None), (9, " ", None, None, None), (10, "William Otherlinger", None, None, None), (11, "Otherlinger William", None, None, None), (12, "renée séizothex (she/her)", None, None, None),
    ]
    # given names are known by their use over all rows
    for i, (g, s) in enumerate([(g, s) for g in ("Renée", "Robert", "William") for s in ("Brakt", "Lomis", "Vextra", "Quillo", "Zandor")]):
        rows.append((100 + i, f"{g} {s}", None, None, None))
    df = spark.createDataFrame(rows, "profile_id long, name string, contact array<string>, websites array<struct<text:string,href:string>>, areas array<string>")
    got = {r["key"]: r["person"] for r in names.same_persons(df, "profile_id", "name", "contact", "websites", ["areas"]).collect()}
    assert len({got[i] for i in (1, 2, 3, 4, 5, 12)}) == 1 and got[6] == got[7] != got[1] and got[10] == got[11] and 8 not in got and 9 not in got
    pairs = {tuple(r) for r in names.pairs_of(spark.createDataFrame([(k, v) for k, v in got.items()], "key long, person string"), "key", "person").collect()}
    assert {(1, 2), (6, 7), (10, 11)} <= pairs and (1, 6) not in pairs
    assert names.same_persons(df.limit(0), "profile_id", "name", "contact", "websites", ["areas"]).count() == 0


def test_frequent_misprints_of_a_hot_surname(spark):
    rows = [(i, "Robert Hargelthorn" if i % 10 else "Robert Hargelthron") for i in range(200)]
    rows += [(1000 + i, f"{g} {s}") for i, (g, s) in enumerate((g, s) for g in ("Robert", "William") for s in ("Brakt", "Lomis", "Vextra", "Quillo", "Zandor"))]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "profile_id long, name string, contact array<string>, websites array<struct<text:string,href:string>>, areas array<string>")
    got = {r["key"]: r["person"] for r in names.same_persons(df, "profile_id", "name", "contact", "websites", ["areas"]).collect()}
    assert len({got[i] for i in range(200)}) == 1 and len(set(got.values())) == 11


def test_distance():
    assert [names.distance(a, b) for a, b in (("roebrt", "robert"), ("a", "a"), ("abc", "abd"), ("abcd", "x"), ("", "ab"))] == [1, 0, 1, 3, 2]


def test_vectors_of_each_length_are_searched(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i:02}", rng.normal(size=4).tolist()) for i in range(50)] + [("w0", rng.normal(size=6).tolist()), ("x0", [2.0]), ("x1", [3.0]), ("x2", [-1.0])]
    got = {tuple(r)[:2] for r in similar_vectors.similar_pairs(spark.createDataFrame(rows, "id string, v array<float>"), "id", "v", 10, 0.3).collect()}
    m = np.array([v for _, v in rows[:50]], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = m @ m.T
    np.fill_diagonal(cos, -2)
    want = {tuple(sorted((rows[i][0], rows[j][0]))) for i in range(50) for j in np.argsort(-cos[i])[:10] if cos[i, j] >= 0.3}
    assert got == want | {("x0", "x1")}


def test_more_copies_than_neighbours(spark):
    rows = [(f"c{i:02}", [1.0, 2.0]) for i in range(30)] + [("d", [1.0, 2.1])]
    got = {tuple(r)[:2] for r in similar_vectors.similar_pairs(spark.createDataFrame(rows, "id string, v array<float>"), "id", "v", 3, 0.8).collect()}
    # among equals the first count: the first three of all others, and for each of these three the first of the rest
    first = {(f"c{i:02}", f"c{j:02}") for i in range(3) for j in range(i + 1, 30)}
    assert got == first | {(f"c{i:02}", "d") for i in range(3)}


def test_short_surnames_and_hot_families(spark):
    # one family holds most rows; misprints of short surnames, and ones that stand many times
    names_ = [("Maria", "Smith")] * 40 + [("Maria", "Smtih"), ("Peter", "Brown"), ("Peter", "Borwn")] + [("Peter", "Brown")] * 20
    names_ += [("Anna", "Wintermeyer")] * 60 + [("Anna", "Wintermeier")] * 9 + [("Omar", "Hollin")] * 5 + [("Amara", "Hollin")] * 5 + [("Maira", "Smith"), ("M", "Smith"), ("", "Smith")]
    rows = [(i, f"{g} {s}".strip(), None, None, [f"area {g}{s[:2]}"]) for i, (g, s) in enumerate(names_)] + [(900, None, None, None, None), (901, " ", [], [], [])]
    df = spark.createDataFrame(rows, "id long, name string, contact array<string>, websites array<struct<text:string,href:string>>, areas array<string>")
    got = {r["key"]: r["person"] for r in names.same_persons(df, "id", "name", "contact", "websites", ["areas"]).collect()}
    assert set(got) == set(range(len(names_)))
    by = {}
    for i, (g, s) in enumerate(names_):
        by.setdefault(f"{g} {s}".strip(), set()).add(got[i])
    assert all(len(v) == 1 for v in by.values())
    same = lambda a, b: by[a] == by[b]
    assert same("Maria Smith", "Maria Smtih") and same("Peter Brown", "Peter Borwn") and same("Anna Wintermeyer", "Anna Wintermeier") and same("Maria Smith", "Maira Smith") and same("Maria Smith", "M Smith")
    assert not same("Omar Hollin", "Amara Hollin") and not same("Maria Smith", "Peter Brown")
