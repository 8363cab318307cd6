"""Splitter, tokens, containers, reading bands, encodings and pages."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import encodings, packing, page_text, reading_level, splitting, tokens

# ---- splitter ----------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n,;é漢", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    p = splitting.pieces(text, limit, overlap)
    assert (p == []) == (text == "")
    if p:
        assert p[0][0] == 0 and p[-1][1] == len(text) and all(0 < e - s <= limit for s, e in p)
        assert all(a[0] < b[0] <= a[1] < b[1] and a[1] - b[0] <= overlap for a, b in zip(p, p[1:]))


def test_pieces_cut_at_boundaries():
    text = "First part here. Second one. " * 120 + "\n\n" + "x" * 4000
    p = splitting.pieces(text)
    assert all(text[s:e].endswith((". ", "\n\n", "x")) for s, e in p)
    assert all(a[1] > b[0] for a, b in zip(p[-3:], p[-2:]))
    with pytest.raises(ValueError):
        splitting.pieces("x", 5, 5)


def test_paragraphs_that_fit_are_not_cut():
    paragraphs = ["a " * 700 + "end.\n\n", "b " * 740 + "end.\n\n", "c " * 600 + "end."]
    text = "".join(paragraphs)
    p = splitting.pieces(text)
    ends = np.cumsum([len(x) for x in paragraphs]).tolist()
    assert [e for _, e in p] == ends and p[1][0] >= ends[0] - 150 and all(e - s <= 1500 for s, e in p)


def test_split_rows(spark):
    rows = [(1, "a" * 1500), (2, "b " * 800), (2, "b " * 800), (3, None), (4, ""), (5, "é😀" * 1000)]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "id long, text string, piece_no int, start string")
    got = splitting.split_texts(df, ["id"], "text").collect()
    assert {r["id"] for r in got} == {1, 2, 5} and all(len(r["piece"]) <= 1500 for r in got)
    assert sorted(r["id"] for r in splitting.oversized(df, ["id"], "text").collect()) == [2, 2, 5]
    assert splitting.split_texts(df.limit(0), ["id"], "text").count() == 0


# ---- tokens ------------------------------------------------------------------------------------------------


def test_tokens_and_back(spark):
    texts = ["Hello world", "", None, "naïve — 漢字😀\x00\n", "<|endoftext|> is plain", "word " * 30_000, "  "]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    enc = tokens.encode_column(df, ["doc_id"], "text", offsets=True)
    got = {r["doc_id"]: r for r in enc.collect()}
    assert got[1]["ids"] == [] and got[2]["ids"] == [] and 50256 not in got[4]["ids"] and len(got[0]["ids"]) == len(got[0]["starts"]) == 2 and got[0]["starts"] == [0, 5]
    plain = tokens.encode_column(df, ["doc_id"], "text")
    assert {r["doc_id"]: r["ids"] for r in plain.collect()} == {k: r["ids"] for k, r in got.items()}
    back = {r["doc_id"]: r["text"] for r in tokens.decode_column(enc, ["doc_id"], "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@settings(max_examples=40, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80))
def test_decoding_reverses_encoding(text):
    path = tokens.tokenizer_path()
    assert tokens.decode_ids(tokens.load(path).encode(text, add_special_tokens=False).ids) == text


# ---- containers --------------------------------------------------------------------------------------------


def naive_sum_of_squares(sizes, cap):
    bins = []
    for s in sizes:
        levels = np.bincount([b for b in bins if 0 < b < cap], minlength=cap + 1)
        best = None
        for h in [0, *sorted({b for b in bins if 0 < b <= cap - s}, reverse=True)]:
            n = levels.copy()
            if h:
                n[h] -= 1
            if h + s < cap:
                n[h + s] += 1
            v = (int((n * n).sum()), -h)
            if best is None or v < best[0]:
                best = (v, h)
        if best[1]:
            bins[bins.index(best[1])] += s
        else:
            bins.append(s)
    return sorted(bins)


def test_packing_equals_the_definition():
    r = random.Random(2)
    sizes = [r.randrange(1, 20) for _ in range(200)]
    where, offset, fill = packing.sum_of_squares(np.array(sizes), 20)
    assert sorted(fill.tolist()) == naive_sum_of_squares(sizes, 20)
    assert (np.bincount(where, weights=sizes).astype(int) == fill).all()


def test_pack_rows(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(1, 90)) for i in range(3000)] + [(5000, 0), (5001, None), (5002, 100), (5003, 350), (5003, 350), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, n int").repartition(5)
    got = packing.pack(df, "doc_id", "n", 100, shard_size=60_000).collect()
    by = {}
    for x in got:
        by.setdefault(x["container"], []).append((x["offset"], x["part_size"]))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(p[1] for p in parts) <= 100
    total = sum(n or 0 for _, n in rows)
    assert sum(x["part_size"] for x in got) == total and len(by) <= 1.05 * total / 100 + 1
    assert sorted((x["part_no"], x["part_size"]) for x in got if x["doc_id"] == 5003) == sorted([(0, 100), (1, 100), (2, 100), (3, 50)] * 2)
    assert packing.pack(df.limit(0), "doc_id", "n").count() == 0


def test_pack_when_nothing_fits_together(spark):
    df = spark.range(500).select("id", F.lit(60).alias("n"))
    got = packing.pack(df, "id", "n", 100, shard_size=3000)
    assert got.select("container").distinct().count() == 500


# ---- reading bands -----------------------------------------------------------------------------------------

WORDS = {1: "cat dog sun run red big see hop box toy", 2: "town school street people garden meeting lunch letter ticket summer", 3: "department programme committee university lecture research colleague method project survey", 4: "heteroscedasticity epistemology regularization commensurability stationarity nonparametric axiomatic discretization"}


def band_text(r, band, n=80):
    return " ".join(r.choice(WORDS[band].split()) + (" the " if r.random() < 0.3 else "") for _ in range(n))


def test_bands(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(240):
        b = i % 4 + 1
        docs.append((i, band_text(r, b), "en" if i % 5 else None))
        if i < 120:
            labels.append((i, b if i % 29 else max(1, b - 1)))
    docs += [(900 + i, "der die das und nicht ist ein wort für jeden satz " * 8, "de") for i in range(30)] + [(1000, None, None), (1001, "", "en"), (1002, "cat dog", "en"), (1003, "der die das und nicht ist ein wort für jeden satz " * 8, "en")]
    d = spark.createDataFrame([(*x, 9) for x in docs], "doc_id long, text string, lang string, band int")
    lab = spark.createDataFrame(labels, "doc_id long, band int")
    got = {x["doc_id"]: x["band"] for x in reading_level.reading_levels(d, lab).collect()}
    assert set(got) == set(range(240))
    held_out = [got[i] == i % 4 + 1 for i in range(120, 240)]
    assert sum(held_out) >= 0.97 * len(held_out)
    assert reading_level.reading_levels(d, lab.limit(0)).count() == 0 and reading_level.reading_levels(d.limit(0), lab).count() == 0


def test_bands_of_more_runs_than_slots(spark, monkeypatch):
    # all bands have the same words; only which one follows which tells them apart, in more runs than the least number of slots
    monkeypatch.setattr(reading_level, "SLOTS", 1 << 9)
    r = random.Random(6)
    after = {(b, w): r.sample(range(60), 6) for b in range(1, 5) for w in range(60)}

    def walk(band, n=120):
        w, out = r.randrange(60), []
        for _ in range(n):
            w = r.choice(after[band, w])
            out.append(f"word{w:02}")
        return " ".join(out)

    docs = [(i, walk(i % 4 + 1), "en") for i in range(400)]
    docs += [(1000 + i, t, g) for i, t, g in docs[:40]]  # copies
    docs += [(2000 + i, "der die das und nicht ist für jeden satz " * 8, "de") for i in range(20)]
    labels = [(i, i % 4 + 1) for i, _, _ in docs if i < 2000]
    bands, _ = reading_level.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, band int"))
    hashes = reading_level.WordHash()
    held_out = [bands.band(bands.difficulty(reading_level._ids(walk(i % 4 + 1), hashes))) == i % 4 + 1 for i in range(120)]
    assert sum(held_out) >= 0.95 * len(held_out)


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    x = rng.random(300)
    u, y = reading_level.isotonic(x, np.round(4 * x + rng.normal(0, 0.5, 300)))
    assert (np.diff(y) >= 0).all() and len(u) == len(y) == 300


# ---- encodings ---------------------------------------------------------------------------------------------

CLEAN = ["The café talks (with Müller) cost €35 each – it’s new –", "Según el equipo, la traducción mejoró en la atención médica", "Группа изучает моделирование и создала систему для учителей", "L’équipe étudie la généralisation des réseaux, année après année", "课程介绍图像检索的历史、方法与应用。", "São Paulo — naïve or not — “quoted” ‘words’ (±21 °C)", "Über die Größe: für Schüler veröffentlichte"]


def spoilt(t, written, read):
    try:
        return t.encode(written).decode(read)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def test_garbled_text_is_found_and_restored(spark):
    rows, want = [], {}
    n = 0
    for k in range(40):
        for t in CLEAN:
            rows.append((n, t + f" {k}."))
            n += 1
    for t in CLEAN:
        for w, r in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac-roman"), ("utf-8", "cp437")):
            s = spoilt(t, w, r)
            if s is not None:
                rows.append((n, s))
                want[n] = t
                n += 1
    twice = spoilt(spoilt(CLEAN[1], "utf-8", "cp1252"), "utf-8", "cp1252")
    rows += [(n, twice), (n + 1, "Gr��ens für alle"), (n + 2, "plain ascii"), (n + 3, None), (n + 4, ""), (n + 5, "long é " * 20_000)]
    want[n] = CLEAN[1]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, t string, lost int")
    got = {r["id"]: r for r in encodings.garbled(df, ["id"], "t", with_text=True).collect()}
    assert set(got) == set(want) | {n + 1} and got[n + 1]["restored"] is None
    assert sum(got[k]["restored"] == v for k, v in want.items()) >= 0.9 * len(want)
    assert encodings.garbled(df.limit(0), ["id"], "t").count() == 0


def test_references_are_read_as_characters(spark):
    rows = [(n, t + f" {k}.") for n, (k, t) in enumerate((k, t) for k in range(40) for t in CLEAN)]
    bad = CLEAN[1].encode().decode("cp1252")
    refs = "".join(c if c.isascii() else f"&#{ord(c)};" for c in bad)
    good = "".join(c if c.isascii() else f"&#x{ord(c):x};" for c in CLEAN[5])
    rows += [(9000, refs), (9001, good), (9002, "R&D &amp; &#39;x&#39; &#9999999999; &unknown;"), (9003, refs + " &lt;b&gt;")]
    got = {r["id"]: r["restored"] for r in encodings.garbled(spark.createDataFrame(rows, "id long, t string"), ["id"], "t", with_text=True).collect()}
    assert got == {9000: CLEAN[1], 9003: CLEAN[1] + " &lt;b&gt;"}


def test_text_garbled_on_purpose_comes_back(spark):
    rows = [(n, t + f" {k}.") for n, (k, t) in enumerate((k, t) for k in range(40) for t in CLEAN)]
    got = encodings.round_trip(spark.createDataFrame(rows, "id long, t string"), ["id"], "t").collect()
    assert len(got) > 150 and sum(r["found"] for r in got) >= 0.97 * len(got) and sum(r["restored"] for r in got) >= 0.9 * len(got)


# ---- pages -------------------------------------------------------------------------------------------------


def page(title, body, side="<p>Follow us</p>\n<p>Recent posts</p>", foot="<p>Imprint and terms of use</p>"):
    return f"<html><head>\n<title>{title}</title>\n</head><body>\n<noscript>You need to enable JavaScript.</noscript>\n<div class=\"a\">\n<h2>Our Institute</h2>\n<ul>\n<li><a href=\"/a\">About</a></li>\n<li><a href=\"/b\">Teaching</a></li>\n</ul>\n</div>\n<div class=\"b\">\n{body}\n</div>\n<div class=\"c\">\n{side}\n</div>\n<div class=\"d\">\n{foot}\n</div>\n</body></html>"


def corpus():
    r = random.Random(6)
    nouns, verbs = "river kernel market lens garden archive battery swarm census orchard".split(), "explores compares builds measures reframes improves".split()
    line = lambda: " ".join(f"The group {r.choice(verbs)} a {r.choice(nouns)} model for the {r.choice(nouns)} of number {r.randrange(999)}." for _ in range(3))
    rows = []
    for s in range(60):
        for k in range(3 if s % 6 else 1):
            rows.append((s, k, f"https://h{s}.edu/~u{s}/p{k}", page("t", f"<h1>{r.choice(nouns)} {r.choice(nouns)} notes {r.randrange(999)}</h1>\n<p>{line()}</p>\n<p>{line()}</p>\n<div>Read more »</div>")))
    return rows, line


def test_main_body_and_residue(spark):
    rows, line = corpus()
    bad = ["<h1>404 Not Found</h1>\n<p>The requested URL was not found on this server.</p>", "<p>Lorem ipsum dolor sit amet, consectetur adipiscing elit.</p>", "<p>{{ full_name }} | {{ department }}</p>\n<p>Office: {{ office }}. Phone: {{ phone }}.</p>", "<p>Please enable JavaScript to view this page.</p>"]
    for i, b in enumerate(bad):
        rows.append((100 + i, 0, f"https://bad{i}.edu/~x/", page("t", b)))
    rows.append((200, 0, "https://q.edu/~x/", page("t", f"<p>{line()}</p>\n<p>Our study asks why “404 Not Found” scares readers of lorem ipsum.</p>\n<p>{line()}</p>")))
    rows += [(300, 0, None, page("t", f"<p>{line()}</p>")), (301, 0, "https://e.edu/", ""), (302, 0, "https://n.edu/", None), (303, 0, "https://n.edu/", "<html><head>\n<title>App</title>\n</head><body>\n<noscript>Please enable JavaScript to continue.</noscript>\n<div id=\"root\"></div>\n</body></html>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "crawl_id long, page_no int, url string, html string, shared string").repartition(5)
    read, tables = page_text.read_pages(df, ["crawl_id", "page_no"], "url", "html")
    got = {(r["crawl_id"], r["page_no"]): r for r in read.collect()}
    assert {k[0] for k, r in got.items() if r["residue"]} == {100, 101, 102, 103, 303}
    assert (302, 0) not in got and got[301, 0]["main"] == []
    right = 0
    for s, k, _, html in rows[: len(rows) - 9]:
        lines = html.split("\n")
        want = [i for i, x in enumerate(lines) if x.startswith(("<h1>", "<p>The group"))]
        right += got[s, k]["main"] == want
    assert right >= 0.95 * (len(rows) - 9)
    reasons = spark.createDataFrame([(1, "http_404"), (2, "conn_error:SSLError"), (3, "%(reason)s"), (4, "lorem ipsum"), (5, None), (6, ""), (7, "http_{status}")], "id long, reason string")
    assert {r["id"] for r in page_text.residue_texts(reasons, ["id"], "reason", tables).collect()} == {3, 4, 7}


def test_no_pages(spark):
    read, _ = page_text.read_pages(spark.createDataFrame([], "crawl_id long, page_no int, url string, html string"), ["crawl_id", "page_no"], "url", "html")
    assert read.count() == 0


def test_common_lines_is_a_longest_common_subsequence():
    r = random.Random(7)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(page_text.common_lines(a, b)[0]) == best[-1][-1]


def marks_of(spark, rows):
    """The marks of lines with text, by page number, of (url, texts)."""
    df = spark.createDataFrame([(i, u, "\n".join(f"<p>{x}</p>" for x in t)) for i, (u, t) in enumerate(rows)], "id long, url string, html string").repartition(3)
    return {r["id"]: list(r["shared"]) for r in page_text.differenced(df, ["id"], "url", "html").collect()}


def test_pages_meet_across_first_parts_of_a_host(spark):
    got = marks_of(spark, [("https://h.edu/~a", ["Back to top", "one"]), ("https://h.edu/~b", ["Back to top", "two"]), ("https://h.edu/~c/x", ["Back to top", "c", "three"]), ("https://h.edu/~c/y", ["c", "four"]), ("https://k.edu/~a", ["Back to top", "one"])])
    # a page whose first part has another page meets only that
    assert got == {0: [1, 0], 1: [1, 0], 2: [0, 1, 0], 3: [1, 0], 4: [2, 2]}


def test_whole_lines_are_counted():
    text = " ".join(f"word{i}".replace("0", "a").translate(str.maketrans("123456789", "bcdefghij")) for i in range(200))
    hashes = page_text.WordHash()
    slots = page_text.features(text, False, hashes)
    assert len(slots) == 200 + 201 + 1
    own, shared = np.zeros(page_text.WORDS, np.int64), np.zeros(page_text.WORDS, np.int64)
    own[slots[:60]], shared[slots[60:]] = 1, 1
    model = page_text.LineModel(own, shared)
    assert model.score(text, False) < model.score(" ".join(text.split()[:60]), False)


def test_marks_do_not_depend_on_where_a_host_is_cut(spark, monkeypatch):
    # one host; equal URLs with many texts, no URL, and a common beginning of the path
    rows = [(f"https://h.edu/people/profile-{i:04}", ["Back to top", f"pair {i // 2}", f"own {i}"]) for i in range(300)]
    rows += [("https://h.edu/people/profile-0100", ["Back to top", f"again {i}"]) for i in range(200)] + [(None, ["Back to top", "none"])] * 20
    want = marks_of(spark, rows)
    for i in range(1, 299):
        if i not in (99, 100, 101):
            assert want[i] == [1, 1, 0]
    assert all(want[i] == [1, 0] for i in range(300, 500)) and all(want[i] == [2, 2] for i in range(500, 520))
    monkeypatch.setattr(page_text, "HOT", 40, raising=False)
    monkeypatch.setattr(page_text, "BLOCK", 7, raising=False)
    monkeypatch.setattr(page_text, "REACH", 2, raising=False)
    assert marks_of(spark, rows) == want
    alone = [("https://h.edu/people/a", ["Back to top", "one"]), ("https://h.edu/teams/b", ["Back to top", "two"])]
    monkeypatch.setattr(page_text, "HOT", 1, raising=False)
    assert marks_of(spark, alone) == {0: [1, 0], 1: [1, 0]}


def test_copies_of_any_number_are_passed_over(spark, monkeypatch):
    # copies and near copies under many URLs, then one page that differs
    rows = [(f"https://h.edu/~a/copy{i:03}", ["Back to top", *[f"line {k}" for k in range(30)], *(["new"] if i % 7 == 0 else [])]) for i in range(150)]
    rows += [("https://h.edu/~a/other", ["Back to top", "own"])]
    got = marks_of(spark, rows)
    assert all(got[i][0] == 1 and not any(got[i][1:]) for i in range(150)) and got[150] == [1, 0]
    monkeypatch.setattr(page_text, "BLOCK", 7)
    monkeypatch.setattr(page_text, "REACH", 2)
    assert marks_of(spark, rows) == got


def test_runs_of_copies_give_what_every_pair_gives():
    r = random.Random(8)
    for _ in range(40):
        texts = [[f"{r.randrange(3)}"] * r.randrange(2) + [f"l{k}" for k in range(r.randrange(20, 24))] for _ in range(4)] + [["x", "l1"]]
        pages = sorted(("h", r.choice("ab"), f"u{r.randrange(12)}", r.choice(texts)) for _ in range(25))
        for i, (got, settled) in enumerate(page_text._site(pages)):
            _, part, url, t = pages[i]
            want = None
            for whole in (False, True):
                for side in (pages[:i][::-1], pages[i + 1 :]):
                    for _, p, u, x in side:
                        if not whole and p != part:
                            break
                        shared = page_text.common_lines(t, x)[0]
                        if (p, u) != (part, url) and len(shared) < 0.95 * len(t):
                            want = (want or set()) | shared
                            break
                if want is not None:
                    break
            assert settled and got == want


def test_wording_never_seen_is_found_where_it_stands_in_place_of_content(spark):
    rows, _ = corpus()
    known = ["<h1>404 Not Found</h1>", "<p>lorem ipsum lorem ipsum</p>", "<p>{{ name }} | {{ title }}</p>", "<p>You need to enable JavaScript.</p>", "<h1>Service Unavailable</h1>"]
    rows += [(400 + i, 0, f"https://seen{i}.edu/~x/", page("t", known[i % len(known)])) for i in range(15)]
    held_out = [
        "Segmentation fault (core dumped)", "ORA-12541: TNS: no listener", "This space intentionally left blank.", "Kernel panic: attempted to kill init", "Your licence for this module has run out.",
        "Disk quota exceeded for this user", "The resource is locked by another process.", "Template author: put the name of the teacher here", "Insert abstract", "We could not reach the upstream host.",
        "Script execution is blocked; unblock it and press F5.", "Nothing to see, move along.", "Invalid token in request header", "Sorry, this profile is gone.", "{% person.phone %}",
    ]
    rows += [(500 + i, 0, f"https://new{i}.edu/~x/", page("t", f"<p>{x}</p>")) for i, x in enumerate(held_out)]
    read, _ = page_text.read_pages(spark.createDataFrame(rows, "crawl_id long, page_no int, url string, html string").repartition(5), ["crawl_id", "page_no"], "url", "html")
    bad = {r["crawl_id"] for r in read.where("residue").collect()}
    assert len([i for i in bad if i >= 500]) >= 12
    assert not [i for i in bad if i < 400]


def test_repeated_lines_train_the_line_model_once():
    types = [("Share this with a friend", False, 500, 3, 400)] + [(f"own words number {chr(97 + i)} and more {chr(98 + i)}", False, 1, 0, 1) for i in range(20)]
    own, shared = np.zeros(page_text.WORDS, np.int64), np.zeros(page_text.WORDS, np.int64)
    hashes = page_text.WordHash()
    for line, linked, o, s, _ in types:
        at = page_text.features(line, linked, hashes)
        np.add.at(shared if s else own, at, 1)
    model = page_text.LineModel(own, shared)
    assert model.score("Share this with a friend", False) < -2 < 0 < model.score("own words number c and more d", False)
