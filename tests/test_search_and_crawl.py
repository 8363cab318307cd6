"""Search, context, answers, crawl, parser, streams and the catalog."""

import json
import threading
import urllib.error
import urllib.request
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.config import EXTRACT_RULES, NO_ANSWER, Settings, require
from quarrymill.functions import urls, vectors
from quarrymill.operators import crawl, external, profile_html, retrieval
from quarrymill.operators.state import Snapshots
from quarrymill.plans import catalog, jobs
from quarrymill.plans.service import Service, handler_of
from quarrymill.streaming import landing


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)).round(1)
    x[5] = x[6]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [1.0] * 5), (903, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    q = df.where("id < 20 or id = 901").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    got = vectors.top_k(q, df, 4, "qid", "qv", "id", "v", block).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(20):
        s = u @ u[i]
        want = sorted(range(300), key=lambda j: (-round(s[j], 9), j))[:4]
        mine = [r["id"] for r in sorted((r for r in got if r["qid"] == i), key=lambda r: r["rank"])]
        assert [round(s[j], 9) for j in mine] == [round(s[j], 9) for j in want]
    assert not [r for r in got if r["qid"] == 901]
    assert vectors.top_k(q.limit(0), df, 4, "qid", "qv", "id", "v").count() == 0
    assert vectors.top_k(q, df.limit(0), 4, "qid", "qv", "id", "v").count() == 0


def test_context_answers_and_fallbacks(spark):
    m = spark.createDataFrame([(1, 2, "B", None, "s2", "u", "t2", 0.5), (1, 1, "A", "T", "s1", "u", "t1", 0.125), (3, 1, None, None, None, None, "", 0.1)], "question_id int, rank int, professor_name string, professor_title string, section_type string, url string, text string, score double")
    q = spark.createDataFrame([(1, "q1?"), (2, "q2?"), (3, "q3?")], "question_id int, text string")
    ctx = {r["question_id"]: r["context"] for r in retrieval.contexts(m, "question_id").collect()}
    assert ctx[1] == "[1] A (T) — s1\nt1\n\n[2] B () — s2\nt2"
    blank = retrieval.answers(q, m, lambda p: F.when(p.contains("q1"), F.concat(F.lit(" yes "), F.right(p, F.lit(14)))).otherwise("  "))
    got = {r["question_id"]: r for r in blank.collect()}
    assert got[1]["answer"] == "yes Question: q1?" and got[3]["answer"] == NO_ANSWER and got[3]["context"] is not None
    assert got[2]["answer"] == NO_ANSWER and got[2]["context"] is None
    c = {(r["question_id"], r["number"]): r for r in retrieval.citations(m, "question_id").collect()}
    assert len(c) == 3 and c[1, 1]["score_text"] == "0.12" and c[3, 1]["name"] == ""


def test_ranked_puts_nan_and_null_last(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, float("nan")), (1, 3, None), (1, 4, 0.9), (1, 5, 0.9)], "g int, id int, score double")
    assert [r["id"] for r in retrieval.ranked(df, "g", "score", "id").orderBy("rank").collect()] == [4, 5, 1, 2, 3]


def test_answer_job(spark):
    idx = spark.createDataFrame([("a#b", "robot hands", "N", "T", "s", "u"), ("c#d", "whale song", "M", "", "s", "u")], "vector_id string, text string, professor_name string, professor_title string, section_type string, url string")
    emb = lambda c: external.embed(c, lambda: external.HashEmbedder(64))
    idx = idx.withColumn("values", emb(F.col("text")))
    q = spark.createDataFrame([(1, "robot hands"), (2, "x")], "question_id int, text string")
    ans, cites = jobs.answer_job(q, idx, 1, emb)
    assert [tuple(r)[:2] for r in ans.collect()] == [(1, "[1] N (T) — s")]
    assert cites.count() == 1


HOME = """<a href="/research.html">Research</a> <a href='pubs/#top'>Publications</a> <a href="https://other.edu/lab">Lab</a>
<a href="mailto:x@y.edu">about me</a> <a href="/misc">Misc</a> <a href="/misc/">our <b>group</b></a> <a href="/research.html#x">again</a>"""


def test_one_hop_links(spark):
    df = spark.createDataFrame([(1, "https://x.edu/~jane/", HOME), (2, None, None), (3, "https://x.edu", "")], "id int, url string, html string")
    got = [(r["id"], r["href"]) for r in crawl.one_hop_links(df, "html", "url", "id").orderBy("id", "pos").collect()]
    # the base loses its slash first; a later label may admit an address seen before
    assert got == [(1, "https://x.edu/research.html"), (1, "https://x.edu/pubs"), (1, "https://x.edu/misc")]


def test_crawl_counts_successes_and_obeys_robots(spark):
    links = "".join(f'<a href="/project{i}">p</a>' for i in range(8))
    pages = spark.createDataFrame([("https://x.edu", links), *[(f"https://x.edu/project{i}", f"t{i}") for i in range(8) if i != 1], ("https://closed.edu", "x")], "url string, html string")
    rules = spark.createDataFrame([("https", "x.edu", 200, "User-agent: *\nDisallow: /project0"), ("https", "closed.edu", 200, "User-agent: *\nDisallow: /"), ("https", "gone.edu", 403, "User-agent: *\nDisallow: /")], "scheme string, host string, status int, body string")
    sites = spark.createDataFrame([("x", "https://x.edu/"), ("closed", "https://closed.edu"), ("gone", "https://gone.edu")], "site string, start_url string")
    got = crawl.crawl(sites, crawl.fetch_from(pages), rules).collect()
    assert [r["url"][-1] for r in sorted(got, key=lambda r: r["hop"]) if r["site"] == "x"][1:] == ["2", "3", "4", "5"]
    assert {r["site"]: r["reason"] for r in got if r["site"] != "x"} == {"closed": "robots_disallowed", "gone": "http_404"}


def test_failure_order_and_charset(spark):
    df = spark.createDataFrame([(200, "text/html", "timeout"), (500, "x", "SSLError"), (404, "application/pdf", None), (200, "application/pdf", None), (200, "Text/HTML; charset=x", None), (200, None, None)], "s int, c string, e string")
    got = [r[0] for r in df.select(crawl.failure(F.col("s"), F.col("c"), F.col("e"))).collect()]
    assert got == ["timeout", "conn_error:SSLError", "http_404", "non_html", None, "non_html"]
    b = spark.createDataFrame([("é".encode("cp1252"), "text/html", "cp1252"), ("é".encode(), "text/html; charset=utf-8", "cp1252"), ("é".encode(), "text/html; charset=nope", None), (None, None, None)], "b binary, c string, d string")
    assert [r[0] for r in b.select(crawl.decoded(F.col("b"), F.col("c"), F.col("d"))).collect()] == ["é", "é", "é", None]


def test_no_page_is_fetched_twice_or_in_vain(spark, tmp_path):
    links = "".join(f'<a href="/project{i}">p</a>' for i in range(30))
    asked = tmp_path / "asked"
    asked.mkdir()

    def open_(url, agent, timeout):
        (asked / f"{url.rsplit('/', 1)[-1]}-{uuid.uuid4().hex}").touch()
        if url == "https://slow.edu":
            raise TimeoutError
        if url == "https://x.edu":
            return 200, "text/html; charset=utf-8", links.encode()
        n = int(url.rsplit("project", 1)[-1])
        return (404, "text/html", b"") if n in (1, 2, 5) else (200, "text/html", f"<p>caf\u00e9 {n}</p>".encode("cp1252"))

    sites = spark.createDataFrame([("x", "https://x.edu/"), ("slow", "https://slow.edu")], "site string, start_url string")
    got = {(r["site"], r["hop"]): r for r in crawl.crawl(sites, external.http_fetch(open_, delay=0.0)).collect()}
    assert [got["x", i]["url"][-1] for i in range(1, 5)] == ["0", "3", "4", "6"] and got["x", 1]["html"] == "<p>caf\u00e9 0</p>"
    assert got["slow", 0]["reason"] == "timeout" and len(got) == 6
    names = sorted(p.name.rsplit("-", 1)[0] for p in asked.iterdir())
    assert names == sorted(["x.edu", "slow.edu", *(f"project{i}" for i in range(7))])


def test_robots_files_are_read_once_a_host(spark):
    sites = spark.createDataFrame([("https://a.edu/x",), ("https://a.edu/y",), ("http://b.edu/",), ("nothing",)], "url string")
    got = external.robots_rules(sites, "url", lambda u, a, t: (200, "text/plain", f"# {u}".encode()), delay=0.0)
    assert sorted(tuple(r) for r in got.collect()) == [("http", "b.edu", 200, "# http://b.edu/robots.txt"), ("https", "a.edu", 200, "# https://a.edu/robots.txt")]


def test_extractor_keeps_objects_only(spark):
    class Model:
        def complete(self, prompt, system="", schema=None, temperature=0.0):
            assert temperature == 0.0 and "website_summary" in schema["properties"] and prompt.startswith(EXTRACT_RULES)
            return {"a": '{"website_summary": "S"}', "b": "[1]", "c": "no json"}[prompt[-1]]

    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "t string")
    assert [r[0] for r in df.select(external.extract(F.col("t"), Model)).collect()] == ['{"website_summary": "S"}', "{}", "{}", None]


def test_service(spark):
    idx = spark.createDataFrame([("a#x", [1.0, 0.0], "A", "T", "x", "u", "text")], "vector_id string, values array<float>, professor_name string, professor_title string, section_type string, url string, text string")
    emb = lambda c: F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
    s = Service(idx, 1, emb)
    assert s.health() == (200, {"status": "ok"}) and s.chat("x")[0] == 422 and s.chat(None)[0] == 422
    status, body = s.chat("Who is A?")
    assert status == 200 and body["answer"] == "[1] A (T) — x" and [c["url"] for c in body["citations"]] == ["u"]
    assert Service(idx, 1, lambda c: F.raise_error(F.lit("down"))).chat("Who is A?")[0] == 502
    web = handler_of(s, 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{web.server_address[1]}"
    assert json.load(urllib.request.urlopen(f"{at}/health")) == {"status": "ok"}
    asked = urllib.request.Request(f"{at}/chat", json.dumps({"question": "Who is A?"}).encode())
    assert json.load(urllib.request.urlopen(asked))["answer"] == "[1] A (T) — x"
    with pytest.raises(urllib.error.HTTPError, match="422"):
        urllib.request.urlopen(urllib.request.Request(f"{at}/chat", b"[]"))
    web.shutdown()


def test_settings_come_from_the_environment():
    s = Settings.from_env({"QUARRYMILL_TOP_K": "3", "QUARRYMILL_QUESTION_LENGTH": "1,9", "QUARRYMILL_DELAY": "0.5", "OTHER": "x"})
    assert (s.top_k, s.question_length, s.delay, s.dimension) == (3, (1, 9), 0.5, 1024)
    assert require("A", env={"A": "1"}) == {"A": "1"}
    with pytest.raises(RuntimeError, match="B, C"):
        require("A", "B", "C", env={"A": "1", "C": ""})


def test_command_line_of_all_jobs(spark, tmp_path, capsys):
    site = "<p>" + "word " * 80 + "</p>"
    listing = '<a href="/people/a/">A</a><a class="page-numbers" href="/people/page/2/">2</a>'
    rows = [("https://d.edu/people/", listing), ("https://d.edu/people/page/2/", '<a href="https://d.edu/people/b/">B</a>'), ("https://d.edu/people/a/", PAGE.replace("none", "").replace("https://x", "https://s.edu")), ("https://s.edu", site)]
    spark.createDataFrame(rows, "url string, html string").write.parquet(str(tmp_path / "pages"))
    args = ["--pages", str(tmp_path / "pages"), "--profiles", str(tmp_path / "profiles")]
    jobs.main(["directory", *args, "--listing", "https://d.edu/people/", "--urls", str(tmp_path / "urls"), "--urls-only"])
    assert capsys.readouterr().out.split() == ["2"]
    jobs.main(["directory", *args, "--listing", "https://d.edu/people/", "--urls", str(tmp_path / "urls")])
    assert "http_404" in (out := capsys.readouterr().out) and out.split()[-1] == "1"
    for extra, n in (([], "1"), ([], "0"), (["--force"], "1")):
        jobs.main(["sites", *args, "--sites", str(tmp_path / "sites"), *extra])
        assert capsys.readouterr().out.split()[-1] == n
    for _ in range(2):
        jobs.main(["ingest", "--profiles", str(tmp_path / "profiles"), "--sites", str(tmp_path / "sites"), "--index", f"file://{tmp_path}/index"])
    shown = [x.split("|")[1:-1] for x in capsys.readouterr().out.splitlines() if x.startswith("|") and "new" not in x]
    new, again = ([int(n) for n in x] for x in shown)
    assert new[0] > 1 and new[1:] == [0, 0] and again == [0, 0, new[0]]
    state_ = Snapshots(spark, f"file://{tmp_path}/index", jobs.CHUNK).read()
    assert {r["section_type"] for r in state_.collect()} >= {"biography", "website_summary"} and state_.where("size(values) <> 1024").count() == 0


def test_site_texts_do_not_depend_on_order(spark):
    rows = [(1, "https://x/b", " B "), (1, "https://x/a", "A" * 30), (1, "https://x/c", "  "), (2, "u", None)]
    for r in (rows, rows[::-1]):
        got = crawl.site_texts(spark.createDataFrame(r, "s int, u string, t string"), "s", "u", "t").collect()
        assert [tuple(x) for x in got] == [(1, "[https://x/a]\n" + "A" * 30 + "\n\n[https://x/b]\nB")]
    assert len(crawl.site_texts(spark.createDataFrame(rows, "s int, u string, t string"), "s", "u", "t", 20).first()["text"]) == 20


def test_main_text_guard_and_status(spark):
    df = spark.createDataFrame([("<html><head><title>t</title></head><body><nav>n</nav><p>A &amp; B<br>c</p><!-- x --><script>1</script><p>d</p></body>",), (None,)], "h string")
    assert [r[0] for r in df.select(crawl.main_text(F.col("h"))).collect()] == ["A & B\nc\nd", None]
    s = spark.createDataFrame([("a", None, "timeout"), ("b", " " * 300, None), ("c", "x" * 200, None), ("d", "y" * 200, None), ("e", None, None)], "slug string, text string, reason string")
    known = crawl.site_status(s, spark.createDataFrame([], "slug string, page_hash string")).where("slug = 'd'").select("slug", "page_hash")
    got = {r["slug"]: r["status"] for r in crawl.site_status(s, known).collect()}
    assert got == {"a": "timeout", "b": "too_short", "c": "to_write", "d": "unchanged", "e": "too_short"}


def test_site_records_from_replies(spark):
    rows = [("a", '{"website_summary":"S","current_projects":[],"recent_news":["n"]}'), ("b", "not json"), ("c", "")]
    df = spark.createDataFrame(rows, "slug string, reply string").selectExpr("slug", "'N' professor_name", "'T' professor_title", "'u' source_url", "'h' page_hash", "'v1' schema_version", "reply")
    got = {r["slug"]: json.loads(r["j"]) for r in crawl.site_records(df).select("slug", F.to_json("sections").alias("j")).collect()}
    assert [(s["section_type"], s["text"]) for s in got["a"]] == [("website_summary", "S"), ("recent_news", ["n"])] and got["b"] == [] and got["c"] == []


def test_pagination_and_profile_urls(spark):
    html = '<a class="page-numbers" href="/people/page/2/">2</a><a class="x page-numbers" href="/people/page/5/">5</a><a href="/people/page/9/">9</a><a href="/people/jane-doe/">J</a><a href="https://d.edu/people/bob/">B</a><a href="https://else.edu/people/x/">X</a>'
    df = spark.createDataFrame([(html,), ("",), (None,)], "h string")
    assert [r[0] for r in df.select(crawl.last_page_number(F.col("h"))).collect()] == [5, 1, 1]
    got = crawl.profile_urls(df, "h", F.lit("https://d.edu/people/"), r"https://d\.edu/people/[a-z0-9-]+/")
    assert sorted(r["url"] for r in got.collect()) == ["https://d.edu/people/bob/", "https://d.edu/people/jane-doe/"]


PAGE = """<h1 class="single-people__header-title">Jane  <em>Doe</em></h1><p class="single-people__header-subtitle">she/her</p>
<figure class="single-people__header-figure"><img src="p.jpg"></figure><p class="single-people__aside-roles">Faculty, , Chair</p>
<div class="single-people__aside-block"><h3>Campus</h3><ul><li class="single-people__aside-list-item">North<li class="single-people__aside-list-item">South</ul></div>
<div class="single-people__aside-block"><h3>Website</h3><p><a href="https://x"><svg><t>i</t></svg><?pi x?>My <b>site</b></a></p></div>
<div class="single-people__aside-block"><h3>Google Scholar</h3><ul><li class="single-people__aside-list-item">none</li></ul></div>
<div class="single-people__aside-block"><h3>Contact</h3><p>a@x.edu</p><p> </p></div>
<div class="accordion-item"><button class="accordion-header">Biography</button><div class="accordion-content__inner"><p>One <b>two</b></p><p>three</p></div></div>
<div class="accordion-item"><button class="accordion-header">Education</button><div class="accordion-content__inner"><ul class="wp-block-list"><li>PhD</li><li> </li><li>MS</li></ul><p>no</p></div></div>"""


def test_profile_parser(spark):
    df = spark.createDataFrame([("j", PAGE), ("e", ""), ("n", None)], "slug string, html string")
    got = {r["slug"]: r for r in profile_html.parse_profiles(df, "html", "slug").collect()}
    j = got["j"]
    assert j["name"] == "JaneDoe" and j["pronouns"] == "she/her" and j["photo_url"] == "p.jpg" and j["roles"] == ["Faculty", "", "Chair"]
    assert j["campuses"] == ["North", "South"] and j["websites"][0]["text"] == "My site" and j["contact"] == ["a@x.edu"]
    assert j["biography"] == "One two\n\nthree" and j["education"] == ["PhD", "MS"] and j["error"] and j["google_scholar"] is None
    assert got["e"]["name"] is None and got["e"]["websites"] == [] and got["n"]["biography"] is None


def test_jobs(spark):
    p = spark.createDataFrame([("https://d/people/a/", PAGE)], "url string, html string")
    asked = spark.createDataFrame([("https://d/people/a/",), ("https://d/people/b/",), ("https://d/people/c/",)], "url string")
    out = {r["slug"]: r["error"] for r in jobs.directory_job(asked, spark.createDataFrame([("c",)], "slug string"), crawl.fetch_from(p)).collect()}
    assert set(out) == {"a", "b"} and out["b"] == "http_404"
    prof = spark.createDataFrame([("a", "A", "T", [("m", "mailto:x"), ("s", "https://s.edu/")]), ("b", "B", None, None)], "slug string, name string, title string, websites array<struct<text:string,href:string>>")
    site_pages = spark.createDataFrame([("https://s.edu", "<p>" + "word " * 80 + "</p>")], "url string, html string")
    extract = lambda c: F.lit('{"website_summary":"S"}')
    none = spark.createDataFrame([], "slug string, page_hash string")
    recs, report = jobs.sites_job(jobs.sites_of(prof), crawl.fetch_from(site_pages), none, extract)
    first = recs.select("slug", "source_url", "page_hash").collect()
    assert [(r["slug"], r["source_url"]) for r in first] == [("a", "https://s.edu/")] and report.first()["status"] == "to_write"
    again, _ = jobs.sites_job(jobs.sites_of(prof), crawl.fetch_from(site_pages), spark.createDataFrame(first), extract)
    assert again.count() == 0


def test_urls(spark):
    df = spark.createDataFrame([("https://x.edu/a/b/?q", "../c d"), ("https://x.edu:80//", "http://[bad"), (None, "x")], "b string, h string")
    got = df.select(urls.slug_of(F.col("b")), urls.netloc(F.col("b")), urls.resolve(F.col("b"), F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("?q", "x.edu", "https://x.edu/a/c d"), ("x.edu:80", "x.edu:80", None), (None, None, None)]


def test_stream_merges_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a-1.json").write_text(json.dumps({"slug": "a", "name": "A", "biography": "one"}, indent=1))
    chunks = landing.chunk_stream(spark, str(src))
    store = Snapshots(spark, f"file://{tmp_path}/s", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields))
    for n in (1, 1, 2):
        landing.merge_stream(landing.chunk_stream(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination(60)
        assert store.read().count() == n
        if n == 1:
            (src / "b-1.json").write_text(json.dumps({"slug": "b", "name": "B", "biography": "two"}))
            if (tmp_path / "seen").exists() or (tmp_path / "seen").touch() is None:
                break
    landing.merge_stream(landing.chunk_stream(spark, str(src)), store, str(tmp_path / "cp")).awaitTermination(60)
    assert store.read().count() == 2


def test_catalog_is_consistent():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 35
