"""Queries over sources, sinks and whole jobs, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.config import PROFILE_SECTIONS, SITE_SECTIONS
from quarrymill.functions import text as tx
from quarrymill.functions import urls
from quarrymill.operators import chunking, crawl, external, state
from quarrymill.plans import jobs
from quarrymill.plans.catalog import _HOP, _LAST, _PAGES, _SP, _STRIPPED, _escaped, _text_sql, directory_page, pages, query
from quarrymill.runtime import scratch, stored, table
from quarrymill.sources import records

# ---- sources and sinks -----------------------------------------------------------------------------------------

_NEWEST = "(select * from (select *, row_number() over (partition by slug order by loaded_at desc, profile_id desc) as _n from profiles where coalesce(slug, '') <> '') where _n = 1)"


def _newest(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each slug."""
    return state.last_wins(table(spark, d, "profiles").where("slug <> ''"), "slug", "loaded_at", "profile_id")


def _written(spark: SparkSession, d: str) -> str:
    """The folder of JSON documents of the newest profiles, written once a session and input."""
    key = f"{d}#{spark.sparkContext.applicationId}"
    if key not in _FOLDERS:
        path = f"{scratch(spark)}/profiles-{len(_FOLDERS)}"
        records.write_json(_newest(spark, d).select("slug", "url", "name", "title", "campuses", "websites", "biography", "labs_and_groups", F.lit(None).cast("variant").alias("raw_aside")), path, "slug")
        _FOLDERS[key] = path
    return _FOLDERS[key]


_FOLDERS: dict[str, str] = {}


@query(f"select slug, url, name, title, coalesce(array_to_string(campuses, '|'), '') as campuses, len(websites) as n_sites, md5(biography) as biography_md5 from {_NEWEST}")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Profiles written as one JSON document each and read back."""
    got = records.read_json(spark, _written(spark, d), records.PROFILE)
    return got.select("slug", "url", "name", "title", F.coalesce(F.array_join("campuses", "|"), F.lit("")).alias("campuses"), F.size("websites").cast("long").alias("n_sites"), F.md5(F.col("biography")).alias("biography_md5"))


@query(f"select slug from {_NEWEST}")
def json_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names of the JSON documents of a folder, none of them read."""
    return records.keys(spark, _written(spark, d))


@query("select 'héllo' || chr(10) || 'wörld' as content, true as absent")
def text_object(spark: SparkSession, d: str) -> DataFrame:
    """A text written, written again and read back; one that is not there."""
    at = f"{scratch(spark)}/note.txt"
    records.write_text(spark, at, "first")
    records.write_text(spark, at, "héllo\nwörld")
    return spark.createDataFrame([(records.read_text(spark, at), records.read_text(spark, at + ".none") is None)], "content string, absent boolean")


@query("select slug, max_by(content_hash, (ingested_at, content_hash)) as page_hash from (select professor_slug as slug, content_hash, ingested_at from chunks where coalesce(professor_slug, '') <> '' and coalesce(content_hash, '') <> '') group by slug")
def state_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The last hash kept for each slug; records without slug or hash don't count."""
    return records.page_hashes(table(spark, d, "chunks").select(F.col("professor_slug").alias("slug"), F.col("content_hash").alias("page_hash"), "ingested_at"), "ingested_at")


@query("select distinct url from profiles where url is not null")
def cached_list(spark: SparkSession, d: str) -> DataFrame:
    """Addresses from the kept list the second time they are asked for."""
    at = f"{scratch(spark)}/urls-{abs(hash(d))}"
    found = table(spark, d, "profiles").where("url is not null")
    records.cached_urls(spark, at, lambda: found, refresh=True)
    return records.cached_urls(spark, at, lambda: found.limit(0))


@query("select cast(i as bigint) as try, cast(least(2 * power(2, i), 60) as double) as pause from range(0, 5) t(i)")
def backoff_delays(spark: SparkSession, d: str) -> DataFrame:
    """Pauses between the tries of a throttled service."""
    return spark.createDataFrame(list(enumerate(map(float, external.delays()))), "try long, pause double")


# ---- chunks ----------------------------------------------------------------------------------------------------

_HEAD = "coalesce(nullif(name, ''), slug) || case when coalesce(title, '') = '' then '' else ' (' || title || ')' end"
_ARRAYS = ("campuses", "roles", "areas_of_interest")


def _sections(kinds: dict[str, str], table_: str, cols: str) -> str:
    parts = []
    for field, (name, label) in kinds.items():
        body = field if field == "biography" else f"'- ' || array_to_string({field}, chr(10) || '- ')"
        parts.append(f"select {cols}, slug || '#{name}' as vector_id, '{name}' as section_type, {_HEAD} || chr(10) || '{label}:' || chr(10) || {body} as text from {table_} where coalesce(slug, '') <> '' and " + (f"coalesce({field}, '') <> ''" if field == "biography" else f"len({field}) > 0"))
    return " union all ".join(parts)


_OF_PROFILE = {k: (k, v) for k, v in PROFILE_SECTIONS.items()}
_OF_SITE = dict(zip(("biography", "projects", "education", "labs_and_groups", "research_interests"), SITE_SECTIONS.items()))


@query(
    "select md5(text) as text_md5, vector_id, slug as professor_slug, coalesce(name, '') as professor_name, coalesce(title, '') as professor_title, coalesce(url, '') as url, section_type, "
    + ", ".join(f"array_to_string(coalesce({c}, []), '|') as {c}" for c in _ARRAYS)
    + f" from ({_sections(_OF_PROFILE, _NEWEST, 'slug, name, title, url, ' + ', '.join(_ARRAYS))})"
)
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the newest profiles with all that is kept beside the text."""
    c = chunking.profile_chunks(_newest(spark, d))
    return c.select(F.md5(F.col("text")).alias("text_md5"), "vector_id", "professor_slug", "professor_name", "professor_title", "url", "section_type", *(F.array_join(a, "|").alias(a) for a in _ARRAYS))


def _site_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies as an extractor would give them for the newest profiles: their own sections under the names of a site's; every blank biography is no JSON at all."""
    none = F.array().cast("array<string>")
    fields = [F.coalesce(F.col(f), F.lit("") if f == "biography" else none).alias(name) for f, (name, _) in _OF_SITE.items()]
    reply = F.when(tx.is_blank(F.col("biography")), "no json").otherwise(F.to_json(F.struct(*fields)))
    return _newest(spark, d).select("slug", F.col("name").alias("professor_name"), F.col("title").alias("professor_title"), F.col("url").alias("source_url"), F.lit("v1").alias("schema_version"), F.lit("h").alias("page_hash"), reply.alias("reply"))


_REPLIED = f"(select * from {_NEWEST} where coalesce(biography, '') <> '')"


@query(f"select slug, cast(list_sum(list_transform([{', '.join('len(' + f + ')' if f != 'biography' else '1' for f in _OF_SITE)}], lambda n: case when coalesce(n, 0) > 0 then 1 else 0 end)) as bigint) as n_sections from {_REPLIED} union all select slug, 0 from {_NEWEST} where coalesce(biography, '') = ''")
def site_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of sites from replies: filled sections only, none from a reply that is no JSON object."""
    return crawl.site_records(_site_replies(spark, d)).select("slug", F.size("sections").cast("long").alias("n_sections"))


@query(f"select vector_id, coalesce(nullif(name, ''), slug) as professor_name, coalesce(title, '') as professor_title, coalesce(url, '') as url, section_type, 'sha256:' || substr(sha256(text), 1, 32) as content_hash from ({_sections(_OF_SITE, _REPLIED, 'slug, name, title, url')})")
def site_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of site records, single texts and lists."""
    return chunking.site_chunks(crawl.site_records(_site_replies(spark, d))).select("vector_id", "professor_name", "professor_title", "url", "section_type", "content_hash")


_SUBSTANTIVE = f"(select * from {_NEWEST} where coalesce(biography, '') <> '' or len(research_interests) > 0 or len(areas_of_interest) > 0)"


@query(f"select vector_id, md5(text) as text_md5 from ({_sections(_OF_PROFILE, _SUBSTANTIVE, 'slug')} union all {_sections(_OF_SITE, _REPLIED, 'slug')})")
def collected_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of substantive profiles and of the sites of all profiles, substantive or not."""
    return chunking.collect_chunks(_newest(spark, d), crawl.site_records(_site_replies(spark, d))).select("vector_id", F.md5(F.col("text")).alias("text_md5"))


@query(f"select count(*) filter (where h is null) as new, count(*) filter (where h is not null and h <> s) as changed, count(*) filter (where h = s) as unchanged, (select count(*) from {_LAST}) as stored from (select nullif(content_hash, '') as h, 'sha256:' || substr(sha256(text), 1, 32) as s from {_LAST})")
def ingest_pending(spark: SparkSession, d: str) -> DataFrame:
    """The ingest job over a state that holds the chunks' stored hashes: what it embeds and merges, and how many rows the index has then."""
    last = state.last_wins(table(spark, d, "chunks"), "vector_id", "ingested_at", "chunk_id")
    keep = "vector_id string, text string, section_type string, content_hash string, ingested_at timestamp, values array<float>"
    store = state.Snapshots(spark, f"{scratch(spark)}/index-{len(_FOLDERS)}-{id(last)}", keep)
    store.merge(last.select("vector_id", "text", "section_type", "content_hash", "ingested_at", F.lit(None).cast("array<float>").alias("values")), "vector_id")
    again = table(spark, d, "chunks").select("vector_id", "text", "section_type", tx.content_hash(F.col("text")).alias("content_hash"), "ingested_at", "chunk_id")
    counts = jobs.ingest_job(again, store, lambda c: external.embed(c, lambda: external.HashEmbedder(64)), ("ingested_at", "chunk_id"), 64)
    return counts.withColumn("stored", F.lit(store.read().count()).cast("long"))


# ---- directory ---------------------------------------------------------------------------------------------------

_ROOT = "https://directory.havenmoor.example/people/"
_PATTERN = r"https://directory\.havenmoor\.example/people/[a-z0-9-]+/"


def _listing(spark: SparkSession, d: str, on_page: int = 25) -> DataFrame:
    """(url, html) of a paged listing that links the profiles' addresses, relative ones among them."""
    all_ = table(spark, d, "profiles").where(F.col("url").isNotNull()).select("url").distinct()
    href = F.when(F.xxhash64("url") % 2 == 0, F.replace("url", F.lit("https://directory.havenmoor.example"), F.lit(""))).otherwise(F.col("url"))
    rows = state.batches(all_, on_page, "url").groupBy("batch").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("url", href.alias("h")))), lambda x: F.concat(F.lit('<a href="'), _escaped(x["h"]), F.lit('">profile</a>')))).alias("links"))
    last = stored(rows, "listing")
    n = last.agg(F.max("batch")).first()[0]
    nav = F.lit(f'<a class="page-numbers" href="/people/page/2/">2</a> <a class="page-numbers" href="/people/page/{int(n or 0) + 1}/">last</a> <a href="/people/page/999/">no number</a>')
    return last.select(F.when(F.col("batch") == 0, _ROOT).otherwise(F.format_string(_ROOT + "page/%d/", F.col("batch") + 1)).alias("url"), F.concat("links", F.lit("\n"), nav).alias("html"))


@query("select distinct url from profiles where regexp_full_match(url, 'https://directory\\.havenmoor\\.example/people/[a-z0-9-]+/')")
def discovered_urls(spark: SparkSession, d: str) -> DataFrame:
    """Profile addresses found by walking a paged listing from its first page."""
    return jobs.discover(spark, crawl.fetch_from(_listing(spark, d)), _ROOT, _PATTERN)


@query("select distinct on (url) crawl_id, page_no, last_no from (select crawl_id, page_no, url, coalesce(list_max(list_transform(regexp_extract_all(html, '/page/([0-9]+)/?', 1), lambda x: cast(x as int))), 1) as last_no from " + _PAGES + ") where 1 = 0 union all select 0, 0, greatest(cast(ceil(count(distinct url) / 25.0) as int), 2) from profiles where url is not null")
def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """How many pages the first page of a listing tells of."""
    return _listing(spark, d).where(F.col("url") == _ROOT).select(F.lit(0).cast("long").alias("crawl_id"), F.lit(0).alias("page_no"), crawl.last_page_number(F.col("html")).alias("last_no"))


_SLUG = "regexp_extract(url, '([^/]*)/*$', 1)"


@query(f"select slug, {_STRIPPED('name')} as name, {_STRIPPED('title')} as title, cast(null as varchar) as error from (select distinct on (url) *, {_SLUG} as _s from profiles where url is not null order by url, loaded_at desc, profile_id desc) p where not exists (select 1 from crawl_results c where c.slug = p._s) and slug = _s union all select _s, null, null, 'http_404' from (select 'gone' as _s)")
def directory_job(spark: SparkSession, d: str) -> DataFrame:
    """Directory pages of profiles that were never crawled, fetched and parsed; an address that is gone has its error."""
    p = table(spark, d, "profiles").where("url is not null")
    newest = state.last_wins(p, "url", "loaded_at", "profile_id").where(F.col("slug") == urls.slug_of(F.col("url")))
    asked = newest.select("url").unionByName(spark.createDataFrame([("https://directory.havenmoor.example/people/gone/",)], "url string"))
    got = jobs.directory_job(asked, table(spark, d, "crawl_results"), crawl.fetch_from(newest.select("url", directory_page().alias("html"))))
    return got.select("slug", "name", "title", "error")


@query(f"select profile_id, slug from (select *, row_number() over (order by slug) as i from {_NEWEST}) where i <= 20")
def limited_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The first profiles by slug, as a job with a limit takes them (the limit is the feature)."""
    return _newest(spark, d).orderBy("slug").limit(20).select("profile_id", "slug")


# ---- sites -------------------------------------------------------------------------------------------------------


@query("select crawl_id, reason as code from crawl_results where regexp_matches(reason, '^(timeout|conn_error:[A-Za-z]+|http_[45][0-9][0-9]|non_html)$') union all select crawl_id, cast(null as varchar) from crawl_results where reason is null")
def fetch_failures(spark: SparkSession, d: str) -> DataFrame:
    """Why fetches failed, from status, content type and error as a client reports them."""
    r = F.col("reason")
    c = table(spark, d, "crawl_results").where(r.isNull() | r.rlike("^(timeout|conn_error:[A-Za-z]+|http_[45][0-9][0-9]|non_html)$"))
    status = F.when(r.startswith("http_"), F.substring(r, 6, 3).cast("int")).when(r.isNull() | (r == "non_html"), 200)
    kind = F.when(r == "non_html", "application/pdf").when(r.isNull(), "Text/HTML; charset=utf-8")
    error = F.when(r == "timeout", r).when(r.startswith("conn_error:"), F.substring_index(r, ":", -1))
    return c.select("crawl_id", crawl.failure(status, kind, error).alias("code"))


@query(f"select crawl_id, page_no, md5(html) as declared, md5(html) as detected from {_PAGES}")
def decoded_pages(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of pages read by their declared charset, and by the detected one where none is declared."""
    p = pages(spark, d).select("crawl_id", F.col("page_no").cast("long").alias("page_no"), F.encode("html", "UTF-16BE").alias("a"), F.encode("html", "UTF-8").alias("b"))
    return p.select("crawl_id", "page_no", F.md5(crawl.decoded(F.col("a"), F.lit("text/html; charset=utf-16-be"), F.lit("utf-8"))).alias("declared"), F.md5(crawl.decoded(F.col("b"), F.lit("text/html"), F.lit("utf-8"))).alias("detected"))


@query(f"select crawl_id, page_no, not contains(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/people') or regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) = '' as allowed from (select *, regexp_replace(url, '^[a-z]+://[^/]*', '') as path from {_PAGES}) where 1 = 0 union all select crawl_id, page_no, coalesce(not regexp_matches(url, '^[a-z]+://[^/]*/~[a-m]'), true) from {_PAGES}")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Whether pages may be fetched, by robots files that bar a part of each host."""
    p = pages(spark, d).select("crawl_id", F.col("page_no").cast("long").alias("page_no"), "url")
    bar = "User-agent: *\n" + "".join(f"Disallow: /~{chr(c)}\n" for c in range(ord("a"), ord("n")))
    rules = p.select(urls.scheme(F.col("url")).alias("scheme"), urls.netloc(F.col("url")).alias("host")).where("host <> ''").distinct().select("scheme", "host", F.lit(200).alias("status"), F.lit(bar).alias("body"))
    return crawl.allowed(p, rules, "url", "quarrymill").select("crawl_id", "page_no", "allowed")


_CRAWLED = "(select distinct on (slug) slug, crawl_id from crawl_results where slug is not null and len(pages) > 0 and pages[1].url is not null order by slug, fetched_at desc, crawl_id desc)"
_KNOWN_PAGES = f"(select url, max(html) as html from (select regexp_replace(split_part(url, '#', 1), '/+$', '') as url, html from {_PAGES} where url is not null and html is not null) group by url)"
_HOMES = f"(select s.slug, regexp_replace(c.pages[1].url, '/+$', '') as url from {_CRAWLED} s join crawl_results c on c.crawl_id = s.crawl_id)"
_LINKS = _HOP.replace(f"from {_PAGES}", f"from (select h.slug as crawl_id, 0 as page_no, h.url, k.html from {_HOMES} h join {_KNOWN_PAGES} k on k.url = h.url)")
_FETCHED = f"(select h.slug, h.url, 0 as hop, k.html, case when k.url is null then 'http_404' end as reason from {_HOMES} h left join {_KNOWN_PAGES} k on k.url = h.url union all select slug, url, cast(hop as int), html, null from (select l.crawl_id as slug, l.href as url, k.html, row_number() over (partition by l.crawl_id order by l.pos, l.href) as hop from ({_LINKS}) l join {_KNOWN_PAGES} k on k.url = l.href join {_HOMES} h on h.slug = l.crawl_id and h.url <> l.href) where hop <= 4)"


def _sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(slug, start_url) of sites crawled before, and the table of all pages ever fetched."""
    c = table(spark, d, "crawl_results").where("slug is not null and size(pages) > 0 and pages[0].url is not null")
    sites = state.last_wins(c, "slug", "fetched_at", "crawl_id").select("slug", F.col("pages")[0]["url"].alias("start_url"))
    p = pages(spark, d).where("url is not null and html is not null")
    return sites, p.select(urls.normal(F.col("url")).alias("url"), "html").groupBy("url").agg(F.max("html").alias("html"))


@query(f"select slug, url, hop, reason, md5(html) as html_md5 from {_FETCHED}")
def crawl_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every site crawled anew over all pages ever fetched: home page and up to four linked ones that are there."""
    sites, known = _sites(spark, d)
    got = crawl.crawl(sites.select(F.col("slug").alias("site"), "start_url"), crawl.fetch_from(known))
    return got.select(F.col("site").alias("slug"), "url", F.col("hop").cast("int").alias("hop"), "reason", F.md5(F.col("html")).alias("html_md5"))


_TEXTS = f"(select slug, left(string_agg('[' || url || ']' || chr(10) || t, chr(10) || chr(10) order by url, t), 20000) as text from (select slug, url, {_text_sql()} as t from {_FETCHED} where reason is null) where t <> '' group by slug)"


@query(f"select status, count(*) as n from (select case when h.reason is not null then h.reason when coalesce(length(regexp_replace(t.text, '^{_SP}+|{_SP}+$', '', 'g')), 0) < 200 then 'too_short' else 'to_write' end as status from (select slug, reason from {_FETCHED} where hop = 0) h left join {_TEXTS} t on t.slug = h.slug) group by status")
def sites_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of the sites job over all sites when none is known yet."""
    sites, known = _sites(spark, d)
    asked = sites.select("slug", F.lit("N").alias("name"), F.lit("T").alias("title"), F.col("start_url").alias("source_url"))
    none = spark.createDataFrame([], "slug string, page_hash string")
    _, report = jobs.sites_job(asked, crawl.fetch_from(known), none, dry_run=True)
    return report.select("status", F.col("count").alias("n"))


_CRAWL_TEXT = "(select *, pages[1].html as text, row_number() over (partition by slug order by fetched_at, crawl_id) as _i, count(*) over (partition by slug) as _c from crawl_results where slug is not null)"


@query(f"select n.slug, case when n.reason is not null then n.reason when coalesce(length(regexp_replace(n.text, '^{_SP}+|{_SP}+$', '', 'g')), 0) < 200 then 'too_short' when n.text = o.text and n._c > 1 then 'unchanged' else 'to_write' end as status from {_CRAWL_TEXT} n left join (select * from {_CRAWL_TEXT} where _i = 1 and text is not null) o on o.slug = n.slug where n._i = n._c")
def site_status(spark: SparkSession, d: str) -> DataFrame:
    """The last crawl of each site against what the first one had: failed, too short, unchanged or to write."""
    w = W.partitionBy("slug").orderBy("fetched_at", "crawl_id")
    c = table(spark, d, "crawl_results").where("slug is not null").select("slug", "reason", F.get("pages", F.lit(0))["html"].alias("text"), F.row_number().over(w).alias("i"), F.count("*").over(W.partitionBy("slug")).alias("c"))
    known = c.where("i = 1 and c > 1 and text is not null").select("slug", tx.page_hash(F.col("text"), "v1").alias("page_hash"))
    return crawl.site_status(c.where("i = c"), known).select("slug", "status")
