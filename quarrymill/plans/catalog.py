"""All core queries by name, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.config import NO_ANSWER, PROFILE_SECTIONS, SITE_SECTIONS
from quarrymill.functions import text as tx
from quarrymill.functions import urls
from quarrymill.functions.vectors import top_k
from quarrymill.operators import chunking, crawl, external, profile_html, retrieval, state
from quarrymill.plans import jobs
from quarrymill.runtime import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarrymill.plans import catalog_jobs  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_results").select("crawl_id", "slug", F.posexplode("pages").alias("page_no", "p")).select("crawl_id", "slug", "page_no", F.col("p.url").alias("url"), F.col("p.html").alias("html"))


_PAGES = "(select crawl_id, slug, i - 1 as page_no, pages[i].url as url, pages[i].html as html from (select crawl_id, slug, pages, unnest(range(1, len(pages) + 1)) as i from crawl_results))"
_COS = "list_cosine_similarity(q.embedding::double[], e.embedding::double[])"
_TOPK = f"select * from (select q.vec_id as q_id, e.vec_id, {_COS} as score, row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id) as rank from embeddings q, embeddings e where q.vec_id % 100 = 0) where rank <= 8"


# ---- search ------------------------------------------------------------------------------------------------


def _near(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    return top_k(q, e, 8, "q_id", "q", "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@query(f"select q_id, vec_id, cast(rank as bigint) as rank, round(score, 6) as score from ({_TOPK})")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 8 nearest vectors of the stated query set (ids divisible by 100) among all."""
    return _near(spark, d).select("q_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"select q_id, cast(rank as bigint) as number, coalesce(professor_slug, '') as name, coalesce(section_type, '') as section, md5(coalesce(text, '')) as text_md5, round(score, 6) as score from ({_TOPK}) t left join documents on vec_id = doc_id")
def citations(spark: SparkSession, d: str) -> DataFrame:
    """Matches as numbered citations; what a document lacks is empty."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "professor_slug", "section_type", "text")
    e = lambda c: F.coalesce(c, F.lit(""))
    return _near(spark, d).join(docs, "vec_id", "left").select("q_id", F.col("rank").cast("long").alias("number"), e(F.col("professor_slug")).alias("name"), e(F.col("section_type")).alias("section"), F.md5(e(F.col("text"))).alias("text_md5"), F.round("score", 6).alias("score"))


@query("select request_id, result_id, round(list_cosine_similarity(a.vec::double[], b.vec::double[]), 6) as score from retrieval_results r join chunk_vectors a on a.vector_id = r.query_vector_id join chunk_vectors b on b.vector_id = r.document_id where list_sum(list_transform(a.vec, lambda x: x * x)) > 0 and list_sum(list_transform(b.vec, lambda x: x * x)) > 0")
def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of query and document of every logged match, as the vectors stand now."""
    from quarrymill.functions.vectors import cosine

    v = table(spark, d, "chunk_vectors").select("vector_id", "vec")
    r = table(spark, d, "retrieval_results").select("request_id", "result_id", "query_vector_id", "document_id")
    both = r.join(v.select(F.col("vector_id").alias("query_vector_id"), F.col("vec").alias("a")), "query_vector_id").join(v.select(F.col("vector_id").alias("document_id"), F.col("vec").alias("b")), "document_id")
    return both.select("request_id", "result_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("score")).where("score is not null")


_RESULTS = "(select * from (select *, row_number() over (partition by result_id order by loaded_at desc, asked_at desc, document_id) as _n from retrieval_results) where _n = 1)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Rows delivered twice count once, the latest load wins."""
    r = table(spark, d, "retrieval_results")
    return r.groupBy("result_id").agg(F.min_by(F.struct(*r.columns), F.struct(-F.unix_micros("loaded_at"), -F.unix_micros("asked_at"), "document_id")).alias("r")).select("r.*")


@query(f"select request_id, result_id, cast(row_number() over (partition by request_id order by case when isnan(score) then null else score end desc nulls last, result_id) as bigint) as rank from {_RESULTS}")
def ranked_results(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each request by falling score; null and NaN come last."""
    return retrieval.ranked(_results(spark, d), "request_id", "score", "result_id").select("request_id", "result_id", F.col("rank").cast("long").alias("rank"))


@query(f"select request_id, md5(string_agg('[' || result_no || '] ' || coalesce(metadata.professor_name, '') || ' (' || coalesce(metadata.professor_title, '') || ') — ' || coalesce(metadata.section_type, '') || chr(10) || coalesce(metadata.text, ''), chr(10) || chr(10) order by result_no, '[' || result_no || '] ' || coalesce(metadata.professor_name, ''))) as context_md5, count(*) as n from {_RESULTS} group by request_id")
def prompt_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The numbered context of each request."""
    r = _results(spark, d).select("request_id", F.col("result_no").alias("rank"), "metadata.*")
    return retrieval.contexts(r, "request_id").select("request_id", F.md5("context").alias("context_md5")).join(r.groupBy("request_id").agg(F.count("*").alias("n")), "request_id")


@query(f"select result_id, cast(result_no as bigint) as number, coalesce(metadata.professor_name, '') as name, coalesce(metadata.professor_title, '') as title, coalesce(metadata.section_type, '') as section, coalesce(metadata.url, '') as url from {_RESULTS}")
def citation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Citations of all logged matches with defaults for missing metadata."""
    r = _results(spark, d).select("result_id", F.col("result_no").cast("long").alias("rank"), "score", "metadata.*")
    return retrieval.citations(r, "result_id").select("result_id", "number", "name", "title", "section", "url")


# ---- text functions ------------------------------------------------------------------------------------------


@query("select chunk_id, 'sha256:' || substr(sha256(text), 1, 32) as h, coalesce(content_hash = 'sha256:' || substr(sha256(text), 1, 32), false) as is_current from chunks")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Content hash of every chunk and whether the stored one is current."""
    h = tx.content_hash(F.col("text"))
    return table(spark, d, "chunks").select("chunk_id", h.alias("h"), F.coalesce(F.col("content_hash") == h, F.lit(False)).alias("is_current"))


@query("select doc_id, 'sha256:' || substr(sha256('v1' || chr(10) || text), 1, 32) as h from documents")
def page_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of a document with the schema version."""
    return table(spark, d, "documents").select("doc_id", tx.page_hash(F.col("text"), "v1").alias("h"))


_SP = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]"
_CLEAN = rf"lower(regexp_replace(trim(regexp_replace(text, '{_SP}+', ' ', 'g'), ' '), '[^\p{{L}}\p{{N}}_\s\x{{85}}\x{{A0}}\-\?]', '', 'g'))"


@query(f"select chunk_id, md5({_CLEAN}) as cleaned from chunks")
def cleaned_text(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk cleaned as a query would be."""
    return table(spark, d, "chunks").select("chunk_id", F.md5(tx.clean_text(F.col("text"))).alias("cleaned"))


@query(rf"select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SP}+'), lambda x: x <> '')) as n from documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.token_count(F.col("text")).cast("long").alias("n"))


@query(rf"select chunk_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({_CLEAN}, ' +'), lambda x: length(x) > 3 and not starts_with(x, '-'))))[1:10], ' ') as keywords from chunks where text is not null")
def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", F.array_join(tx.keywords(tx.clean_text(F.col("text"))), " ").alias("keywords"))


# RE2 knows word ends of ASCII only: other letters are written as one that none of these shapes has, but that is part of a word
_ENTITIES = (
    r"list_sort(list_distinct(list_concat(regexp_extract_all(coalesce(text, ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'), "
    rf"regexp_extract_all(coalesce(text, ''), 'https?://[^{_SP[1:-1]}]+'), "
    + ", ".join(rf"regexp_extract_all(_w, '{p}')" for p in (r"[\x{660}-\x{669}\x{966}-\x{96F}\x{FF10}-\x{FF19}\x{1D7CE}-\x{1D7FF}]+", r"\b[A-Z]{2,4}\s?[0-9]{3,4}\b", r"\b[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\b", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"))
    + ")))"
)
# letters beyond ASCII count as parts of words, signs and spaces do not
_DOCS = r"(select doc_id, text, regexp_replace(regexp_replace(coalesce(text, ''), '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{373}\x{376}-\x{377}\x{37B}-\x{37D}\x{386}\x{388}-\x{3FF}\x{400}-\x{481}\x{48A}-\x{52F}]', '_', 'g'), '[\p{Lo}\p{Lm}\p{M}]', '_', 'g') as _w from documents)"


@query(f"select doc_id, array_to_string({_ENTITIES}, ' ') as found from {_DOCS}")
def entity_lists(spark: SparkSession, d: str) -> DataFrame:
    """All five kinds of entities in documents."""
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.entities(F.col("text")), " ").alias("found"))


@query(r"select doc_id, case when regexp_matches(c, 'who|professor|faculty|teaches|advisor') then 'person' when regexp_matches(c, 'course|class|teach|syllabus') then 'course' when regexp_matches(c, 'research|work on|area|interest|lab') then 'research_area' when regexp_matches(c, 'where|location|campus') then 'location' else 'informational' end as intent, ends_with(rtrim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13) || chr(160)), '?') as is_question from (select doc_id, text, " + _CLEAN + " as c from documents)")
def query_intent(spark: SparkSession, d: str) -> DataFrame:
    """Documents read as queries: what is asked for, and whether it is a question."""
    return table(spark, d, "documents").select("doc_id", tx.intent(tx.clean_text(F.col("text"))).alias("intent"), tx.is_question(F.col("text")).alias("is_question"))


@query(
    "select doc_id, md5(c) as cleaned, "
    + r"case when regexp_matches(c, 'who|professor|faculty|teaches|advisor') then 'person' when regexp_matches(c, 'course|class|teach|syllabus') then 'course' when regexp_matches(c, 'research|work on|area|interest|lab') then 'research_area' when regexp_matches(c, 'where|location|campus') then 'location' else 'informational' end as intent, "
    + "len(e) as n_entities, n as length, case when n < 3 then 'expand' when len(e) > 0 then 'hybrid' else 'semantic' end as strategy "
    + f"from (select doc_id, {_CLEAN} as c, {_ENTITIES} as e, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SP}+'), lambda x: x <> '')) as n from {_DOCS})"
)
def query_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis of documents as queries."""
    t, c = F.col("text"), tx.clean_text(F.col("text"))
    parts = table(spark, d, "documents").select("doc_id", c.alias("c"), tx.entities(t).alias("e"), tx.token_count(t).cast("long").alias("length"))
    return parts.select("doc_id", F.md5("c").alias("cleaned"), tx.intent(F.coalesce("c", F.lit(""))).alias("intent"), F.size("e").cast("long").alias("n_entities"), "length", tx.strategy(F.col("length"), F.col("e")).alias("strategy"))


@query("select section_type, case section_type " + " ".join(f"when '{k}' then '{v}'" for k, v in (PROFILE_SECTIONS | SITE_SECTIONS).items()) + " else upper(left(section_type, 1)) || lower(substr(replace(section_type, '_', ' '), 2)) end as label, count(*) as n from chunks where section_type is not null group by 1, 2")
def section_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the sections that occur, with a fallback for unknown ones."""
    return table(spark, d, "chunks").where("section_type is not null").groupBy("section_type").agg(F.count("*").alias("n")).select("section_type", tx.label_of(F.col("section_type"), PROFILE_SECTIONS | SITE_SECTIONS).alias("label"), "n")


# ---- chunks and state ----------------------------------------------------------------------------------------


@query("select profile_id from profiles where coalesce(biography, '') <> '' or len(research_interests) > 0 or len(areas_of_interest) > 0")
def substantive_profiles(spark: SparkSession, d: str) -> DataFrame:
    return chunking.substantive(table(spark, d, "profiles")).select("profile_id")


@query("select count(*) filter (where coalesce(biography, '') <> '' or len(research_interests) > 0 or len(areas_of_interest) > 0) as n, count(*) as total from profiles")
def substantive_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profiles")
    ok = ~tx.is_blank(F.col("biography")) | ~tx.is_empty(F.col("research_interests")) | ~tx.is_empty(F.col("areas_of_interest"))
    return p.agg(F.count_if(ok).alias("n"), F.count("*").alias("total"))


def _chunk_sql() -> str:
    head = "coalesce(nullif(name, ''), slug) || case when coalesce(title, '') = '' then '' else ' (' || title || ')' end"
    parts = []
    for k, label in PROFILE_SECTIONS.items():
        body = "biography" if k == "biography" else f"'- ' || array_to_string({k}, chr(10) || '- ')"
        cond = "coalesce(biography, '') <> ''" if k == "biography" else f"len({k}) > 0"
        parts.append(f"select profile_id, slug || '#{k}' as vector_id, {head} || chr(10) || '{label}:' || chr(10) || {body} as text from profiles where coalesce(slug, '') <> '' and {cond}")
    return "select profile_id, vector_id, length(text) as n, 'sha256:' || substr(sha256(text), 1, 32) as content_hash from (" + " union all ".join(parts) + ")"


@query(_chunk_sql())
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all profile rows."""
    p = table(spark, d, "profiles")
    c = chunking.profile_chunks(p.withColumn("url", F.col("profile_id").cast("string")))
    return c.select(F.col("url").cast("long").alias("profile_id"), "vector_id", F.length("text").cast("long").alias("n"), "content_hash")


_LAST = "(select * from (select *, row_number() over (partition by vector_id order by ingested_at desc, chunk_id desc) as _n from chunks) where _n = 1)"


@query(f"select vector_id, chunk_id from {_LAST}")
def last_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Of chunks ingested again, the last."""
    return state.last_wins(table(spark, d, "chunks"), "vector_id", "ingested_at", "chunk_id").select("vector_id", "chunk_id")


def _delta(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the chunks against the hashes stored with them."""
    last = state.last_wins(table(spark, d, "chunks"), "vector_id", "ingested_at", "chunk_id")
    return state.with_status(last.select("vector_id", tx.content_hash(F.col("text")).alias("content_hash")), last.select("vector_id", "content_hash"), "vector_id", "content_hash")


_STATUS = f"select vector_id, case when coalesce(content_hash, '') = '' then 'new' when content_hash = 'sha256:' || substr(sha256(text), 1, 32) then 'unchanged' else 'changed' end as status from {_LAST}"


@query(_STATUS)
def delta_status(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d).select("vector_id", "status")


@query(f"select vector_id from ({_STATUS}) where status <> 'unchanged'")
def pending_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d).where("status <> 'unchanged'").select("vector_id")


@query(f"select count(*) filter (where status = 'new') as new, count(*) filter (where status = 'changed') as changed, count(*) filter (where status = 'unchanged') as unchanged from ({_STATUS})")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return state.counters(_delta(spark, d), F.col("status"), ("new", "changed", "unchanged"))


@query(f"select vector_id, section_type, 'chunk' as origin from {_LAST} union all select vector_id, section_type, 'vector' as origin from chunk_vectors v where not exists (select 1 from chunks c where c.vector_id = v.vector_id)")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks merged over the vector table by key; the last version of a chunk wins, nothing is deleted."""
    old = table(spark, d, "chunk_vectors").select("vector_id", "section_type", F.lit("vector").alias("origin"))
    new = table(spark, d, "chunks").select("vector_id", "section_type", "ingested_at", "chunk_id", F.lit("chunk").alias("origin"))
    return state.merged(old, new, "vector_id", "ingested_at", "chunk_id").select("vector_id", "section_type", "origin")


@query(f"select document_id as vector_id, content_hash from (select distinct document_id from retrieval_results) r join {_LAST} c on c.vector_id = r.document_id where coalesce(content_hash, '') <> ''")
def fetched_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Stored hashes of all documents that were ever retrieved."""
    last = state.last_wins(table(spark, d, "chunks"), "vector_id", "ingested_at", "chunk_id")
    ids = table(spark, d, "retrieval_results").select(F.col("document_id").alias("vector_id"))
    return state.stored_hashes(last, ids, "vector_id", "content_hash")


@query("select profile_id, slug from profiles p where not exists (select 1 from crawl_results c where c.slug = p.slug)")
def skip_existing(spark: SparkSession, d: str) -> DataFrame:
    """Profiles never crawled."""
    return state.not_yet(table(spark, d, "profiles"), table(spark, d, "crawl_results"), "slug").select("profile_id", "slug")


@query("select crawl_id from crawl_results c where exists (select 1 from profiles p where p.slug = c.slug)")
def loaded_only(spark: SparkSession, d: str) -> DataFrame:
    return state.only_known(table(spark, d, "crawl_results"), table(spark, d, "profiles"), "slug").select("crawl_id")


@query("select chunk_id, cast(floor((row_number() over (order by chunk_id) - 1) / 64) as bigint) as batch from chunks")
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    return state.batches(table(spark, d, "chunks").select("chunk_id"), 64, "chunk_id").select("chunk_id", F.col("batch").cast("long").alias("batch"))


@query("select vector_id, case when length(text) > 300 then left(text, 300) || '...' else text end as text from (select vector_id, text from chunks where vector_id is not null and text is not null order by vector_id, text limit 3)")
def dry_run_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first three chunks, cut: what a dry run shows."""
    return jobs.preview(table(spark, d, "chunks").where("vector_id is not null and text is not null"))


@query("select count(*) filter (where length(text) between 2 and 2000) as allowed, count(*) filter (where length(text) not between 2 and 2000) as refused from documents")
def question_guard(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return retrieval.askable(docs, "text").agg(F.count("*").alias("allowed")).crossJoin(docs.where(~F.length("text").between(2, 2000)).agg(F.count("*").alias("refused")))


# ---- sites ---------------------------------------------------------------------------------------------------


@query("select profile_id, regexp_extract(url, '([^/]*)/*$', 1) as slug from profiles where url is not null")
def url_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "profiles").where("url is not null").select("profile_id", urls.slug_of(F.col("url")).alias("slug"))


@query(f"select crawl_id, page_no, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host, regexp_replace(split_part(url, '#', 1), '/+$', '') as url from {_PAGES}")
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("crawl_id", F.col("page_no").cast("long").alias("page_no"), urls.netloc(F.col("url")).alias("host"), urls.normal(F.col("url")).alias("url"))


@query("select profile_id, list_filter(list_transform(websites, lambda w: w.href), lambda h: starts_with(h, 'http'))[1] as site from profiles where len(list_filter(list_transform(websites, lambda w: w.href), lambda h: starts_with(h, 'http'))) > 0")
def website_links(spark: SparkSession, d: str) -> DataFrame:
    """The first http link of each profile that has one."""
    return table(spark, d, "profiles").select("profile_id", jobs.website_url(F.col("websites")).alias("site")).where("site is not null")


@query("select reason, count(*) as n from crawl_results where reason is not null group by reason")
def failure_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_results").where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query("select distinct url from profiles where regexp_full_match(url, 'https://directory\\.havenmoor\\.example/people/[a-z0-9-]+/')")
def directory_urls(spark: SparkSession, d: str) -> DataFrame:
    """Distinct addresses of directory pages, in order."""
    return table(spark, d, "profiles").where(F.col("url").rlike(r"^https://directory\.havenmoor\.example/people/[a-z0-9-]+/$")).select("url").distinct().orderBy("url")


_HREFS = r"""regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 1)"""


@query(f"select crawl_id, page_no, cast(i - 1 as bigint) as pos, hrefs[i] as href from (select crawl_id, page_no, hrefs, unnest(range(1, len(hrefs) + 1)) as i from (select crawl_id, page_no, {_HREFS} as hrefs from {_PAGES}))")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    """All links of all pages in document order."""
    return crawl.anchors(pages(spark, d), "html", "crawl_id", "page_no").select("crawl_id", F.col("page_no").cast("long").alias("page_no"), F.col("pos").cast("long").alias("pos"), "href")


_HOP = r"""select crawl_id, page_no, min(i - 1) as pos, href from (select crawl_id, page_no, i, base, regexp_replace(split_part(hrefs[i], '#', 1), '/+$', '') as href, trim(regexp_replace(regexp_replace(labels[i], '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as label from (select *, unnest(range(1, len(hrefs) + 1)) as i from (select crawl_id, page_no, regexp_replace(url, '/+$', '') as base, """ + _HREFS + " as hrefs, " + _HREFS.replace(", 1)", ", 2)") + f" as labels from {_PAGES}))) where regexp_matches(href, '^https?://') and regexp_extract(href, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(base, '^[a-z]+://([^/?#]*)', 1) and regexp_matches(lower(href || ' ' || label), 'research|publication|publications|bio|about|project|projects|group|lab|labs|people|students|news|cv') group by crawl_id, page_no, href"


@query(_HOP)
def one_hop_links(spark: SparkSession, d: str) -> DataFrame:
    """Links worth following from each page."""
    return crawl.one_hop_links(pages(spark, d), "html", "url", "crawl_id", "page_no").select("crawl_id", F.col("page_no").cast("long").alias("page_no"), F.col("pos").cast("long").alias("pos"), "href")


def _text_sql() -> str:
    t = "html"
    for tag in ("head", "script", "style", "noscript", "nav", "footer"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/td|/table|/ul|/section|/article)\\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', '', 'g')"
    for name, char in crawl.ENTITIES:
        t = f"replace({t}, '{name}', " + ("''''" if char == "'" else f"'{char}'") + ")"
    t = f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'), '^{_SP}+|{_SP}+$', '', 'g')"


@query(f"select crawl_id, page_no, md5(t) as text_md5, length(t) >= 200 as enough, left(t, 80) as start from (select crawl_id, page_no, {_text_sql()} as t from {_PAGES})")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of every page by rules, and whether it was worth reading."""
    p = pages(spark, d).withColumn("t", crawl.main_text(F.col("html")))
    return p.select("crawl_id", F.col("page_no").cast("long").alias("page_no"), F.md5("t").alias("text_md5"), crawl.enough_text(F.col("t")).alias("enough"), F.left("t", F.lit(80)).alias("start"))


@query(f"select crawl_id, md5(left(string_agg('[' || url || ']' || chr(10) || t, chr(10) || chr(10) order by url, t), 20000)) as text_md5 from (select crawl_id, url, {_text_sql()} as t from {_PAGES}) where t <> '' group by crawl_id")
def site_texts(spark: SparkSession, d: str) -> DataFrame:
    """One text per crawled site, pages by URL, cut at 20,000 characters."""
    p = pages(spark, d).withColumn("t", crawl.main_text(F.col("html")))
    return crawl.site_texts(p, "crawl_id", "url", "t").select("crawl_id", F.md5("text").alias("text_md5"))


@query(f"select crawl_id, count(*) as n from {_PAGES} where page_no < 5 group by crawl_id")
def page_cap(spark: SparkSession, d: str) -> DataFrame:
    """Pages kept per site: the home page and four more (the cap is the feature)."""
    from pyspark.sql import Window as W

    p = pages(spark, d).withColumn("n", F.row_number().over(W.partitionBy("crawl_id").orderBy("page_no"))).where("n <= 5")
    return p.groupBy("crawl_id").agg(F.count("*").alias("n"))


@query("select slug, max_by(crawl_id, (fetched_at, crawl_id)) as crawl_id, count(*) as n from crawl_results where slug is not null group by slug")
def last_crawls(spark: SparkSession, d: str) -> DataFrame:
    """The last crawl of each site and how often it was crawled."""
    return table(spark, d, "crawl_results").where("slug is not null").groupBy("slug").agg(F.max_by("crawl_id", F.struct("fetched_at", "crawl_id")).alias("crawl_id"), F.count("*").alias("n"))


def _escaped(c: F.Column) -> F.Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def directory_page() -> F.Column:
    """A directory page as it would show a profile; for round trips through the parser."""
    none = F.array().cast("array<string>")
    each = lambda c, shown: F.array_join(F.transform(F.coalesce(F.col(c), none), shown), "")
    item = lambda x: F.concat(F.lit('<li class="single-people__aside-list-item">'), _escaped(x), F.lit("</li>"))
    linked = lambda x: F.concat(F.lit('<li class="single-people__aside-list-item"><a href="/x"><svg><title>icon</title></svg>'), _escaped(x), F.lit("</a></li>"))
    block = lambda head, inner: F.concat(F.lit(f'<div class="single-people__aside-block"><h3>{head}</h3><ul>'), inner, F.lit("</ul></div>"))
    points = lambda head, c: F.concat(F.lit(f'<div class="accordion-item"><button class="accordion-header">{head}</button><div class="accordion-content__inner"><ul class="wp-block-list">'), each(c, lambda x: F.concat(F.lit("<li>"), _escaped(x), F.lit("</li>"))), F.lit("</ul></div></div>"))
    one = lambda tag, cls, c: F.concat(F.lit(f'<{tag} class="{cls}">'), F.coalesce(_escaped(F.col(c)), F.lit("")), F.lit(f"</{tag}>"))
    sites = F.array_join(F.transform(F.filter(F.coalesce("websites", F.array().cast("array<struct<text:string,href:string>>")), lambda w: w["href"].isNotNull()), lambda w: F.concat(F.lit('<p><a href="'), _escaped(w["href"]), F.lit('">'), _escaped(F.coalesce(w["text"], F.lit(""))), F.lit("</a> more</p>"))), "")
    scholar = F.coalesce(F.concat(F.lit('<div class="single-people__aside-block"><h3>Google Scholar</h3><p><a href="'), _escaped(F.col("google_scholar")), F.lit('">here</a></p></div>')), F.lit(""))
    photo = F.coalesce(F.concat(F.lit('<figure class="single-people__header-figure"><img src="'), _escaped(F.col("photo_url")), F.lit('"></figure>')), F.lit(""))
    bio = F.coalesce(F.concat(F.lit('<div class="accordion-item"><button class="accordion-header">Biography</button><div class="accordion-content__inner"><p>'), F.replace(_escaped(F.col("biography")), F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></div></div>")), F.lit(""))
    return F.concat(
        photo, one("h1", "single-people__header-title", "name"), one("p", "single-people__header-subtitle", "pronouns"), one("p", "single-people__header-description", "title"), F.lit('<p class="single-people__aside-roles">'), _escaped(F.array_join(F.coalesce("roles", none), ", ")), F.lit("</p>"),
        block("Campus", each("campuses", item)), block("Area of Interest", each("areas_of_interest", linked)), F.lit('<div class="single-people__aside-block"><h3>Website</h3>'), sites, F.lit("</div>"), scholar, block("Contact", each("contact", item)),
        bio, points("Education", "education"), points("Research Interests", "research_interests"), points("Labs and Groups", "labs_and_groups"), points("Projects", "projects"),
    )


_STRIPPED = lambda c: f"nullif(regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g'), '')"
_JOINED = lambda c: f"coalesce(array_to_string(list_filter(list_transform({c}, lambda x: regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g')), lambda x: x <> ''), '|'), '')"
_LISTS = {"campuses": "campuses", "areas_of_interest": "areas", "contact": "contact", "education": "education", "research_interests": "interests", "labs_and_groups": "labs", "projects": "projects"}


@query(
    f"select profile_id, {_STRIPPED('name')} as name, {_STRIPPED('pronouns')} as pronouns, {_STRIPPED('title')} as title, photo_url, google_scholar, "
    + ", ".join(f"{_JOINED(c)} as {a}" for c, a in _LISTS.items())
    + f", coalesce(array_to_string(list_transform(roles, lambda x: regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g')), '|'), '') as roles"
    + f", coalesce(array_to_string(list_transform(list_filter(websites, lambda w: w.href is not null), lambda w: regexp_replace(coalesce(w.text, ''), '^{_SP}+|{_SP}+$', '', 'g') || '>' || w.href), '|'), '') as websites"
    + f", md5(nullif(array_to_string(list_filter(list_transform(string_split(biography, chr(10) || chr(10)), lambda x: regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10)), '')) as biography_md5 from profiles"
)
def profile_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every profile shown as a directory page and parsed back."""
    got = profile_html.parse_profiles(table(spark, d, "profiles").select("profile_id", directory_page().alias("html")), "html", "profile_id")
    return got.select(
        "profile_id", "name", "pronouns", "title", "photo_url", "google_scholar", *(F.array_join(c, "|").alias(a) for c, a in _LISTS.items()), F.array_join("roles", "|").alias("roles"),
        F.array_join(F.transform("websites", lambda w: F.concat(w["text"], F.lit(">"), w["href"])), "|").alias("websites"), F.md5(F.col("biography")).alias("biography_md5"),
    )


# ---- models --------------------------------------------------------------------------------------------------


@query(rf"select vector_id, 1024 as size, len(list_filter(regexp_split_to_array(lower(text), '{_SP}+'), lambda x: x <> '')) > 0 as is_unit from {_LAST} where coalesce(content_hash, '') <> 'sha256:' || substr(sha256(text), 1, 32)")
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pending chunks with vectors of the offline embedder, their size and whether their length is one; unchanged ones never reach it."""
    last = state.last_wins(table(spark, d, "chunks"), "vector_id", "ingested_at", "chunk_id")
    new = last.select("vector_id", "text", tx.content_hash(F.col("text")).alias("content_hash"))
    todo = state.pending(new, last.select("vector_id", "content_hash"), "vector_id", "content_hash")
    made = todo.select("vector_id", external.embed(F.col("text")).alias("values"))
    return made.select("vector_id", F.size("values").alias("size"), (F.abs(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x) - 1) < 1e-4).alias("is_unit"))


_LIVE = f"(select *, row_number() over (partition by request_id order by case when isnan(score) then null else score end desc nulls last, result_id) as _r from {_RESULTS} r where exists (select 1 from chunks c where c.vector_id = r.document_id))"


@query(f"select a.request_id as question_id, coalesce(nullif(regexp_replace(split_part('[1] ' || coalesce(l.metadata.professor_name, '') || ' (' || coalesce(l.metadata.professor_title, '') || ') — ' || coalesce(l.metadata.section_type, ''), chr(10), 1), '\\s+$', ''), ''), '{NO_ANSWER.replace(chr(39), chr(39) * 2)}') as answer from (select distinct request_id from {_RESULTS}) a left join (select * from {_LIVE} where _r = 1) l on l.request_id = a.request_id where l.request_id is not null union all select request_id, '{NO_ANSWER.replace(chr(39), chr(39) * 2)}' from (select distinct request_id from {_RESULTS}) a where not exists (select 1 from {_LIVE} l where l.request_id = a.request_id)")
def rag_answers(spark: SparkSession, d: str) -> DataFrame:
    """Logged requests answered from their matches by the offline model, which gives the head of the first; requests without a match keep a row."""
    return retrieval.answers(*_asked(spark, d), external.complete).select("question_id", "answer")


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _results(spark, d)
    asked = r.groupBy(F.col("request_id").alias("question_id")).agg(F.min("query_vector_id").alias("text"))
    live = r.join(table(spark, d, "chunks").select(F.col("vector_id").alias("document_id")).distinct(), "document_id", "left_semi")
    return asked, retrieval.ranked(live, "request_id", "score", "result_id").select(F.col("request_id").alias("question_id"), "rank", "score", "metadata.*")


@query(f"select request_id as question_id, md5('Context:' || chr(10) || string_agg('[' || _r || '] ' || coalesce(metadata.professor_name, '') || ' (' || coalesce(metadata.professor_title, '') || ') — ' || coalesce(metadata.section_type, '') || chr(10) || coalesce(metadata.text, ''), chr(10) || chr(10) order by _r) || chr(10) || chr(10) || 'Question: ' || min(q) || chr(10)) as prompt_md5 from (select l.*, min(a.query_vector_id) over (partition by l.request_id) as q from {_LIVE} l join {_RESULTS} a on a.result_id = l.result_id) group by request_id")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The message to the generator for each request with matches."""
    asked, matches = _asked(spark, d)
    live = matches.groupBy("question_id").agg(F.count("*").alias("n"))
    ctx = retrieval.contexts(matches, "question_id")
    return asked.join(live, "question_id").join(ctx, "question_id").select("question_id", F.md5(retrieval.prompt(F.col("context"), F.col("text"))).alias("prompt_md5"))


@query(f"select result_id, printf('%.2f', score) as score_text from {_RESULTS} where score is not null and not isnan(score)")
def citation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of citations as they are shown."""
    r = _results(spark, d).where("score is not null and not isnan(score)").select("result_id", F.col("result_no").alias("rank"), "score", "metadata.*")
    return retrieval.citations(r, "result_id").select("result_id", "score_text")


@query("select date_trunc('hour', asked_at) as hour, client, count(*) as n_results from retrieval_results where asked_at is not null group by 1, 2")
def hourly_results(spark: SparkSession, d: str) -> DataFrame:
    """Logged matches by hour and client; the same plan runs as a stream with a watermark."""
    from quarrymill.streaming.landing import hourly_requests

    return hourly_requests(table(spark, d, "retrieval_results").where("asked_at is not null")).select("hour", "client", "n_results")
