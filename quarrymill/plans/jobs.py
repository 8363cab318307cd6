"""The jobs as plans over DataFrames: directory, sites, ingest, and questions answered."""

from __future__ import annotations

import argparse
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.config import SETTINGS, Settings
from quarrymill.functions.urls import slug_of
from quarrymill.operators import chunking, crawl, external, profile_html, retrieval, state
from quarrymill.runtime import stored
from quarrymill.sources import records

#: What the index holds: chunks of profiles and sites with their vectors.
CHUNK = (
    "vector_id string, text string, professor_slug string, professor_name string, professor_title string, url string, campuses array<string>, "
    "roles array<string>, areas_of_interest array<string>, section_type string, content_hash string, values array<float>"
)


def website_url(websites: Column) -> Column:
    """The first link that starts with http, as written."""
    return F.get(F.filter(F.transform(websites, lambda w: w["href"]), lambda h: h.startswith("http")), 0)


def directory_job(urls: DataFrame, known: DataFrame, fetch: Callable, limit: int | None = None) -> DataFrame:
    """Records of directory pages whose slug is not stored yet. A page that fails has its error, the rest go on."""
    u = urls.select("url", slug_of(F.col("url")).alias("slug"))
    u = u.orderBy("url").limit(limit) if limit is not None else u
    got = fetch(state.not_yet(u, known, "slug"), "url")
    return profile_html.parse_profiles(got, "html", "slug", "url", "reason").withColumn("error", F.coalesce("reason", "error")).drop("reason")


def sites_of(profiles: DataFrame, limit: int | None = None) -> DataFrame:
    """(slug, name, title, source_url): profiles with a web site. The limit counts profiles, with site or without."""
    p = profiles.orderBy("slug").limit(limit) if limit is not None else profiles
    return p.select("slug", "name", "title", website_url(F.col("websites")).alias("source_url")).where("source_url is not null")


def discover(spark: SparkSession, fetch: Callable, listing: str, pattern: str) -> DataFrame:
    """(url): the profile addresses of a paged listing in order: its first page tells how many there are, the others follow at page/N/."""
    start = listing.rstrip("/") + "/"
    first = stored(fetch(spark.createDataFrame([(start,)], "url string"), "url"), "listing")
    rest = first.select(F.explode(F.sequence(F.lit(1), crawl.last_page_number(F.col("html")))).alias("n")).where("n > 1").select(F.format_string(start.replace("%", "%%") + "page/%d/", "n").alias("url"))
    pages = first.unionByName(fetch(rest, "url"))
    return crawl.profile_urls(pages, "html", F.lit(start), pattern).orderBy("url")


def sites_job(sites: DataFrame, fetch: Callable, known: DataFrame, extract: Callable[[Column], Column] = external.extract, rules: DataFrame | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(site records to write, status report). Only new or changed sites reach ``extract``; an empty ``known`` forces all."""
    pages = stored(crawl.crawl(sites.select(F.col("slug").alias("site"), F.col("source_url").alias("start_url")), fetch, rules), "pages")
    texts = crawl.site_texts(pages.where("reason is null").withColumn("_t", crawl.main_text(F.col("html"))), "site", "url", "_t")
    failed = pages.where("hop = 0 and reason is not null").select(F.col("site").alias("slug"), "reason")
    joined = sites.join(texts.withColumnRenamed("site", "slug"), "slug", "left").join(failed, "slug", "left")
    status = stored(crawl.site_status(joined, known), "status")
    report = status.groupBy("status").count().orderBy(F.desc("count"), "status")
    todo = status.where(F.lit(not dry_run) & (F.col("status") == "to_write"))
    replies = todo.select("slug", F.col("name").alias("professor_name"), F.col("title").alias("professor_title"), "source_url", F.lit(SETTINGS.schema_version).alias("schema_version"), "page_hash", extract(F.col("text")).alias("reply"))
    return crawl.site_records(replies), report


def ingest_job(chunks: DataFrame, store: state.Snapshots, embed: Callable[[Column], Column] = external.embed, order: tuple[str, ...] = (), dimension: int | None = None) -> DataFrame:
    """Embed and merge what is new or changed; one row with the counts. A second run finds nothing to do.

    Of chunks of one key the last by ``order`` counts, which is ingested_at or loaded_at where there is such a
    column, ties by content hash. ``dimension``: what the index holds; other vectors end the job unmerged.
    """
    order = order or tuple(c for c in ("ingested_at", "loaded_at") if c in chunks.columns)
    marked = stored(state.with_status(state.last_wins(chunks, "vector_id", *order, "content_hash"), store.read(), "vector_id", "content_hash"), "marked")
    todo = marked.where("status <> 'unchanged'")
    counts = marked.agg(*(F.count_if(F.col("status") == n).alias(n) for n in ("new", "changed", "unchanged")))
    if not todo.isEmpty():
        made = todo.drop("status").withColumn("values", embed(F.col("text")))
        store.merge(state.check_dimension(made, "values", dimension) if dimension else made, "vector_id", "content_hash")
    return counts


def preview(chunks: DataFrame, rows: int = SETTINGS.preview_rows, chars: int = SETTINGS.preview_chars) -> DataFrame:
    """The first chunks by key, long texts cut: what a dry run shows."""
    return chunks.orderBy("vector_id").limit(rows).select("vector_id", F.when(F.length("text") > chars, F.concat(F.left("text", F.lit(chars)), F.lit("..."))).otherwise(F.col("text")).alias("text"))


def answer_job(questions: DataFrame, index: DataFrame, k: int = SETTINGS.top_k, embed: Callable[[Column], Column] = external.embed, generate: Callable[[Column], Column] = external.complete) -> tuple[DataFrame, DataFrame]:
    """(answers, citations) of questions (question_id, text): embed, search, context, generate, fall back."""
    asked = retrieval.askable(questions, "text")
    vectors = stored(asked.select("question_id", embed(F.col("text")).alias("vector")), "asked")
    matches = stored(retrieval.retrieve(vectors, index, k), "matches")
    return retrieval.answers(asked, matches, generate), retrieval.citations(matches, "question_id")


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrymill", description="Jobs over folders of records.")
    jobs = p.add_subparsers(dest="job", required=True)
    one = {n: jobs.add_parser(n, help=h) for n, h in (("directory", "profiles of a paged listing"), ("sites", "crawl and extract the web sites of profiles"), ("ingest", "chunk, embed and merge records"), ("serve", "answer questions over HTTP"))}
    for n in ("directory", "sites", "ingest"):
        one[n].add_argument("--profiles", required=True)
        one[n].add_argument("--limit", type=int)
        one[n].add_argument("--dry-run", action="store_true")
    for n in ("directory", "sites"):
        one[n].add_argument("--pages", default="", help="Parquet with url and html in place of the network")
    one["directory"].add_argument("--listing", default="")
    one["directory"].add_argument("--pattern", default="", help="regular expression of profile addresses; the listing's own address and one more part by default")
    one["directory"].add_argument("--urls", default="", help="where the list of addresses is kept")
    one["directory"].add_argument("--urls-only", action="store_true")
    one["directory"].add_argument("--refresh-urls", action="store_true")
    one["sites"].add_argument("--force", action="store_true", help="extract unchanged sites as well")
    for n in ("sites", "ingest"):
        one[n].add_argument("--sites", default="", required=n == "sites")
    for n in ("ingest", "serve"):
        one[n].add_argument("--index", required=True)
    one["serve"].add_argument("--port", type=int, default=8080)
    return p


def main(argv: list[str] | None = None) -> None:
    """``python -m quarrymill.plans.jobs directory|sites|ingest|serve ...``; --help tells the rest. Limits come from the environment."""
    a = _arguments().parse_args(argv)
    spark = SparkSession.builder.appName("quarrymill").getOrCreate()
    settings = Settings.from_env()
    if a.job in ("directory", "sites"):
        fetch = crawl.fetch_from(spark.read.parquet(a.pages)) if a.pages else external.http_fetch(agent=settings.agent, timeout=settings.timeout, delay=settings.delay)
    if a.job == "directory":
        pattern = a.pattern or re.escape(a.listing.rstrip("/")) + "/[a-z0-9-]+/"
        found = (lambda: discover(spark, fetch, a.listing, pattern)) if a.listing else (lambda: spark.read.parquet(a.pages).select("url"))
        urls = records.cached_urls(spark, a.urls, found, a.refresh_urls) if a.urls else found()
        if a.urls_only:
            print(urls.count())
            return
        out = stored(directory_job(urls, records.keys(spark, a.profiles), fetch, a.limit), "profiles")
        out.where("error is not null").select("url", "error").show(truncate=False)
        print(out.where("error is null").count() if a.dry_run else records.write_json(out.where("error is null").drop("error"), a.profiles, "slug"))
        return
    if a.job == "serve":
        from quarrymill.plans.service import Service, serve

        serve(Service(state.Snapshots(spark, a.index, CHUNK).read(), k=settings.top_k), a.port)
        return
    profiles = records.read_json(spark, a.profiles, records.PROFILE)
    profiles = profiles.orderBy("slug").limit(a.limit) if a.limit is not None else profiles
    if a.job == "sites":
        sites = stored(sites_of(profiles), "sites")
        old = records.page_hashes(records.read_json(spark, a.sites, records.SITE_RECORD))
        rules = None if a.pages else external.robots_rules(sites, "source_url", agent=settings.agent, timeout=settings.timeout, delay=settings.delay)
        out, report = sites_job(sites, fetch, old.limit(0) if a.force else old, lambda t: external.extract(t, pause=settings.extract_pause), rules, a.dry_run)
        report.show(truncate=False)
        if not a.dry_run:
            print(records.write_json(stored(out, "site_records"), a.sites, "slug"))
        return
    sites = records.read_json(spark, a.sites, records.SITE_RECORD) if a.sites else spark.createDataFrame([], records.SITE_RECORD)
    chunks = chunking.collect_chunks(profiles, sites)
    if a.dry_run:
        preview(chunks, settings.preview_rows, settings.preview_chars).show(truncate=False)
    else:
        ingest_job(chunks, state.Snapshots(spark, a.index, CHUNK), dimension=settings.dimension).show()


if __name__ == "__main__":
    main()
