"""Link discovery and shallow site expansion over tables of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.config import LINK_WORDS, SETTINGS
from quarrymill.functions.text import page_hash, strip
from quarrymill.functions.urls import netloc, normal, resolve, scheme
from quarrymill.runtime import stored

ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
# Entities that matter in running text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def anchors(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """(keep, pos, href, label): the links of each page in document order. Null html has none."""
    links = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), 2).alias("label"))
    return pages.select(*keep, F.posexplode(links).alias("pos", "_l")).select(*keep, "pos", F.col("_l.href").alias("href"), strip(F.regexp_replace(F.regexp_replace("_l.label", r"(?s)<[^>]*>", " "), r"(?U)\s+", " ")).alias("label"))


def one_hop_links(pages: DataFrame, html: str, base: str, *keep: str, words: tuple[str, ...] = LINK_WORDS) -> DataFrame:
    """(keep, pos, href): links to the same host whose address or label has one of ``words``.

    Links are resolved against ``base`` without its slashes at the end, lose fragment and slashes, and count
    once, at their first place with a hit. Hosts are compared as written, ports included.
    """
    found = anchors(pages.withColumn("_base", F.regexp_replace(base, "/+$", "")), html, *keep, "_base")
    full = found.withColumn("_h", normal(resolve(F.col("_base"), F.col("href"))))
    hay = F.lower(F.concat("_h", F.lit(" "), "label"))
    hit = full.where(scheme(F.col("_h")).isin("http", "https") & (netloc(F.col("_h")) == netloc(F.col("_base"))) & hay.rlike("|".join(words)))
    return hit.groupBy(*keep, F.col("_h").alias("_href")).agg(F.min("pos").alias("pos")).select(*keep, "pos", F.col("_href").alias("href"))


def failure(status: Column, content_type: Column, error: Column) -> Column:
    """Why a fetch failed, null if it did not: time-out, broken connection, error status, not html, in that order."""
    return (
        F.when(error == "timeout", "timeout")
        .when(error.isNotNull(), F.concat(F.lit("conn_error:"), error))
        .when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))
        .when(~F.coalesce(F.lower(content_type), F.lit("")).contains("html"), "non_html")
    )


def decoded(body: Column, content_type: Column, detected: Column) -> Column:
    """Bytes as text: by the declared charset, else by the detected one, else UTF-8; unknown names count as UTF-8."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import codecs
        import re

        def one(raw, kind, guess):
            if raw is None:
                return None
            m = re.search(r"charset\s*=\s*[\"']?([\w.\-]+)", kind or "", re.I)
            name = m.group(1) if m else guess or "utf-8"
            try:
                codecs.lookup(name)
            except LookupError:
                name = "utf-8"
            return bytes(raw).decode(name, "replace")

        for b, k, g in parts:
            yield pd.Series([one(*x) for x in zip(b, k, g)], dtype=object)

    return run(body, content_type, detected)


def allowed(sites: DataFrame, rules: DataFrame, url: str, agent: str) -> DataFrame:
    """``sites`` with ``allowed``: whether robots.txt lets ``agent`` fetch ``url``.

    ``rules`` has scheme, host, status, body. Any status but 200, a missing file and an unreadable one allow all.
    """

    @F.pandas_udf("boolean")
    def can(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from functools import lru_cache
        from urllib.robotparser import RobotFileParser

        @lru_cache(maxsize=1024)
        def parsed(body: str) -> RobotFileParser:
            p = RobotFileParser()
            p.parse(body.splitlines())
            return p

        for urls, bodies in parts:
            yield pd.Series([True if b is None else parsed(b).can_fetch(agent, u) for u, b in zip(urls, bodies)])

    r = rules.where("status = 200").select(F.lower("scheme").alias("_sc"), F.col("host").alias("_ho"), F.col("body").alias("_body"))
    joined = sites.withColumn("_sc", scheme(F.col(url))).withColumn("_ho", netloc(F.col(url))).join(r, ["_sc", "_ho"], "left")
    return joined.withColumn("allowed", can(F.col(url), F.col("_body"))).drop("_sc", "_ho", "_body")


def crawl(sites: DataFrame, fetch: Callable[[DataFrame, str], DataFrame], rules: DataFrame | None = None, agent: str = "quarrymill", most_pages: int = SETTINGS.pages_per_site, words: tuple[str, ...] = LINK_WORDS) -> DataFrame:
    """(site, url, html, reason, hop): the home page of each site and up to ``most_pages`` - 1 further pages.

    ``sites`` has site and start_url; ``fetch(df, column)`` adds html and reason. A home page that is not
    allowed or fails ends its site with that reason; other pages that fail are skipped and don't count. Every
    page is fetched once, links in the order of the home page, and none after the last page that is wanted.
    """
    home = sites.select("site", F.regexp_replace("start_url", "/+$", "").alias("url"))
    home = allowed(home, rules, "url", agent) if rules is not None else home.withColumn("allowed", F.lit(True))
    barred = home.where(~F.col("allowed")).select("site", "url", F.lit(None).cast("string").alias("html"), F.lit("robots_disallowed").alias("reason"), F.lit(0).alias("hop"))
    first = stored(fetch(home.where("allowed").select("site", "url"), "url").select("site", "url", "html", "reason", F.lit(0).alias("hop")), "home_pages")
    links = one_hop_links(first.where("reason is null"), "html", "url", "site", words=words).join(first.select("site", F.col("url").alias("href")), ["site", "href"], "left_anti").select("site", "pos", F.col("href").alias("url"))
    links = allowed(links, rules, "url", agent).where("allowed").drop("allowed") if rules is not None else links
    links = stored(links.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy("pos", "url"))), "links")
    # as many links at a time as pages are still wanted: none is fetched that could turn out to be one too many
    left = first.where("reason is null").select("site", F.lit(most_pages - 1).alias("want"), F.lit(0).alias("tried"))
    more = []
    while True:
        wave = links.join(left, "site").where((F.col("n") > F.col("tried")) & (F.col("n") <= F.col("tried") + F.col("want"))).select("site", "url", "n")
        got = stored(fetch(wave, "url").select("site", "url", "html", "reason", "n"), "wave")
        more.append(got.where("reason is null"))
        told = got.groupBy("site").agg(F.max("n").alias("last"), F.count_if(F.col("reason").isNull()).alias("good"))
        left = stored(left.join(told, "site").select("site", (F.col("want") - F.col("good")).alias("want"), F.col("last").alias("tried")).where("want > 0"), "left")
        if left.isEmpty():
            break
    hops = reduce(DataFrame.unionByName, more).withColumn("hop", F.row_number().over(W.partitionBy("site").orderBy("n")))
    return barred.unionByName(first).unionByName(hops.select("site", "url", "html", "reason", "hop"))


def fetch_from(pages: DataFrame, url: str = "url", html: str = "html", reason: str | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A fetcher over a table of pages: what is not there is http_404. Stands in for the network."""
    table = pages.select(F.col(url).alias("_u"), F.col(html).alias("html"), (F.col(reason) if reason else F.lit(None).cast("string")).alias("_r")).dropDuplicates(["_u"])

    def fetch(df: DataFrame, column: str) -> DataFrame:
        got = df.join(table, df[column] == F.col("_u"), "left")
        return got.withColumn("reason", F.when(F.col("_u").isNull(), "http_404").otherwise(F.col("_r"))).drop("_u", "_r")

    return fetch


def last_page_number(html: Column) -> Column:
    """The largest N of links of class page-numbers to ``/page/N/``; 1 without any."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>"), 0), lambda t: t.rlike(r"(?i)class\s*=\s*[\"'][^\"']*\bpage-numbers\b"))
    n = F.transform(F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"/page/(\d+)/?", 1)), lambda x: x != ""), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(n), F.lit(1))


def profile_urls(pages: DataFrame, html: str, base: Column, pattern: str) -> DataFrame:
    """(url): the distinct links of the pages, made absolute, that match ``pattern`` whole."""
    found = anchors(pages.withColumn("_base", base), html, "_base")
    return found.select(resolve(F.col("_base"), F.col("href")).alias("url")).where(F.col("url").rlike(f"^(?:{pattern})$")).distinct()


def main_text(html: Column) -> Column:
    """Text of a page by rules: head, scripts, styles, navigation, footers and comments go, block tags end lines."""
    t = html
    for tag in ("head", "script", "style", "noscript", "nav", "footer"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/td|/table|/ul|/section|/article)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return strip(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


def site_texts(pages: DataFrame, site: str, url: str, text: str, most: int = SETTINGS.most_text) -> DataFrame:
    """(site, text): ``[url]`` and text of a site's pages by URL, an empty line between, cut at ``most`` characters.

    Blank pages are left out; a site without text has no row. Sites have few pages, so the list is small.
    """
    rows = pages.where(F.length(strip(F.col(text))) > 0).groupBy(site).agg(F.array_sort(F.collect_list(F.struct(F.col(url).alias("u"), strip(F.col(text)).alias("t")))).alias("_p"))
    return rows.select(site, F.left(F.array_join(F.transform("_p", lambda p: F.concat(F.lit("["), F.coalesce(p["u"], F.lit("")), F.lit("]\n"), p["t"])), "\n\n"), F.lit(most)).alias("text"))


def enough_text(text: Column, least: int = SETTINGS.least_text) -> Column:
    """Whether a page was worth reading; white space at the ends does not count."""
    return F.coalesce(F.length(strip(text)) >= least, F.lit(False))


def site_status(sites: DataFrame, known: DataFrame, site: str = "slug", text: str = "text", reason: str = "reason", version: str = SETTINGS.schema_version) -> DataFrame:
    """``sites`` with page_hash and status: the failure, too_short, unchanged or to_write. ``known`` has the site and page_hash."""
    old = known.where("page_hash <> ''").select(F.col(site).alias("_s"), F.col("page_hash").alias("_h"))
    rows = sites.withColumn("page_hash", page_hash(F.col(text), version)).join(old, F.col(site) == F.col("_s"), "left")
    status = F.when(F.col(reason).isNotNull(), F.col(reason)).when(~enough_text(F.col(text)), "too_short").when(F.col("page_hash").eqNullSafe(F.col("_h")), "unchanged").otherwise("to_write")
    return rows.withColumn("status", status).drop("_s", "_h")


def site_records(extracted: DataFrame) -> DataFrame:
    """Records of sites from extracted JSON: sections in fixed order, blank ones left out, each with its source_url.

    ``extracted`` has slug, professor_name, professor_title, source_url, page_hash, schema_version, reply. A
    reply that is no JSON object gives a record without sections.
    """
    from quarrymill.config import SITE_SECTIONS

    schema = "website_summary string, " + ", ".join(f"{k} array<string>" for k in SITE_SECTIONS if k != "website_summary")
    r = F.from_json("reply", schema)
    sections = F.array(
        *(
            F.struct(F.lit(k).alias("section_type"), F.when(F.length(r[k]) > 0 if k == "website_summary" else F.size(r[k]) > 0, F.to_variant_object(r[k]) if k != "website_summary" else F.parse_json(F.to_json(F.array(r[k])))).alias("text"), F.col("source_url"))
            for k in SITE_SECTIONS
        )
    )
    one = F.expr("transform(filter(_x, s -> s.text is not null), s -> named_struct('section_type', s.section_type, 'text', case when s.section_type = 'website_summary' then variant_get(s.text, '$[0]', 'variant') else s.text end, 'source_url', s.source_url))")
    return extracted.withColumn("_x", sections).withColumn("sections", one).drop("_x", "reply")


