"""Queries of the ten problems over the tables of a folder; names are pN_..."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import near_duplicates as nd
from quarrymill.llm import encodings, names, packing, page_text, reading_level, similar_vectors, splitting, tokens
from quarrymill.runtime import table


def _people(spark: SparkSession, d: str) -> DataFrame:
    return names.same_persons(table(spark, d, "profiles"), "profile_id", "name", "contact", "websites", ["areas_of_interest", "education", "campuses"])


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row of profiles with a name, the person it belongs to and how many other rows that person has."""
    people = _people(spark, d).select(F.col("key").alias("profile_id"), "person")
    return people.join(people.groupBy("person").agg((F.count("*") - 1).alias("n_links")).hint("merge"), "person").select("profile_id", "person", "n_links")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one person, and the labs a row names under any spelling."""
    profiles = table(spark, d, "profiles")
    person = names.pairs_of(_people(spark, d), "key", "person").select(F.lit("person").alias("kind"), F.col("a").alias("left_id"), F.col("b").alias("right_id"))
    named = profiles.select("profile_id", F.explode("labs_and_groups").alias("spelling"))
    labs = names.attribute_groups(named, table(spark, d, "labs"), "spelling", "lab_id", "lab_name", "acronym")
    lab = named.join(labs.hint("merge"), "spelling").select(F.lit("lab").alias("kind"), F.col("profile_id").alias("left_id"), F.col("lab_id").alias("right_id")).distinct()
    return person.unionByName(lab)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of cosine 0.8 or more, one among the 10 most similar of the other."""
    return similar_vectors.similar_pairs(table(spark, d, "chunk_vectors"), "vector_id", "vec").select(F.col("a").alias("vector_id_a"), F.col("b").alias("vector_id_b"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of at least 50 words whose sets of 3-word runs reach a Jaccard similarity of 0.5."""
    member, links = nd.near_duplicates(table(spark, d, "chunks"), "chunk_id", "text", size=3, threshold=0.5, least_words=50)
    return nd.duplicate_pairs(member, links).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk of at least 50 words with the group of reworked copies it belongs to."""
    member, links = nd.near_duplicates(table(spark, d, "chunks"), "chunk_id", "text", size=3, threshold=0.5, least_words=50)
    return nd.duplicate_groups(member, links).select(F.col("key").alias("chunk_id"), F.col("group").alias("group_id"), "n_links")


def page_rows(crawls: DataFrame) -> DataFrame:
    """One row per page: crawl_id, page_no from 0, url, html."""
    return crawls.select("crawl_id", F.posexplode("pages").alias("page_no", "p")).select("crawl_id", "page_no", F.col("p.url").alias("url"), F.col("p.html").alias("html"))


def _read_pages(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    crawls = table(spark, d, "crawl_results")
    odd = page_text.not_codes(crawls, [], "reason")
    return page_text.read_pages(page_rows(crawls), ["crawl_id", "page_no"], "url", "html", odd)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages without content of their own, and reasons that are no failure code but such text (page_no -1)."""
    read, tables = _read_pages(spark, d)
    reasons = page_text.residue_texts(table(spark, d, "crawl_results"), ["crawl_id"], "reason", tables).select("crawl_id", F.lit(-1).alias("page_no"))
    return read.where("residue").select("crawl_id", "page_no").unionByName(reasons)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the main body of every page that has one."""
    read, _ = _read_pages(spark, d)
    return read.where(~F.col("residue")).select("crawl_id", "page_no", F.explode("main").alias("line_no"))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    page = page_rows(table(spark, d, "crawl_results")).select(F.lit("page").alias("kind"), F.col("crawl_id").alias("row_id"), "page_no", F.col("html").alias("text"))
    bio = table(spark, d, "profiles").select(F.lit("biography").alias("kind"), F.col("profile_id").alias("row_id"), F.lit(-1).alias("page_no"), F.col("biography").alias("text"))
    return page.unionByName(bio)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages and biographies with wrongly decoded text, restorable or not."""
    return encodings.garbled(_encoded(spark, d), ["kind", "row_id", "page_no"], "text").select("kind", "row_id", "page_no")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same with the restored text, null where characters are lost."""
    return encodings.garbled(_encoded(spark, d), ["kind", "row_id", "page_no"], "text", with_text=True)


def p5_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sound pages and biographies garbled on purpose: whether that is found and undone to the letter."""
    return encodings.round_trip(_encoded(spark, d), ["kind", "row_id", "page_no"], "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut by the splitter: biographies and chunks of more than 1,500 characters."""
    bio = splitting.oversized(table(spark, d, "profiles"), ["profile_id"], "biography").select(F.lit("biography").alias("kind"), F.col("profile_id").alias("item_id"))
    chunk = splitting.oversized(table(spark, d, "chunks"), ["chunk_id"], "text").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item_id"))
    return bio.unionByName(chunk)


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves, short texts as one piece."""
    bio = splitting.split_texts(table(spark, d, "profiles").withColumnRenamed("profile_id", "item_id"), ["item_id"], "biography").withColumn("kind", F.lit("biography"))
    chunk = splitting.split_texts(table(spark, d, "chunks").withColumnRenamed("chunk_id", "item_id"), ["item_id"], "text").withColumn("kind", F.lit("chunk"))
    return bio.unionByName(chunk)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokens.encode_column(table(spark, d, "documents"), ["doc_id"], "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    sizes = p8_ids(spark, d).select("doc_id", F.size("ids").alias("n_tokens"))
    return packing.pack(sizes, "doc_id", "n_tokens")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading band of English documents of at least 60 words."""
    return reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "band_labels")).select("doc_id", "band")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are held against brute force in the tests."""
    return {
        "p3_found": r"""
            with w as (select chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from chunks where text is not null),
            g as (select distinct chunk_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as gram from w where len(ws) >= 50),
            n as (select chunk_id, count(*) as n from g group by chunk_id),
            o as (select a.chunk_id as chunk_id_a, b.chunk_id as chunk_id_b, count(*) as common from g a join g b on a.gram = b.gram and a.chunk_id < b.chunk_id group by all)
            select chunk_id_a, chunk_id_b from o join n x on x.chunk_id = chunk_id_a join n y on y.chunk_id = chunk_id_b where common >= 0.5 * (x.n + y.n - common)""",
        "p7_found": "select 'biography' as kind, profile_id as item_id from profiles where length(biography) > 1500 union all select 'chunk', chunk_id from chunks where length(text) > 1500",
    }
