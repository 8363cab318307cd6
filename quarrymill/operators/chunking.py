"""Records cut into keyed chunks, one per filled section. All built-ins; no Python.

A record with a null or blank slug has no chunks; a null, empty or blank section has none. Chunk keys are
``slug#section``; sections of profiles and of sites never share a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.config import PROFILE_SECTIONS, SITE_SECTIONS
from quarrymill.functions.text import bullet_list, content_hash, header, is_blank, is_empty, label_of, or_else

METADATA = ("professor_slug", "professor_name", "professor_title", "url")


def substantive(profiles: DataFrame) -> DataFrame:
    """Profiles with a biography, research interests or areas of interest."""
    return profiles.where(~is_blank(F.col("biography")) | ~is_empty(F.col("research_interests")) | ~is_empty(F.col("areas_of_interest")))


def _rendered(name: Column, title: Column, label: Column, body: Column) -> Column:
    return F.concat(header(name, title), F.lit("\n"), label, F.lit(":\n"), body)


def profile_chunks(profiles: DataFrame, sections: dict[str, str] = PROFILE_SECTIONS) -> DataFrame:
    """Chunks of profiles with the metadata of the record; null arrays become empty ones."""
    kinds = dict(profiles.dtypes)
    none = F.array().cast("array<string>")
    parts = [
        F.struct(F.lit(k).alias("section_type"), F.lit(label).alias("label"), (F.when(~is_empty(F.col(k)), bullet_list(F.col(k))) if kinds[k].startswith("array") else F.when(~is_blank(F.col(k)), F.col(k))).alias("body"))
        for k, label in sections.items()
    ]
    shown = or_else(F.col("name"), F.col("slug"), F.lit("Unknown"))
    title = F.coalesce(F.col("title"), F.lit(""))
    rows = profiles.where(~is_blank(F.col("slug"))).withColumn("_s", F.explode(F.filter(F.array(*parts), lambda s: s["body"].isNotNull())))
    text = _rendered(shown, title, F.col("_s.label"), F.col("_s.body"))
    return rows.select(
        F.concat_ws("#", "slug", "_s.section_type").alias("vector_id"),
        text.alias("text"),
        F.col("slug").alias("professor_slug"),
        F.coalesce("name", F.lit("")).alias("professor_name"),
        title.alias("professor_title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("campuses", none).alias("campuses"),
        F.coalesce("roles", none).alias("roles"),
        F.coalesce("areas_of_interest", none).alias("areas_of_interest"),
        F.col("_s.section_type").alias("section_type"),
        content_hash(text).alias("content_hash"),
    )


def site_chunks(records: DataFrame, labels: dict[str, str] = SITE_SECTIONS) -> DataFrame:
    """Chunks of site records: slug, professor_name, professor_title, sections array<struct<section_type, text variant, source_url>>.

    The text of a section is a string or a list of strings; both are told apart by the variant's own schema,
    as casting would turn a list into its JSON text. Campuses, roles and areas are not known here.
    """
    s = F.col("_s")
    is_list = F.schema_of_variant(s["text"]).startswith("ARRAY")
    items = F.expr("try_variant_get(_s.text, '$', 'array<string>')")
    scalar = F.expr("try_variant_get(_s.text, '$', 'string')")
    body = F.when(is_list & ~is_empty(items), bullet_list(items)).when(~is_list & ~is_blank(scalar), scalar)
    shown = or_else(F.col("professor_name"), F.col("slug"))
    title = F.coalesce(F.col("professor_title"), F.lit(""))
    rows = records.where(~is_blank(F.col("slug"))).withColumn("_s", F.explode("sections")).withColumn("_body", body).where(F.col("_body").isNotNull() & ~is_blank(s["section_type"]))
    text = _rendered(shown, title, label_of(s["section_type"], labels), F.col("_body"))
    return rows.select(
        F.concat_ws("#", "slug", s["section_type"]).alias("vector_id"),
        text.alias("text"),
        F.col("slug").alias("professor_slug"),
        shown.alias("professor_name"),
        title.alias("professor_title"),
        F.coalesce(s["source_url"], F.lit("")).alias("url"),
        s["section_type"].alias("section_type"),
        content_hash(text).alias("content_hash"),
    )


def collect_chunks(profiles: DataFrame, records: DataFrame) -> DataFrame:
    """Chunks of substantive profiles, and of the sites of every profile that was loaded, substantive or not."""
    known = profiles.select("slug").distinct()
    return profile_chunks(substantive(profiles)).unionByName(site_chunks(records.join(known, "slug", "left_semi")), allowMissingColumns=True)
