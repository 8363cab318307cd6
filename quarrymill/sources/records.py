"""Reading and writing records: folders of JSON documents, texts and key listings on any Hadoop file system."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINKS = "array<struct<text:string,href:string>>"
PROFILE = (
    "slug string, url string, name string, pronouns string, title string, photo_url string, roles array<string>, campuses array<string>, "
    f"websites {LINKS}, google_scholar string, areas_of_interest array<string>, contact array<string>, research_interests array<string>, "
    "education array<string>, biography string, labs_and_groups array<string>, projects array<string>, raw_aside variant"
)
#: The text of a section is a string or a list of strings: a variant, as any other type would lose one of them.
SITE_RECORD = "slug string, professor_name string, professor_title string, source_url string, schema_version string, page_hash string, sections array<struct<section_type:string,text:variant,source_url:string>>"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All ``*.json`` documents of a folder, one per file; an absent folder is empty. The schema is given, never guessed."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text object, None if absent."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def keys(spark: SparkSession, folder: str) -> DataFrame:
    """(slug): names of the JSON documents of a folder; the files are listed, not read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "slug string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    # the path is percent-encoded
    return files.select(F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)\.json$", 1), F.lit("+"), F.lit("%2B"))).alias("slug")).distinct()


def page_hashes(records: DataFrame, *order: str) -> DataFrame:
    """(slug, page_hash) where both are there; of several records of a slug the last by ``order`` counts, ties by hash.

    Without ``order`` that is loaded_at, if there is such a column; files in a folder have one record a slug.
    """
    order = order or (("loaded_at",) if "loaded_at" in records.columns else ())
    ok = records.where((F.col("slug") != "") & (F.col("page_hash") != ""))
    return ok.groupBy("slug").agg(F.max_by("page_hash", F.struct(*order, "page_hash")).alias("page_hash"))


def write_json(df: DataFrame, folder: str, key: str) -> int:
    """One pretty JSON document per row at ``folder/key.json``, an old one replaced; the number written.

    Rows are written by the tasks through the file system of the folder's URI; keys must be unique. Meant for
    hand-over to other programs; state between jobs belongs into Parquet. On a cluster the folder must be one
    that all executors share.
    """
    cols = [c for c in df.columns if c != key]
    body = F.to_json(F.struct(F.col(key), *cols), {"ignoreNullFields": "false"})
    rows = df.select(F.col(key).alias("k"), body.alias("j"))
    target = folder.rstrip("/") if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = FileSystem.from_uri(target)
        fs.create_dir(root, recursive=True)
        for pdf in batches:
            for k, j in zip(pdf["k"], pdf["j"]):
                # written aside and moved, so that a task that fails leaves no half document
                part = f"{root}/.{k}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(json.dumps(json.loads(j), ensure_ascii=False, indent=2).encode("utf-8"))
                fs.move(part, f"{root}/{k}.json")
            yield pd.DataFrame({"n": [len(pdf)]})

    return int(rows.mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small text object, replaced if there, parents made."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content.encode("utf-8")))
    out.close()


def cached_urls(spark: SparkSession, path: str, discover, refresh: bool = False) -> DataFrame:
    """(url): the stored list if there is one and no refresh is asked for, else what ``discover()`` gives, stored."""
    if not refresh and exists(spark, path):
        return spark.read.schema("url string").parquet(path)
    discover().select("url").distinct().orderBy("url").write.mode("overwrite").parquet(path)
    return spark.read.schema("url string").parquet(path)
