"""Chunking and incremental state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import chunking, external, state
from quarrymill.plans import jobs
from quarrymill.sources import records

P = "slug string, name string, title string, url string, biography string, research_interests array<string>, education array<string>, areas_of_interest array<string>, labs_and_groups array<string>, projects array<string>, campuses array<string>, roles array<string>"


def profiles(spark):
    return spark.createDataFrame(
        [
            ("jane", "Jane", "Prof", "u", "Bio.", ["a", "b"], None, [], None, None, None, None),
            ("thin", "Thin", None, None, "", [], None, None, None, None, None, None),
            ("", "No slug", None, None, "x", None, None, None, None, None, None, None),
            ("anon", "", "", None, None, None, None, ["x"], None, None, ["C"], None),
        ],
        P,
    )


def sites(spark):
    rows = [("thin", "Thin", "", '[{"section_type":"website_summary","text":"S","source_url":"http://s"},{"section_type":"recent_news","text":["n1","n2"],"source_url":"http://s"},{"section_type":"current_projects","text":[],"source_url":"http://s"},{"section_type":"odd_kind","text":"","source_url":null}]'), ("ghost", None, None, '[{"section_type":"website_summary","text":"G","source_url":"g"}]'), (None, "x", None, "[]")]
    df = spark.createDataFrame(rows, "slug string, professor_name string, professor_title string, j string")
    return df.withColumn("sections", F.from_json("j", "array<struct<section_type:string,text:variant,source_url:string>>")).drop("j")


def test_profile_chunks(spark):
    got = {r["vector_id"]: r for r in chunking.profile_chunks(profiles(spark)).collect()}
    assert set(got) == {"jane#biography", "jane#research_interests", "anon#areas_of_interest"}
    assert got["jane#research_interests"]["text"] == "Jane (Prof)\nResearch interests:\n- a\n- b"
    assert got["anon#areas_of_interest"]["text"] == "anon\nAreas of interest:\n- x"
    assert got["anon#areas_of_interest"]["professor_name"] == "" and got["anon#areas_of_interest"]["campuses"] == ["C"] and got["jane#biography"]["campuses"] == []


def test_site_chunks_tell_strings_from_lists(spark):
    got = {r["vector_id"]: r for r in chunking.site_chunks(sites(spark)).collect()}
    assert got["thin#website_summary"]["text"] == "Thin\nWebsite summary:\nS"
    assert got["thin#recent_news"]["text"] == "Thin\nRecent news:\n- n1\n- n2"
    assert got["ghost#website_summary"]["professor_name"] == "ghost"
    assert len(got) == 3


def test_collect_keeps_sites_of_thin_profiles_only_if_loaded(spark):
    got = chunking.collect_chunks(profiles(spark), sites(spark))
    ids = {r["vector_id"] for r in got.collect()}
    assert "thin#website_summary" in ids and "ghost#website_summary" not in ids and "thin#biography" not in ids
    assert got.where("vector_id = 'thin#recent_news' and campuses is null").count() == 1


def test_status_pending_and_counts(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "id string, h string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", ""), ("z", "9")], "id string, h string")
    got = {r["id"]: r["status"] for r in state.with_status(new, old, "id", "h").collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "new", "d": "new"}
    assert {r["id"] for r in state.pending(new, old, "id", "h").collect()} == {"b", "c", "d"}
    assert state.with_status(new.limit(0), old, "id", "h").count() == 0


def test_last_wins_with_ties_nulls_and_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(2000)] + [("x", None, "old"), ("x", 1, "new"), (None, 5, "lost")]
    got = {r["k"]: r["v"] for r in state.last_wins(spark.createDataFrame(rows, "k string, o int, v string").repartition(5), "k", "o", "v").collect()}
    assert got == {"hot": "v1999", "x": "new"}


def test_merge_replaces_and_never_deletes(spark):
    a = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    b = spark.createDataFrame([("b", 2), ("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, state.merged(a, b, "k", "v").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_stored_hashes_ids_once(spark):
    st = spark.createDataFrame([(str(i), "h" if i % 2 else None) for i in range(10)], "k string, h string")
    ids = spark.createDataFrame([("1",), ("1",), ("2",), ("77",)], "k string")
    assert [tuple(r) for r in state.stored_hashes(st, ids, "k", "h").collect()] == [("1", "h")]


@pytest.mark.parametrize("n", [0, 1, 64, 150])
def test_batches(spark, n):
    df = spark.range(n).repartition(3)
    got = sorted((r["id"], r["batch"]) for r in state.batches(df, 64, "id").collect())
    assert got == [(i, i // 64) for i in range(n)]


def test_ingest_twice_does_nothing_the_second_time(spark, tmp_path):
    chunks = chunking.collect_chunks(profiles(spark), sites(spark))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", values array<float>"
    store = state.Snapshots(spark, f"file://{tmp_path}/index", schema)
    emb = lambda c: external.embed(c, lambda: external.HashEmbedder(16))
    first = jobs.ingest_job(chunks, store, emb).first()
    assert (first["new"], first["changed"], first["unchanged"]) == (5, 0, 0)
    second = jobs.ingest_job(chunks, store, emb).first()
    assert (second["new"], second["changed"], second["unchanged"]) == (0, 0, 5)
    changed = profiles(spark).withColumn("biography", F.when(F.col("slug") == "jane", "Other.").otherwise(F.col("biography")))
    third = jobs.ingest_job(chunking.collect_chunks(changed, sites(spark)), store, emb).first()
    assert (third["new"], third["changed"], third["unchanged"]) == (0, 1, 4)
    assert store.read().count() == 5 and store.read().where("size(values) = 16").count() == 5


def test_the_last_record_of_a_key_is_ingested(spark, tmp_path):
    rows = [("a#x", "old", "h9", 1), ("a#x", "new", "h1", 2), ("b#x", "one", "h2", 1)]
    chunks = spark.createDataFrame(rows, "vector_id string, text string, content_hash string, ingested_at int")
    store = state.Snapshots(spark, f"file://{tmp_path}/index", "vector_id string, text string, content_hash string, ingested_at int, values array<float>", 4)
    emb = lambda c: external.embed(c, lambda: external.HashEmbedder(8))
    jobs.ingest_job(chunks, store, emb, dimension=8)
    assert {r["vector_id"]: r["text"] for r in store.read().collect()} == {"a#x": "new", "b#x": "one"}
    with pytest.raises(Exception, match="9 entries"):
        jobs.ingest_job(chunks.withColumn("content_hash", F.lit("z")), store, emb, dimension=9)
    assert {r["content_hash"] for r in store.read().collect()} == {"h1", "h2"}


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    store = state.Snapshots(spark, f"file://{tmp_path}/index", "k string, v int", 8)
    store.merge(spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int"), "k")
    before = store._current()
    store.merge(spark.createDataFrame([("k5", -5)], "k string, v int"), "k")
    after = store._current()
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert {r["k"]: r["v"] for r in store.read().collect()} == {f"k{i}": i if i != 5 else -5 for i in range(100)}
    store.merge(store.read().limit(0), "k")
    assert store.vacuum() == 1 and store.vacuum() == 0 and store.read().count() == 100


def test_dimension_is_checked(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert state.check_dimension(df, "v", 2).count() == 2
    with pytest.raises(Exception, match="3 entries"):
        state.check_dimension(df, "v", 3).collect()


def test_json_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "é", [1, 2]), ("b-c", None, [])], "slug string, name string, n array<int>")
    assert records.write_json(df, str(tmp_path / "profiles"), "slug") == 2
    back = records.read_json(spark, str(tmp_path / "profiles"), "slug string, name string, n array<int>")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert {r["slug"] for r in records.keys(spark, str(tmp_path / "profiles")).collect()} == {"a", "b-c"}
    assert records.read_text(spark, str(tmp_path / "none")) is None and records.keys(spark, str(tmp_path / "none")).count() == 0
    records.write_text(spark, str(tmp_path / "t" / "x.txt"), "héllo\nx")
    assert records.read_text(spark, str(tmp_path / "t" / "x.txt")) == "héllo\nx"


def test_page_hashes_last_record_wins(spark):
    df = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 2), ("b", "", 1), ("", "h", 1)], "slug string, page_hash string, loaded_at int")
    assert [tuple(r) for r in records.page_hashes(df).collect()] == [("a", "h2")]


def test_cached_urls(spark, tmp_path):
    calls = []

    def discover():
        calls.append(1)
        return spark.createDataFrame([("b",), ("a",), ("a",)], "url string")

    at = str(tmp_path / "urls")
    for refresh in (False, False, True):
        assert sorted(r["url"] for r in records.cached_urls(spark, at, discover, refresh).collect()) == ["a", "b"]
    assert len(calls) == 2


def test_hash_embedder_is_deterministic_and_batched(spark):
    df = spark.createDataFrame([("robot vision",), ("robot vision",), (None,), ("",)], "t string")
    got = [r["v"] for r in df.select(external.embed(F.col("t"), lambda: external.HashEmbedder(8), batch=1).alias("v")).collect()]
    assert got[0] == got[1] and abs(np.linalg.norm(got[0]) - 1) < 1e-6 and got[2] is None and got[3] == [0.0] * 8


def test_retries_only_when_throttled():
    slept, n = [], []

    def call():
        n.append(1)
        if len(n) < 4:
            raise external.Throttled
        return 7

    assert external.with_retries(call, sleep=slept.append) == 7 and slept == [2, 4, 8]
    assert external.delays() == [2, 4, 8, 16, 32]
    with pytest.raises(ValueError):
        external.with_retries(lambda: (_ for _ in ()).throw(ValueError()), sleep=slept.append)
