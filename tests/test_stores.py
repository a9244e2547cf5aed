"""Round trips, merges, listings, nested JSON and incremental runs."""

import pytest
import hashlib
import json
import math

from pyspark.sql import functions as F

from vector_atlas.operators import frames, joins
from vector_atlas.sources import catalogue, files, stores, tables, versions
from vector_atlas.streaming.incremental import run_incremental


def test_csv_round_trip_with_quotes(spark, tmp_path):
    from vector_atlas.schemas import METADATA_COLUMNS

    values = ['7', 'Q1', 'He said "hi", twice', 'line\nbreak', '1.5'] + [None] * 9
    names = list(METADATA_COLUMNS)
    rows = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    shuffled = rows.select(*reversed(names), F.lit("x").alias("Extra"))
    shuffled.write.csv(str(tmp_path / "m"), header=True, escape='"', quote='"')
    assert list(tables.scan_metadata(spark, str(tmp_path / "m"), multi_line=True).first()) == values


def test_metrics_replace_only_their_section(spark, tmp_path):
    path = str(tmp_path / "metrics")
    schema = "model string, section string, metric string, value double"
    stores.write_metrics(spark, spark.createDataFrame([("m", "a", "x", 1.0), ("m", "b", "y", 2.0)], schema), path)
    stores.write_metrics(spark, spark.createDataFrame([("m", "a", "z", math.nan), ("n", "a", "x", math.inf)], schema), path)
    got = sorted((tuple(r) for r in stores.read_metrics(spark, path).collect()), key=str)
    assert got == sorted([("m", "b", "y", 2.0), ("m", "a", "z", None), ("n", "a", "x", None)], key=str)
    doc = {r.model: json.loads(r.document) for r in stores.metrics_document(stores.read_metrics(spark, path)).collect()}
    assert doc["m"] == {"a": {"z": None}, "b": {"y": 2.0}}


def test_listing_and_checksums(spark, tmp_path):
    for quadrant, song, body in (("Q1", "a1", b"one"), ("Q2", "b2", b"two")):
        (tmp_path / quadrant).mkdir(exist_ok=True)
        (tmp_path / quadrant / f"{song}.mp3").write_bytes(body)
    (tmp_path / "Q1" / "note.txt").write_bytes(b"x")
    got = sorted((r.quadrant, r.song_id, r.length) for r in files.audio_listing(spark, str(tmp_path)).collect())
    assert got == [("Q1", "a1", 3), ("Q2", "b2", 3)]
    good = " MD5:" + hashlib.md5(b"one").hexdigest().upper() + " "
    expected = spark.createDataFrame([("a1.mp3", good), ("b2.mp3", "00"), ("c.mp3", "00")], "name string, checksum string")
    status = {r.name: r.status for r in files.checksum_audit(spark, str(tmp_path), expected).collect()}
    assert status == {"a1.mp3": "ok", "b2.mp3": "mismatch", "c.mp3": "missing"}


def test_catalogue_entries(spark):
    items = [
        {"track": {"id": "1", "name": "n", "artists": [{"name": "A"}, {"name": "B"}], "external_ids": {"isrc": "X"}}},
        {"track": {"id": "2", "name": "n", "artists": ["plain"], "isrc": None, "external_ids": {"isrc": "X"}, "type": "track"}},
        {"track": {"id": "3", "type": "episode"}},
        {"track": {"id": ""}},
        {"track": None},
        {"track": "text"},
        {"other": 1},
        {"track": {"id": "4", "name": "n", "album": {"images": [{"url": "u0"}, {"url": "u1"}]}, "external_urls": {"spotify": "L"}}},
    ]
    rows = spark.createDataFrame([(1, json.dumps({"items": items})), (2, json.dumps(items))], "u int, items_json string")
    got = catalogue.explode_catalogue_items(rows).where("u = 1").orderBy("position").collect()
    assert [(r.id, r.artists, r.isrc, r.link, r.cover_url) for r in got] == [
        ("1", ["A", "B"], "X", None, None), ("2", ["plain"], None, None, None), ("4", [], None, "L", "u0"),
    ]
    assert catalogue.explode_catalogue_items(rows).where("u = 2").count() == 3
    flat = spark.createDataFrame([(json.dumps([{"id": "9", "name": "z"}, 5]),)], "items_json string")
    assert [r.id for r in catalogue.explode_catalogue_items(flat, nested=False).collect()] == ["9"]


def test_feature_job_resumes(spark):
    def feature(content):
        if content < 0:
            raise ValueError("negative")
        return {"v": content * 2.0}

    first = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "song_id string, content double")
    table, failures = frames.feature_job(first, feature, ["v"])
    assert [tuple(r) for r in table.collect()] == [("a", 2.0)] and failures.first().error == "negative"
    more = spark.createDataFrame([("a", 50.0), ("c", 3.0)], "song_id string, content double")
    table, _ = frames.feature_job(more, feature, ["v"], existing=table)
    assert sorted(tuple(r) for r in table.collect()) == [("a", 2.0), ("c", 6.0)]
    table, _ = frames.feature_job(more, feature, ["v"], existing=table, force=True)
    assert sorted(tuple(r) for r in table.collect()) == [("a", 100.0), ("c", 6.0)]


def test_incremental_runs_merge_new_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "song_id string, v double"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run_incremental(stream, lambda df: df.withColumn("v", F.col("v") * 10), target, str(tmp_path / "cp")).awaitTermination()
        return sorted(tuple(r) for r in versions.read_table(spark, target).collect())

    assert arrive([("a", 1.0)]) == [("a", 10.0)]
    assert arrive([("a", 7.0), ("b", 2.0)]) == [("a", 10.0), ("b", 20.0)]


def test_csv_files_with_columns_in_other_orders(spark, tmp_path):
    from vector_atlas.sources import tables

    (tmp_path / "a.csv").write_text('Song,Arousal,Valence\ns1,0.1,0.2\n"s,2",0.3,\n')
    (tmp_path / "b.csv").write_text("﻿Valence,Extra,Song,Arousal\n0.5,x,s3,0.4\n")
    got = sorted(tuple(r) for r in tables.scan_av(spark, str(tmp_path)).select("song_id", "arousal", "valence").collect())
    assert got == [("s,2", 0.3, None), ("s1", 0.1, 0.2), ("s3", 0.4, 0.5)]
    (tmp_path / "c.csv").write_text("Song,Valence\ns4,1\n")
    with pytest.raises(ValueError, match="Arousal"):
        tables.scan_av(spark, str(tmp_path))


def rows_at(spark, path):
    return sorted(tuple(r) for r in versions.read_table(spark, path).collect())


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "k string, v long"
    first = spark.createDataFrame([(f"k{i}", i) for i in range(200)], schema)
    assert versions.read_table(spark, path) is None
    assert versions.replace_table(first, path, ["k"], buckets=16) == 1
    before = versions.current(spark, path)
    listed = lambda m: {b: sorted(f.name for f in (tmp_path / "table" / folder).iterdir()) for b, folder in m.folders.items()}
    files = listed(before)
    fresh = spark.createDataFrame([("k7", -7), ("new", 1)], schema)
    keep_last = lambda old, new: joins.upsert_keep_last(old, new, "k")
    assert versions.merge_into(fresh, path, ["k"], keep_last) == 2
    after = versions.current(spark, path)
    touched = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert 1 <= len(touched) <= 2 and all(listed(after)[b] == files[b] for b in files if b not in touched)
    want = sorted([(f"k{i}", -7 if i == 7 else i) for i in range(200)] + [("new", 1)])
    assert rows_at(spark, path) == want
    # a writer that is lost while writing rows, or between rows and manifest, changes nothing
    broken = fresh.selectExpr("k", "if(k = 'new', raise_error('lost'), 5L) as v")
    with pytest.raises(Exception, match="lost"):
        versions.merge_into(broken, path, ["k"], keep_last)
    versions._stored(fresh.withColumn("v", F.lit(9).cast("long")), path, ["k"], 16)
    assert rows_at(spark, path) == want
    # a manifest that was cut off is passed over, and its number is not used again
    (tmp_path / "table" / "manifest" / f"{3:020d}.json").write_text("abc\n{")
    assert rows_at(spark, path) == want
    assert versions.merge_into(spark.createDataFrame([("new", 2)], schema), path, ["k"], keep_last) == 4
    assert ("new", 2) in rows_at(spark, path)
    assert versions.vacuum(spark, path) and len(rows_at(spark, path)) == 201


def test_of_two_writers_the_second_merges_again(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k string, v long"
    versions.replace_table(spark.createDataFrame([("a", 1)], schema), path, ["k"], buckets=4)
    calls = []

    def slow(old, new):
        if not calls:  # another writer publishes while this one merges
            calls.append(versions.merge_into(spark.createDataFrame([("b", 2)], schema), path, ["k"], lambda o, n: joins.upsert_keep_last(o, n, "k")))
        return joins.upsert_keep_last(old, new, "k")

    assert versions.merge_into(spark.createDataFrame([("c", 3)], schema), path, ["k"], slow) == 3 and calls == [2]
    assert rows_at(spark, path) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError, match="do not touch"):
        versions.merge_into(spark.createDataFrame([("c", 3)], schema), path, ["k"], lambda o, n: spark.createDataFrame([(f"z{i}", i) for i in range(20)], schema))
