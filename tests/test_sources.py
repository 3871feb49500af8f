import json

import pytest
from pyspark.sql import functions as F

from galleryloom.operators.labels import extract_labels
from galleryloom.sources import annotate, documents, images, tables
from galleryloom.streaming.ingest import ingest_labels, ingested_labels


def test_csv_round_trip_with_line_breaks_and_quotes(spark, tmp_path):
    rows = [("a", 'he said "x",\nthen left'), ("b", "plain"), ("c", None)]
    df = spark.createDataFrame(rows, "image_name string, description string")
    tables.csv_sink(df, str(tmp_path / "t"))
    back = tables.csv_scan(spark, str(tmp_path / "t"), df.schema, required=("description",), multi_line=True)
    got = {r.image_name: r.description for r in back.collect()}
    assert got["a"] == rows[0][1] and got["b"] == "plain" and not got["c"]
    with pytest.raises(ValueError):
        tables.csv_scan(spark, str(tmp_path / "t"), required=("absent",))


def test_names_from_image_path(spark):
    df = spark.createDataFrame([("x\\y\\p.jpg", "t"), ("/a/b/q.png", "u")], "image_path string, desc string")
    assert [tuple(r) for r in tables.with_text_and_name(df).collect()] == [("p.jpg", "t"), ("q.png", "u")]


def test_encodings_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,text\n1,中文\n".encode("cp950"))
    (tmp_path / "b.csv").write_bytes("id,text\n2,中文é\n".encode("utf-8-sig"))
    got = tables.csv_scan_encodings(spark, str(tmp_path), "id int, text string")
    assert {r.id: r.text for r in got.collect()} == {1: "中文", 2: "中文é"}
    (tmp_path / "c.csv").write_bytes(b"id,text\n3,\xff\xff\n")
    with pytest.raises(ValueError):
        tables.csv_scan_encodings(spark, str(tmp_path), "id int, text string")


def test_json_folders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    good = {"image_name": "a.jpg", "labels": [{"description": "x", "score": 0.5}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=4))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "other.txt").write_text(json.dumps(good))
    (tmp_path / "deep" / "b.json").write_text(json.dumps(good))
    docs = documents.json_dir_scan(spark, str(tmp_path))
    assert documents.skipped_count(docs).first().asDict() == {"read": 2, "skipped": 1}
    assert extract_labels(documents.readable(docs)).count() == 2
    assert documents.json_dir_scan(spark, str(tmp_path), recursive=False).count() == 2


def test_listing_types_and_stems(spark, tmp_path):
    for name in ("B.JPG", "a.png", "c.txt", ".jpg"):
        (tmp_path / name).write_bytes(b"x")
    listed = images.supported_images(images.list_files(spark, str(tmp_path)))
    assert [r.image_name for r in listed.collect()] == ["a.png", "B.JPG"]
    df = spark.createDataFrame([("a.JPG",), ("b",), ("x.unknownkind",)], "p string")
    assert [r.m for r in df.select(images.mime_type("p").alias("m")).collect()] == [
        "image/jpeg", "application/octet-stream", "application/octet-stream",
    ]


def test_pending_images(spark):
    todo = spark.createDataFrame([("a.b.jpg",), ("c.png",)], "image_name string")
    done = spark.createDataFrame([("a.b_vision_results.json",)], "result_name string")
    assert [r.image_name for r in images.resume_pending(todo, done).collect()] == ["c.png"]


def test_annotator_errors_do_not_end_the_job(spark):
    def annotator(name, content, mime):
        if name == "bad.jpg":
            raise ValueError("no")
        if name == "busy.jpg":
            raise annotate.TransientError("later")
        return "  fine "

    df = spark.createDataFrame([(n, bytearray(b"x")) for n in ("ok.jpg", "bad.jpg", "busy.jpg")], "image_name string, content binary")
    rows = {r.image_name: r for r in annotate.batch_annotate(df, annotator, retries=2, pause=0.0).collect()}
    assert rows["ok.jpg"].description == "fine" and rows["ok.jpg"].error is None
    assert rows["bad.jpg"].description == "" and rows["bad.jpg"].attempts == 1
    assert rows["busy.jpg"].attempts == 3 and "later" in rows["busy.jpg"].error


def test_stream_processes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def put(i):
        (source / f"{i}.json").write_text(json.dumps({"image_name": f"{i}", "labels": [{"description": "x", "score": 1.0}]}))

    for i in range(3):
        put(i)
    args = (spark, str(source), str(tmp_path / "out"), str(tmp_path / "chk"))
    ingest_labels(*args)
    put(3)
    ingest_labels(*args)
    ingest_labels(*args)
    got = ingested_labels(spark, str(tmp_path / "out"))
    assert sorted(r.image_name for r in got.collect()) == ["0", "1", "2", "3"]
    batch = extract_labels(documents.readable(documents.json_dir_scan(spark, str(source))))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, got.select("image_name", "label", "score").collect()))


def test_routing(spark, tmp_path):
    labels = spark.createDataFrame([(" a.jpg ", 1), ("b.jpg", 1), ("c.jpg", 2)], "image_name string, new_topic_num int")
    present = spark.createDataFrame([("a.jpg", "/p/a.jpg"), ("c.jpg", "/p/c.jpg")], "image_name string, path string")
    routed = images.route_by_topic(labels, present)
    assert {r.new_topic_num: (r.found, r.missing) for r in images.routing_counts(routed).collect()} == {"1": (1, 1), "2": (1, 0)}
    for _ in range(2):
        images.write_by_topic(routed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("new_topic_num") == 1).count() == 1
