import json

from beatloom.sources import dimensions, files
from beatloom.streaming import queue


def test_library_and_queue(spark, tmp_path):
    library = tmp_path / "library.json"
    library.write_text(json.dumps({"entries": {"A": {"type": "video", "file": "a.mp4", "entities": ["x"]}, "B": {"id": "B", "file_path": "b.mp4", "quality": "high"}}}))
    rows = {r["id"]: r for r in files.library(spark, str(library)).collect()}
    assert rows["A"]["file_path"] == "a.mp4" and rows["A"]["quality"] == "medium" and rows["B"]["file_path"] == "b.mp4"
    assert files.library(spark, str(tmp_path / "none.json")).count() == 0
    jobs = tmp_path / "jobs.json"
    jobs.write_text(json.dumps({"queue_id": "Q", "jobs": [{"id": "1", "script": "s", "audio": "a", "niche": "n", "title": "t"}, {"id": "2", "status": "done", "progress": 1.0}]}))
    got = files.queue(spark, str(jobs)).orderBy("position").collect()
    assert [(r["id"], r["status"], r["progress"], r["format_variant"]) for r in got] == [("1", "queued", 0.0, "F1"), ("2", "done", 1.0, "F1")]
    assert files.queue(spark, str(tmp_path / "none.json")).count() == 0


def test_folders(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" hello\n", encoding="utf-8")
    (tmp_path / "b.mp3").write_bytes(b"12345")
    assert [r["text"].strip() for r in files.scripts(spark, str(tmp_path)).collect()] == ["hello"]
    assert [r["length"] for r in files.listing(spark, str(tmp_path), "*.mp3").collect()] == [5]
    assert files.pack(spark, str(tmp_path / "none.yaml")).count() == 0


def test_save(spark, tmp_path):
    files.save_json(spark.createDataFrame([("a", None)], "k string, v string"), str(tmp_path / "out"))
    row = json.loads("".join(f.read_text() for f in (tmp_path / "out").glob("part-*.json")))  # empty partitions may leave empty files
    assert row["k"] == "a" and "v" not in row and "saved_at" in row


def test_dimensions(spark):
    assert dimensions.languages(spark).count() == 12 and dimensions.resolutions(spark).count() == 3


def test_stream_takes_each_job_once(spark, tmp_path):
    drop, out, checkpoint = (str(tmp_path / n) for n in ("drop", "out", "checkpoint"))
    schema = "job_id string, status string"
    spark.createDataFrame([("1", "queued"), ("2", "DONE"), ("3", None)], schema).coalesce(1).write.parquet(drop)
    shape = spark.read.parquet(drop).schema
    first = {r["job_id"] for r in queue.drained(spark, drop, shape, checkpoint, out).collect()}
    assert first == {"1", "3"}
    spark.createDataFrame([("4", " running ")], schema).coalesce(1).write.mode("append").parquet(drop)
    again = sorted(r["job_id"] for r in queue.drained(spark, drop, shape, checkpoint, out).collect())
    assert again == ["1", "3", "4"]
