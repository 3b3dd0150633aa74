"""Production operators against small models and edge cases."""

import json

from beatloom.functions import text as T
from beatloom.operators import catalog, jobs, ordered, production, render, responses, timeline
from beatloom.sources import dimensions, files, harvest
from pyspark.sql import functions as F


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


def test_family_entities(spark):
    text = "the Boxer CRV and a boxer met F-35B jets of nato near Exercise Talisman. Rheinmetall Defence built it, while old boats waited"
    assert one(spark, T.family_entities, text) == ["Boxer CRV", "boxer", "F-35B", "nato", "Rheinmetall", "Exercise Talisman", "Rheinmetall Defence"]
    assert one(spark, T.family_entities, None) is None and one(spark, T.family_entities, "") == [] and one(spark, T.family_entities, "x" * 40_000) == []


def test_title_as_in_the_stem(spark):
    for stem, want in {"mh60r_seahawk": "Mh60R Seahawk", "a_b": "A B", "it's": "It'S", "": ""}.items():
        assert one(spark, jobs.title, stem) == want


def test_offsets_of_a_long_script(spark):
    """Two thousand sentences: the offsets equal a running sum, without a shuffle."""
    words = [i % 7 + 1 for i in range(2000)]
    script = " ".join("wordy " * n + "end." for n in words)
    df = timeline.segmented(spark.createDataFrame([(1, script)], "id int, text string"), "id", "text")
    rows = sorted((r["beat_id"], r["start_time"]) for r in df.collect() if len(r["beat_id"]) == 4)
    at, want = 0, {}
    for i, n in enumerate(words):
        want[f"B{i + 1:03d}"] = at / 100
        at += (n + 1) * 15 + 150 + 30
    assert dict(rows) == {k: v for k, v in want.items() if len(k) == 4}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_numbering_without_buckets(spark):
    """All rows share their first ten characters; ties and nulls are numbered too."""
    df = spark.createDataFrame([(f"JOB_000000000_{i:05d}" if i % 50 else None, i) for i in range(1000)], "k string, i int").repartition(5)
    got = {r["i"]: r["n"] for r in ordered.numbered(df, [F.col("k"), F.col("i")], None, "n").collect()}
    ranked = sorted(range(1000), key=lambda i: (i % 50 != 0, f"{i:05d}" if i % 50 else "", i))
    assert got == {i: n + 1 for n, i in enumerate(ranked)}
    assert ordered.numbered(df.where("false"), [F.col("i")], None, "n").count() == 0


def test_responses(spark):
    video = {"videos": [{"id": 1, "url": "u", "video_files": [{"link": "a", "width": 640}, {"link": "b", "width": 1920, "height": 1080}, {"link": "c", "width": 1920}]}, {"id": 2, "video_files": []}, {"id": 3, "video_files": [{"link": "d"}]}]}
    df = spark.createDataFrame([(json.dumps(video),), (None,), ("{",), ("{}",)], "r string")
    assert [(r["source_id"], r["download_url"], r["width"]) for r in responses.videos(df, "r").collect()] == [("1", "b", 1920), ("3", "d", 0)]
    photo = {"photos": [{"id": 1, "src": {"original": "o", "small": "s"}}, {"id": 2, "src": {"large": "l", "original": "o", "medium": "m"}}, {"id": 3}]}
    df = spark.createDataFrame([(json.dumps(photo),)], "r string")
    assert [(r["download_url"], r["thumbnail_url"]) for r in responses.photos(df, "r").collect()] == [("o", "s"), ("l", "m"), ("", "")]
    page = lambda mime, **meta: {"imageinfo": [{"url": "u", "mime": mime, "extmetadata": {k: {"name": k, "*": v} for k, v in meta.items()}}]}
    pages = {"query": {"pages": {"1": page("image/png", LicenseShortName="", License="L"), "2": page("image/svg+xml"), "3": page("image/webp", Attribution="A"), "4": page("image/jpeg"), "5": {}}}}
    df = spark.createDataFrame([(json.dumps(pages),)], "r string")
    assert {r["source_id"]: r["license"] for r in responses.archive(df, "r").collect()} == {"1": "L", "3": "A", "4": "CC"}
    assert one(spark, responses.voice_names, "Name: a\nGender: x\nName:b ") == ["a", "b"] and one(spark, responses.fallback_seconds, 32000, "bigint") == 2.0


def test_templates_gates_and_looks(spark):
    df = spark.createDataFrame([("Lake", "", "1999"), ("Lake", "run", None), (None, None, None)], "e string, a string, y string")
    got = [r["q"] for r in df.select(production.filled_templates({"entity": F.col("e"), "action": F.col("a"), "year": F.col("y")}).alias("q")).collect()]
    assert got == [["Lake official video", "Lake demonstration", "Lake exercise 1999"], ["Lake official video", "Lake demonstration", "run near Lake"], []]
    gates = spark.createDataFrame([(["CRV"], ["1999"], ["crv", None], "in 1999", True), (["CRV"], [], ["Boxer"], "", False), ([], ["1999"], None, None, False), ([], [], None, None, True)], "v array<string>, y array<string>, e array<string>, d string, want boolean")
    assert all(r["got"] == r["want"] for r in gates.select("want", production.identity_gate(F.col("v"), F.col("y"), F.col("e"), F.col("d")).alias("got")).collect())
    assert [tuple(one(spark, production.look, m)) for m in ("Epic ", "odd", None)] == [("wide", "dramatic pacing"), ("standard", "steady"), ("standard", "steady")]


def test_library_first_takes_any_search(spark):
    beats = spark.createDataFrame([(1,), (2,), (3,)], "row_id int")
    found = production.with_library_first(beats, lambda b: b.where("row_id = 2").withColumn("entry_id", F.lit(9)), lambda b: b.withColumn("rec_id", F.col("row_id") * 10))
    assert {tuple(r) for r in found.collect()} == {(2, 9, "library"), (1, 10, "scraped"), (3, 30, "scraped")}


def test_filters(spark):
    row = spark.range(1).select(
        render.clip_filter(F.lit(3), F.lit(1.0), F.lit(2.5), F.lit("pan_left")).alias("clip"), render.still_filter(F.lit(0), F.lit(2.0), F.lit("pan_right")).alias("still"),
        render.card_filter(F.lit(1), F.lit("it's 5:00"), F.lit(None).cast("double"), F.lit("odd"), F.lit(0.25), F.lit(0.5)).alias("card"), render.sound_filter(F.lit(1), F.lit(0.0), F.lit(None).cast("double"), F.lit(1.0)).alias("none"), render.mix_filter(F.lit(4)).alias("mix"),
    ).first()
    assert row["clip"].startswith("[3:v]scale=1920:1080") and "crop=iw:ih:iw*0.3*t/2.50:0,format=yuv420p[v3]" in row["clip"]
    assert "on/60,0)" in row["still"] and row["none"] is None and row["mix"] == "[4:a]asetpts=PTS-STARTPTS[aout]"
    assert "text='it\\'s 5\\:00'" in row["card"] and "x=w*0.25:y=h*0.50" in row["card"] and ":d=0.00:" in row["card"]


def test_harvester(spark, tmp_path):
    harvest.register(spark)
    for i, document in enumerate([{"request": "lake", "kind": "photo", "response": {"photos": [{"id": 5, "src": {"large": "L"}}]}}, {"request": "pier", "kind": "video", "response": {}}, "broken"]):
        (tmp_path / f"{i}.json").write_text(json.dumps(document))
    rows = spark.read.format(harvest.NAME).load(str(tmp_path))
    assert {(r["request"], r["kind"]) for r in rows.where("kind <> 'error'").collect()} == {("lake", "photo"), ("pier", "video")} and rows.count() == 3
    photos = responses.photos(spark.read.format(harvest.NAME).option("kind", "photo").load(str(tmp_path)), "response").collect()
    assert [(r["request"], r["download_url"]) for r in photos] == [("lake", "L")]
    assert spark.read.format(harvest.NAME).load(str(tmp_path / "none")).count() == 0


def test_queue_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "s", None, "queued"), ("2", "t", "a", "done")], "id string, script string, audio string, status string")
    files.save_queue(rows, {"queue_id": "Q", "niche": "n"}, str(tmp_path / "queue"))
    text = "".join(f.read_text() for f in (tmp_path / "queue").glob("part-*.json"))
    assert json.loads(text)["completed"] == 1 and json.loads(text)["niche"] == "n" and "audio" not in json.loads(text)["jobs"][0]
    back = files.queue(spark, f"file://{tmp_path}/queue")
    assert {(r["queue_id"], r["id"], r["status"], r["format_variant"]) for r in back.collect()} == {("Q", "1", "queued", "F1"), ("Q", "2", "done", "F1")}
    assert files.queue(spark, f"file://{tmp_path}/none").columns == back.columns


def test_jobs_of_folders(spark, tmp_path):
    for name in ("b.txt", "a_x.txt", "a_x.mp3", "c.mp3"):
        (tmp_path / name).write_text("x")
    found = files.from_folders(spark, str(tmp_path), str(tmp_path), "n").collect()
    assert [(r["title"], r["niche"], r["status"]) for r in found] == [("A X", "n", "queued")]


def test_dimensions_and_postings(spark):
    assert dimensions.voices(spark).count() == 5 and dimensions.languages(spark).where("voice is null").count() == 0
    held = spark.createDataFrame([(1, ["A", "a", None]), (2, ["b"]), (3, [])], "entry_id int, entities array<string>")
    assert sorted(tuple(r) for r in catalog.postings(held, "entities", "entity").collect()) == [("a", 1), ("b", 2)]
