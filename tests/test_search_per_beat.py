"""The search per beat: partial hits, quality gate and text score, against the gated search of each beat."""

import random
import re
import uuid

import pytest
from beatloom.operators import best, blocks, production, search, timeline
from pyspark.sql import functions as F
from test_operators import py_search

ENTRY = "entry_id int, entities array<string>, actions array<string>, environment array<string>, topic string, description string, quality string, times_used int, media_type string"
BEAT = "row_id int, primary_visual struct<entities: array<string>, search_query: string>"


def entry(i, entities, quality="medium", topic=None, used=0):
    return (i, entities, [], [], topic, None, quality, used, "video")


@pytest.mark.parametrize(
    "visual,want",
    [
        ((["Boxer"], None), (2, 1.0)),  # a partial hit; the exact one is of low quality
        ((["Lake"], "dawn"), (4, 3.5)),  # the words of the topic decide among exact hits
        ((["Lake"], ""), (3, 3.0)), ((["none"], "dawn"), None), (([None, ""], "dawn"), (4, 0.5)), (None, None),
        ((["Boxer CRV", "Lake"], ""), (2, 3.0)), ((["Boxer", "Boxer CRV"], ""), (2, 1.0)),
    ],
)
def test_best_of_a_beat(spark, visual, want):
    held = [entry(1, ["Boxer"], "low"), entry(2, ["Boxer CRV"], "high"), entry(3, ["Lake"]), entry(4, ["lake"], None, "Dawn")]
    got = search.best_per_beat(spark.createDataFrame([(7, visual)], BEAT), spark.createDataFrame(held, ENTRY), "row_id", F.col("primary_visual"))
    assert [(r["entry_id"], r["score"]) for r in got.collect()] == ([want] if want else [])


def test_every_beat_against_the_model(spark, monkeypatch):
    """Several chunks and blocks; entities in their order, partial hits before exact ones."""
    monkeypatch.setattr(blocks, "CHUNK", 40)
    monkeypatch.setattr(blocks, "BLOCK", 50)
    monkeypatch.setattr(blocks, "FREQUENT", 10)
    rng = random.Random(3)
    names = ["Boxer", "Boxer CRV", "Lake", "lake view", "F-35", "Patrol boat", "boat", "Mk4"]
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    held = [(i, rng.sample(names, rng.randrange(4)), rng.sample(["docking", "live docking"], rng.randrange(3)), [], rng.choice([None, "boat lake"]), rng.choice([None, "a boat on the lake"]), rng.choice([None, "low", "high"]), rng.randrange(9), "video") for i in range(120)]
    beats = [(i, (rng.sample(names, rng.randrange(1, 4)) + ["none"], rng.choice([None, "boat Lake", "view mk4 boat"]))) for i in range(150)]
    got = search.best_per_beat(spark.createDataFrame(beats, BEAT), spark.createDataFrame(held, ENTRY), "row_id", F.col("primary_visual"))
    want = set()
    for i, (entities, query) in beats:
        request = {"request_id": i, "query": query or "", "entities": entities, "actions": [], "strictness": "general", "min_quality": "medium"}
        want |= {x for x in py_search(request, [dict(zip(columns, e)) for e in held])[:1]}
    assert {(r["row_id"], r["entry_id"], r["score"]) for r in got.collect()} == want


def model_best(beats, held):
    """A request without entities is the model's request for one that all entries hold, without its points."""
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    entries = [dict(zip(columns, e)) for e in held]
    everywhere = [e | {"entities": [*e["entities"], "*"]} for e in entries]
    want = set()
    for i, (entities, query) in beats:
        request = {"request_id": i, "query": query or "", "entities": entities or ["*"], "actions": [], "strictness": "general", "min_quality": "medium"}
        for r, e, score in py_search(request, entries if entities else everywhere)[:1]:
            want.add((r, e, score if entities else round(score - search.EXACT / 10, 1)))
    return want


def test_cut_lists_against_the_model(spark, monkeypatch):
    """Lists in several blocks and chunks, values with lists of their own, frequent and rare words, requests without entities."""
    for name, value in (("BLOCK", 20), ("CHUNK", 30), ("GROUP", 25), ("WIDE", 3), ("FREQUENT", 10)):
        monkeypatch.setattr(best, name, value)
    rng = random.Random(5)
    names = ["Boxer", "Boxer CRV", "Lake", "lake view", "F-35", "Patrol boat", "boat", "Mk4", "a", "o"]
    held = [(i, rng.sample(names, rng.randrange(4)), rng.sample(["docking", "live docking"], rng.randrange(3)), [], rng.choice([None, "boat lake"]), rng.choice([None, "a boat on the lake"]), rng.choice([None, "low", "high"]), rng.randrange(9), "video") for i in range(200)]
    beats = [(i, (rng.sample(names, rng.randrange(4)) + rng.choice([[], ["none", "Boxer"]]), rng.choice([None, "boat Lake", "docking mk4 boat", "view"]))) for i in range(250)]
    got = search.best_per_beat(spark.createDataFrame(beats, BEAT), spark.createDataFrame(held, ENTRY), "row_id", F.col("primary_visual"))
    found, want = {(r["row_id"], r["entry_id"], r["score"]) for r in got.collect()}, model_best(beats, held)
    assert (found - want, want - found) == (set(), set())


def test_no_entry_is_searched_for_every_chunk_of_beats(spark, monkeypatch, tmp_path):
    """An entry is met by the requests of its own entities only, however many others there are."""
    for module in (blocks, best):
        monkeypatch.setattr(module, "CHUNK", 10)
        monkeypatch.setattr(module, "BLOCK", 10)

        def counting(*args, inner=module._searcher):
            search_group = inner(*args)

            def run(left, right):
                (tmp_path / uuid.uuid4().hex).write_text(str(right.num_rows))
                return search_group(left, right)

            return run

        monkeypatch.setattr(module, "_searcher", counting)
    held = [entry(i, [f"name {i:03d}"]) for i in range(60)]
    beats = [(i, ([f"name {i % 60:03d}"], f"word{i}")) for i in range(240)]
    got = search.best_per_beat(spark.createDataFrame(beats, BEAT), spark.createDataFrame(held, ENTRY), "row_id", F.col("primary_visual"))
    assert {(r["row_id"], r["entry_id"]) for r in got.collect()} == {(i, i % 60) for i in range(240)}
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 60


def test_words_of_items_move_once(spark):
    """Only the last join of the items for rendering shuffles the narration."""
    beats = spark.createDataFrame([(1, "s", 1, "Some words.", 2.0)], "row_id int, script_id string, beat_number int, narration_verbatim string, duration double")
    found = spark.createDataFrame([(1, 5, "image", "high")], "row_id int, entry_id int, media_type string, quality string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        items = timeline.render_items(beats, found)
        plan = spark._jvm.PythonSQLUtils.explainString(items._jdf.queryExecution(), "formatted")
        assert [(r["item_type"], r["start_time"], r["text_overlay"]) for r in items.collect()] == [("image", 0.0, "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert sum("narration" in x for x in moved) == 1


def test_library_is_searched_once(spark, tmp_path):
    """The hits and the beats without a hit come from one search."""

    def counting(batches):
        for batch in batches:
            (tmp_path / uuid.uuid4().hex).write_text(str(batch.num_rows))
            yield batch

    beats = spark.createDataFrame([(1,), (2,)], "row_id int")
    found = spark.createDataFrame([(1, 5)], "row_id int, entry_id int").mapInArrow(counting, "row_id int, entry_id int")
    got = production.with_library_first(beats, lambda b: found, lambda rest: rest.withColumn("rec_id", rest["row_id"] + 10))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5, "library"), (2, 12, "scraped")]
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 1
