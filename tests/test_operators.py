"""Studio operators against small models and edge cases."""

import random

import pytest
from beatloom.functions import text as T
from beatloom.operators import catalog, ingest, jobs, ordered, search, timeline
from pyspark.sql import functions as F


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


# ------------------------------------------------------------------------ text


@pytest.mark.parametrize(
    "text,want",
    [
        (None, "en"), ("short", "en"), ("Привет, это большой текст", "ru"), ("これは日本語の文章です", "ja"), ("이것은 한국어 문장입니다", "ko"), ("هذا نص باللغة العربية", "ar"), ("यह हिन्दी का वाक्य है", "hi"), ("这是一个中文的句子没错啊", "zh"),
        ("le chat est dans la maison avec une souris", "fr"), ("der Hund und die Katze sind auf dem Dach", "de"), ("the quick brown fox jumps", "en"), ("1234567890 1234", "en"), ("abcdefghi я", "en"), ("abcdefgh я", "ru"),
    ],
)
def test_language(spark, text, want):
    assert one(spark, T.language, text) == want


@pytest.mark.parametrize(
    "text,how",
    [('{"a": 1}', "whole"), ('x\n```json\n{"a": 1}\n```\ny', "fenced"), ('x\n```\n{"a": 1}\n```', "fenced"), ('say {"a": 1} so', "embedded"), ("none", "none"), ("} {", "none"), ('{"a": ', "none"), (None, "none"), ("", "none")],
)
def test_json(spark, text, how):
    assert one(spark, T.extracted_json, text)["how"] == how


def test_speech_text(spark):
    assert one(spark, T.speech_text, "# Title\n\n**Bold** and [link](http://x) [aside] `code`. Next: ```\nblock\n``` end!  Yes") == "Title Bold and link . ... Next: ... end! ... Yes"
    assert len(one(spark, T.speech_text, "x" * 7501)) == 7500


def test_entities(spark):
    assert one(spark, T.entities, "The Boxer of Iron Dome met an alternator. Zoltirö stood by Big Bay") == ["The Boxer", "Iron Dome", "Big Bay", "Boxer", "NATO"]
    assert one(spark, T.entities, "") == []


# ---------------------------------------------------------------------- search


def py_gate(held, requested, strictness):
    held = [h.lower() for h in held if h]
    for r in [r.lower() for r in requested if r]:
        if r in held:
            return "exact"
        if any(r in h or h in r for h in held):
            return "reject" if strictness in ("exact", "specific") else "downgrade"
    return "reject"


def py_search(request, entries):
    rank = {"low": 0, "medium": 1, "high": 2}
    out = []
    for e in entries:
        if rank.get(e["quality"] or "medium", 0) < rank.get(request["min_quality"], 0):
            continue
        gate = py_gate(e["entities"], request["entities"], request["strictness"])
        if gate == "reject":
            continue
        query = set(request["query"].lower().split())
        tags = {w for t in e["entities"] + e["actions"] if t for w in t.lower().split()}
        tenths = 3 * len(query & set((e["description"] or "").lower().split())) + 5 * len(query & set((e["topic"] or "").lower().split())) + 10 * len(query & tags)
        tenths += 30 if gate == "exact" else 10
        if request["actions"]:
            if not any(a in h or h in a for a in request["actions"] for h in (x.lower() for x in e["actions"])):
                continue
            tenths += 15
        out.append((request["request_id"], e["entry_id"], tenths - min(2 * e["times_used"], 10)))
    out.sort(key=lambda x: (-x[2], x[1]))
    return [(r, e, t / 10) for r, e, t in out[:20]]


def test_gated_search_against_model(spark):
    rng = random.Random(5)
    vocabulary = ["Boxer", "Boxer CRV", "Lake", "lake view", "F-35", "Patrol boat", "boat", "Mk4"]
    entries = [
        {
            "entry_id": i, "entities": rng.sample(vocabulary, rng.randrange(4)) + [None] * rng.randrange(2), "actions": rng.sample(["docking", "live docking", "loading"], rng.randrange(3)), "environment": [], "topic": rng.choice([None, "boat lake"]),
            "description": rng.choice([None, "", "a boat on the lake", "Boxer at dawn"]), "quality": rng.choice([None, "low", "medium", "high", "odd"]), "times_used": rng.randrange(9), "media_type": "video",
        }
        for i in range(120)
    ]
    requests = [
        {"request_id": i, "query": rng.choice(["boat boat lake", "", "Boxer dawn"]), "entities": rng.sample(vocabulary, 2) + [""], "actions": rng.choice([[], ["docking"]]), "context": [], "strictness": s, "min_quality": q, "asset_type": None}
        for i, (s, q) in enumerate((s, q) for s in ("exact", "specific", "general", "loose") for q in ("low", "medium", "high"))
    ]
    entry_schema = "entry_id int, entities array<string>, actions array<string>, environment array<string>, topic string, description string, quality string, times_used int, media_type string"
    request_schema = "request_id int, query string, entities array<string>, actions array<string>, context array<string>, strictness string, min_quality string, asset_type string"
    got = search.gated_search(spark.createDataFrame(requests, request_schema), spark.createDataFrame(entries, entry_schema))
    want = [x for r in requests for x in py_search(r, entries)]
    assert sorted((r["request_id"], r["entry_id"], r["score"]) for r in got.collect()) == sorted(want)


def test_first_partial_rejects_later_exact(spark):
    entry_schema = "entry_id int, entities array<string>, actions array<string>, environment array<string>, topic string, description string, quality string, times_used int, media_type string"
    request_schema = "request_id int, query string, entities array<string>, actions array<string>, context array<string>, strictness string, min_quality string, asset_type string"
    held = spark.createDataFrame([(1, ["Boxer CRV", "Lake"], [], [], None, None, None, 0, "video")], entry_schema)
    asked = spark.createDataFrame([(1, "", ["Boxer", "Lake"], [], [], "exact", "low", None), (2, "", ["Lake", "Boxer"], [], [], "exact", "low", None)], request_schema)
    assert [r["request_id"] for r in search.gated_search(asked, held).collect()] == [2]


def test_containing_pairs_with_long_values(spark):
    held = spark.createDataFrame([("x" * 20_000,), ("lake",), ("",), (None,)], "held string")
    asked = spark.createDataFrame([("ake",), ("the lake",), ("",), (None,)], "req string")
    got = {tuple(r) for r in search.containing_pairs(asked, held).collect()}
    assert got == {("ake", "lake", False), ("the lake", "lake", False)}


# --------------------------------------------------------------------- ordered


def test_ordered_computations(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.choice([None, *range(40)]), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, n int, id int, v int")
    order, bucket = [F.coalesce("n", F.lit(-1)), F.col("id")], F.floor(F.col("n") / 7)
    ranked = sorted(data, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))
    total, before, want_total, want_before = {}, {}, {}, {}
    for k, _, i, v in ranked:
        want_total[i], want_before[i] = total.get(k, 0), before.get(k)
        total[k], before[k] = total.get(k, 0) + v, v
    assert {r["id"]: r["at"] for r in ordered.running_total(df, ["k"], order, bucket, F.col("v"), "at").collect()} == want_total
    assert {r["id"]: r["p"] for r in ordered.lagged(df, ["k"], order, bucket, {"p": F.col("v")}).collect()} == want_before
    placed = ordered.numbered(df, [F.col("id")], F.floor(F.col("id") / 10), "pos")
    assert {r["id"]: r["pos"] for r in placed.collect()} == {i: i + 1 for i in range(300)}


# ---------------------------------------------------- catalog, jobs and ingest


def test_catalogued(spark):
    response = "DESCRIPTION: A pier: at dawn\nENTITIES: Lake, , Boat \nACTIONS:\nQUALITY:"
    row = catalog.catalogued(spark.createDataFrame([(response, "p/x.mp4", "pexels"), ("", "y", "other")], "response string, path string, source string"), "response", "path", "source").orderBy("path").collect()
    assert row[0]["description"] == "A pier: at dawn" and row[0]["entities"] == ["Lake", "Boat"] and row[0]["actions"] == [] and row[0]["quality"] == "medium"
    assert row[0]["catalog_id"].startswith("PEX_") and row[1]["catalog_id"].startswith("UNK_")


def test_variants_skip_done(spark):
    rows = [(f"J{i:03d}", "done" if i == 3 else "queued", "ready" if i % 2 else "gaps") for i in range(1, 13)]
    got = jobs.variants(spark.createDataFrame(rows, "job_id string, status string, readiness string")).orderBy("position").collect()
    assert [r["format_variant"] for r in got] == [f"F{n}" for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 1, 2)]
    assert got[0]["job_id"] == "J001" and "J003" not in {r["job_id"] for r in got}


def test_pairing(spark):
    scripts = spark.createDataFrame([("s/a_b.txt",), ("s/c.txt",), (None,)], "path string")
    audio = spark.createDataFrame([("w/a_b.mp3",), (None,)], "path string")
    assert [tuple(r) for r in jobs.paired(scripts, audio).collect()] == [("s/a_b.txt", "w/a_b.mp3", "A B")]
    assert [r["script"] for r in jobs.unpaired(scripts, audio).collect()] == ["s/c.txt"]


def test_first_seen_keeps_null_urls(spark):
    df = spark.createDataFrame([("u", 2), ("u", 1), (None, 3), (None, 4)], "url string, n int")
    assert sorted((r["url"] or "", r["n"]) for r in ingest.first_seen(df, "url", "n").collect()) == [("", 3), ("", 4), ("u", 1)]


def test_beat_queries(spark):
    df = spark.createDataFrame([(None, ["A", None, "B", "C"], [], "n"), ("t", ["A"], ["x", "y", "z"], "n"), ("", [], [], "m" * 99), (None, None, None, None)], "t string, e array<string>, a array<string>, n string")
    got = [r["q"] for r in df.select(ingest.beat_queries(F.col("t"), F.col("e"), F.col("a"), F.col("n")).alias("q")).collect()]
    assert got == [["A footage", "B footage"], ["t", "A x", "A y"], ["m" * 80], [""]]


def test_segmentation(spark):
    df = spark.createDataFrame([(1, "One two three. Hi! Four five six seven?  End of it."), (2, None), (3, ""), (4, "x" * 30_000)], "id int, text string")
    got = [(r["id"], r["beat_id"], r["start_time"], r["end_time"]) for r in timeline.segmented(df, "id", "text").orderBy("id", "beat_id").collect()]
    assert got == [(1, "B001", 0.0, 1.95), (1, "B003", 2.25, 4.35), (1, "B004", 4.65, 6.6), (4, "B001", 0.0, 1.65)]
    assert [tuple(r) for r in timeline.script_lengths(df.where("id = 1"), "id", "text").collect()] == [(1, 3, 6.9, 6.0)]


def test_motion(spark):
    rows = spark.createDataFrame([("epic", None), ("hopeful", "high"), (None, "high"), ("neutral", "low")], "m string, q string")
    assert [r["x"] for r in rows.select(timeline.motion(F.col("m"), F.col("q")).alias("x")).collect()] == ["push_in_slow", "pan_right", "push_in_slow", "static"]
