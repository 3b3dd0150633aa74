import json

from beatloom.operators import nested as N

VISUAL = {"media_type": "image", "entities": ["A", None, {"name": "B"}, {"name": None}, {"role": "x"}, ""], "shot": {"move": {"kind": "pan"}}}


def brute(payloads):
    out = []
    for raw_id, text in payloads:
        root = N.parse_payload(text)
        if root is None:
            continue
        for b, beat in enumerate(N.beats_of(root)):
            for field in N.VISUALS:
                value = beat.get(field)
                value = json.loads(value) if isinstance(value, str) and value[:1] in "{[" else value
                for v, visual in enumerate(value if isinstance(value, list) else [] if value is None else [value]):
                    if not isinstance(visual, dict):
                        continue
                    names = visual.get("entities")
                    for i, e in enumerate(names if isinstance(names, list) else [] if names is None else [names]):
                        name = e.get("name") if isinstance(e, dict) else e
                        if name is not None:
                            out.append((raw_id, b, field, v, i, name if isinstance(name, str) else json.dumps(name)))
            value = beat.get(N.OVERLAY)
            for o, overlay in enumerate(value if isinstance(value, list) else [] if value is None else [value]):
                content = overlay.get("content") if isinstance(overlay, dict) else overlay
                if content:
                    out.append((raw_id, b, N.OVERLAY, o, 0, content))
    return sorted(out)


def run(spark, payloads):
    df = spark.createDataFrame([(i, p, 1, "x") for i, p in payloads], "raw_id bigint, payload string, pre int, kind string")
    return sorted(tuple(r) for r in N.item_table(N.nodes(df)).select("raw_id", "beat_pos", "node", "node_pos", "item_pos", "item_value").collect())


def payloads():
    beats = [
        {"beat_id": "B1", "primary_visual": VISUAL, "fallback_visual": None, "text_overlay": {"type": "t", "content": "X {}"}},
        {"beat_id": "B2", "primary_visual": [VISUAL, {"entities": "alone"}, None, {"entities": None}], "text_overlay": ["one", {"content": ""}, {"content": None}, {"content": "two"}]},
        {"beat_id": "B3", "primary_visual": json.dumps(VISUAL), "fallback_visual": [], "text_overlay": "plain, sector {}"},
        {"beat_id": "B4", "primary_visual": {"entities": [7, True]}},
    ]
    whole = json.dumps({"beats": beats})
    return [
        (1, whole), (2, json.dumps(beats)), (3, json.dumps({"clue": {"meta": {"s": 1}, "beats": beats}, "version": 2})),
        (4, json.dumps({"segments": [{"segment_id": "S1", "beats": beats[:1]}, {"segment_id": "S2", "beats": beats[1:]}]})),
        (5, json.dumps(whole)), (6, json.dumps(json.dumps(whole))), (7, f"```json\n{whole}\n```"), (8, f"Here [sic] it is:\n{whole}\nThanks."),
        (9, whole[:-20]), (10, None), (11, ""), (12, "null"), (13, "no json"), (14, "[]"), (15, "{}"), (16, "[" * 100_000), (17, f"```json\n{whole[:400]}"),
        (18, json.dumps({"beats": [{"beat_id": "L", "text_overlay": "y" * 200_000}]})), (19, json.dumps({"beats": []})),
    ]


def test_shapes(spark):
    data = payloads()
    got = run(spark, data)
    assert got == brute(data)
    assert {r[0] for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, 18}
    assert [r[1:] for r in got if r[0] == 1] == [r[1:] for r in got if r[0] == 4]
    assert (1, 1, "primary_visual", 1, 0, "alone") in got and (1, 1, "text_overlay", 3, 0, "two") in got
    assert (1, 0, "primary_visual", 0, 5, "") in got


def test_repeated_ids_stay_apart(spark):
    data = [(1, payloads()[0][1]), (1, payloads()[1][1])]
    assert run(spark, data) == brute(data)


def test_labels_nest():
    rows = N.label(json.loads(payloads()[0][1]))
    spans = [(r[0], r[1]) for r in rows]
    assert all(a < b for a, b in spans)
    assert sorted(x for s in spans for x in s) == list(range(2 * len(rows)))
    assert all(a2 > b1 or b2 < b1 for a1, b1 in spans for a2, b2 in spans if a1 < a2)


def test_tables(spark):
    df = spark.createDataFrame(payloads(), "raw_id bigint, payload string")
    nodes = N.nodes(df)
    assert N.beat_table(nodes).where("raw_id = 4").count() == 4
    visuals = {tuple(r) for r in N.visual_table(nodes).where("raw_id = 1").select("beat_pos", "node", "node_pos").collect()}
    assert visuals == {(0, "primary_visual", 0), (1, "primary_visual", 0), (1, "primary_visual", 1), (1, "primary_visual", 3), (2, "primary_visual", 0), (3, "primary_visual", 0)}


def test_empty(spark):
    assert run(spark, []) == []


def test_repeated_ids_over_partitions(spark):
    """Two different payloads of one id in two partitions keep their own parents."""
    beats = [{"beat_id": f"B{i}", "primary_visual": [{"entities": [f"E{i}"]}] * (i % 3 + 1), "text_overlay": f"T{i}"} for i in range(40)]
    data = [(7, json.dumps({"beats": beats})), (7, json.dumps({"clue": {"beats": beats[5:9]}})), (7, json.dumps(beats[::-1]))]
    df = spark.createDataFrame(data, "raw_id bigint, payload string").repartition(3, "payload")
    got = sorted(tuple(r) for r in N.item_table(N.nodes(df)).select("raw_id", "beat_pos", "node", "node_pos", "item_pos", "item_value").collect())
    assert got == brute(data)
    nodes = N.nodes(df).collect()
    assert len({r["copy"] for r in nodes}) == 3 and len({(r["copy"], r["pre"]) for r in nodes}) == len(nodes)


def test_links_are_containment(spark):
    """The linked beat and visual of every node, against a search of all intervals."""
    rows = N.nodes(spark.createDataFrame(payloads()[:4], "raw_id bigint, payload string")).collect()
    for r in rows:
        for kind in N.LINKED:
            around = [o["pre"] for o in rows if o["copy"] == r["copy"] and o["kind"] == kind and o["pre"] < r["pre"] and r["post"] < o["post"]]
            assert r[f"{kind}_pre"] == (max(around) if around else None)


def test_terms_and_kinds(spark):
    beat = {"beat_id": "B", "primary_visual": {"entities": ["A"], "actions": "run", "context": [None, "dawn"]}, "last_resort": {"content": "card"}, "notes": {"a": [1]}}
    df = spark.createDataFrame([(1, json.dumps({"meta": {"v": 1}, "beats": [beat]}))], "raw_id bigint, payload string")
    terms = {(r["kind"], r["item_pos"], r["item_value"]) for r in N.term_table(N.nodes(df)).collect()}
    assert terms == {("entity", 0, "A"), ("action", 0, "run"), ("context", 1, "dawn")}
    assert {r["kind"] for r in N.nodes(df).collect()} >= {"payload", "envelope", "beat", "visual", "entity", "action", "context", "last_resort", "object", "list", "value"}
    assert {r["kind"] for r in N.nodes(df, kinds=("beat",)).collect()} == {"beat"}
