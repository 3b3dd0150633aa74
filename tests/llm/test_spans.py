import random

from beatloom.llm import spans as S

ALPHABET = "abcdefghij klmnop é日💥"


def text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def brute(docs):
    windows = {}
    for d, t in docs:
        for i in range(len(t or "") - S.SPAN + 1):
            windows.setdefault(t[i : i + S.SPAN], set()).add(d)
    return {(a, b) for ds in windows.values() for a in ds for b in ds if a < b}


def shared(docs):
    windows = {}
    for n, (d, t) in enumerate(docs):
        for i in range(len(t or "") - S.SPAN + 1):
            windows.setdefault(t[i : i + S.SPAN], set()).add(n)
    out = {}
    for n, (d, t) in enumerate(docs):
        marks = [0] * len(t or "")
        for i in range(len(t or "") - S.SPAN + 1):
            if len(windows[t[i : i + S.SPAN]]) > 1:
                marks[i : i + S.SPAN] = [1] * S.SPAN
        if sum(marks):
            out[d] = sum(marks)
    return out


def corpus():
    rng = random.Random(7)
    p, q = text(rng, 320), text(rng, 900)
    docs = [
        (1, text(rng, 50) + p + text(rng, 60)), (2, text(rng, 10) + p), (3, p[:319] + text(rng, 200)), (4, text(rng, 20) + q[:500] + text(rng, 20)), (5, q), (6, q), (7, text(rng, 400) + q[300:]),
        (8, None), (9, ""), (10, "a" * 2000), (11, "b" + "a" * 700), (12, "a" * 319), (13, p[1:] + "Z" + text(rng, 100)), (14, text(rng, 1500)), (15, q[:400] + "-" + p),
    ]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, class string, h int")


def test_pairs(spark):
    docs = corpus()
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in S.shared_pairs(frame(spark, docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs)


def test_shares(spark):
    docs = corpus()
    rows = {r["doc_id"]: r["n_shared"] for r in S.shares(frame(spark, docs)).collect()}
    assert rows == {d: 0 for d, _ in docs} | shared(docs)


def test_many_copies(spark):
    rng = random.Random(2)
    base = text(rng, 600)
    docs = [(i, base) for i in range(40)] + [(i, text(rng, 500)) for i in range(100, 110)]
    assert S.shared_pairs(frame(spark, docs)).count() == 40 * 39 // 2
    assert {(r["n_shared"], r["share"]) for r in S.shares(frame(spark, docs)).collect()} == {(600, 1.0), (0, 0.0)}
    assert {(r["class_id"], r["n_copies"], r["n_links"]) for r in S.linked_classes(frame(spark, docs)).where("doc_id < 100").collect()} == {(0, 40, 0)}


def test_links(spark):
    docs = corpus()
    pairs, texts = brute(docs), dict(docs)
    rows = {r["doc_id"]: r for r in S.linked_classes(frame(spark, docs)).collect()}
    for d, r in rows.items():
        linked = {texts[b if a == d else a] for a, b in pairs if d in (a, b)} - {texts[d]}
        assert r["n_links"] == len(linked) and r["class_id"] == min(x for x, t in docs if t == texts[d])


def test_blocks_of_surroundings(spark, monkeypatch):
    """A hash with more surroundings than one task pairs."""
    monkeypatch.setattr(S, "BLOCK", 3)
    rng = random.Random(3)
    passage = text(rng, 330)
    docs = [(i, text(rng, 30 + i) + passage[: 320 + i % 11] + text(rng, 40)) for i in range(24)]
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in S.shared_pairs(frame(spark, docs)).collect()}
    assert got == brute(docs)


def test_one_passage_in_ten_thousand_texts(spark):
    """The shares of a passage that very many texts hold: no pairs are formed."""
    rng = random.Random(8)
    passage = text(rng, 400)
    df = spark.range(10_000).selectExpr("id as doc_id", f"concat(repeat(md5(string(id)), 3), '{passage}', repeat(sha2(string(id), 256), 2)) as text")
    rows = S.shares(df).groupBy("n_shared").count().collect()
    assert sum(r["count"] for r in rows) == 10_000 and all(400 <= r["n_shared"] < 420 for r in rows)


def test_slabs_lose_nothing(monkeypatch):
    rng = random.Random(4)
    shared_text = text(rng, S.SPAN)
    a, b = text(rng, 3000) + shared_text + text(rng, 2500), text(rng, 411) + shared_text
    for slab in (700, 1000, 1333, 1 << 20):
        monkeypatch.setattr(S, "SLAB", slab)
        hashes, owner = S.fingerprints([a, "short", b])
        assert set(hashes[owner == 0].tolist()) & set(hashes[owner == 2].tolist()), slab


def test_winnowing_guarantee():
    rng = random.Random(9)
    for _ in range(30):
        shared_text = text(rng, S.SPAN)
        pair = [text(rng, rng.randrange(200)) + shared_text + text(rng, rng.randrange(200)) for _ in range(2)]
        found = [set(S.fingerprints([t])[0].tolist()) for t in pair]
        assert found[0] & found[1]


def test_empty(spark):
    assert S.shared_pairs(frame(spark, [])).count() == 0 and S.shares(frame(spark, [])).count() == 0


def test_query(spark, sf_dir):
    import __spark_entry__ as entry

    rows = {tuple(r) for r in entry.queries()["p10_found"](spark, sf_dir).select("doc_id_a", "doc_id_b").collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows == brute(docs)
