from beatloom.llm import history as H
from pyspark.sql import functions as F

import pytest

SAME = [
    "https://www.stockpile.example/video/docking-near-ulm-10025675180/", "http://M.STOCKPILE.EXAMPLE:80/video/10025675180#t=12", "https://media.stockpile.example/video%2Dfiles/10025675180/10025675180-hd_1920_1080_25fps.mp4?sid=1",
    "https://cdn2.stockpile.example/video-files//10025675180/10025675180-sd_640_360_25fps.mp4",
]
GROUPS = [
    SAME,
    ["https://filmlocker.example/clip?id=10000769925", "http://www.filmlocker.example:80/clip?utm_source=feed&view=full&id=10000769925", "https://Dl.filmlocker.example/get?w=1280&asset=10000769925#top"],
    ["https://agencywire.example/2022/12/pass-near-x-64096589", "http://agencywire.example/item/64096589?sid=5", "https://static.agencywire.example/media/64096589/master.mov", "https://amp.agencywire.example/2022/12/pass-near-x-64096589"],
    ["https://www.tubethumb.example/watch?v=dqV5GRMWoIA", "https://tubethumb.example:443/watch?feature=share&v=dqV5GRMWoIA&t=12s", "https://tbth.example/dqV5GRMWoIA/?ref=a", "http://I.TUBETHUMB.EXAMPLE/vi//dqV5GRMWoIA/hqdefault.jpg", "http://www.tubethumb.example/embed/dqV5GRMWoIA/"],
    ["https://www.tubethumb.example/watch?v=dqv5GRMWoIA"],
    ["https://archive.openarchive.example/wiki/File:Night_trial_1.jpg", "https://archive.openarchive.example/wiki/File%3ANight%20trial%201.jpg", "https://m.archive.openarchive.example/w/index.php?title=File:Night_trial_1.jpg", "https://upload.openarchive.example/f/9f/Night_trial_1.jpg", "http://upload.openarchive.example/thumb/f/9f/Night_trial_1.jpg/640px-Night_trial_1.jpg"],
    ["https://archive.openarchive.example/wiki/File:Night_trial_1_(2).jpg"],
    ["https://www.other.example/a//b/?utm_x=1&q=2&p=1#f", "http://other.example:8080/a/b?p=1&q=2", "//m.other.example/a/b/?q=2&p=1"],
    ["https://other.example/a/c"],
]


def keys(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return [r["k"] for r in H.with_address_key(df, "u", "k").orderBy("i").select("k").collect()]


def test_addresses(spark):
    found = [set(keys(spark, g)) for g in GROUPS]
    assert all(len(s) == 1 and None not in s for s in found), found
    assert len(set.union(*found)) == len(GROUPS)
    assert keys(spark, [None, "", "  "]) == [None, None, None]
    assert keys(spark, ["http://x.example/%zz", "y" * 50_000])[1]


def records(spark, rows):
    df = spark.createDataFrame([(i, a, b, 1) for i, a, b in rows], "rec_id bigint, a string, b string, hash int")
    return H.signatures(df, "rec_id", F.array("a", "b"))


def model(batches):
    first, out = {}, set()
    for i, a, b in sorted(r for batch in batches for r in batch):
        parts = {p for p in (a, b) if p and p.strip()}
        seen = [first[p] for p in parts if first.get(p, i) < i]
        if seen:
            out.add((min(seen), i))
        for p in parts:
            first.setdefault(p, i)
    return out


BATCHES = [
    [(1, "x", None), (2, "y", "z"), (3, "x", "x"), (4, None, None), (5, " ", "")],
    [(6, "z", "new"), (7, "n", None), (8, "n", "m"), (9, "q", None)],
    [(10, "m", "x"), (11, "q", None), (11, "q", None), (12, "r", "s")],
    [(20 + i, "hot", None) for i in range(300)],
]


def test_batch_by_batch_equals_backlog(spark):
    past, found = H.History(spark, 4), set()
    for batch in BATCHES:
        hashed = records(spark, batch)
        found |= {(r["first_rec_id"], r["rec_id"]) for r in past.check(hashed).collect()}
        past.append(hashed)
    assert found == model(BATCHES)
    backlog = records(spark, [r for b in BATCHES for r in b])
    assert {(r["first_rec_id"], r["rec_id"]) for r in H.History(spark, 4).check(backlog).collect()} == model(BATCHES)


def test_history_is_read_by_bucket(spark):
    past = H.History(spark, 8)
    past.append(records(spark, BATCHES[0]))
    rows = spark.table(past.name)
    assert rows.groupBy("hash").count().where("count > 1").count() == 0
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan or "Bucketed" in plan


def test_coverage_and_copies(spark):
    past = H.History(spark, 4)
    past.append(records(spark, [(1, "p", "q"), (2, "r", None)]))
    rows = {r["rec_id"]: (r["first_rec_id"], r["full_copy"], r["n_parts"], r["n_shared"]) for r in past.check(records(spark, [(3, "q", "p"), (4, "r", "new"), (5, "other", None)])).collect()}
    assert rows == {3: (1, True, 2, 2), 4: (2, False, 2, 1)}


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "One  two\n\nThree"), (2, "three\n \nFour"), (3, None), (4, "")], "rec_id bigint, t string")
    rows = H.History(spark, 4).check(H.signatures(df, "rec_id", H.paragraphs(F.col("t")))).collect()
    assert [(r["rec_id"], r["first_rec_id"], r["n_shared"]) for r in rows] == [(2, 1, 1)]


def test_empty(spark):
    past = H.History(spark, 4)
    empty = records(spark, [])
    assert past.check(empty).count() == 0
    past.append(empty)
    assert past.check(records(spark, BATCHES[0])).count() == 1


@pytest.mark.parametrize("name", ["p3_found"])
def test_query(spark, duck, sf_dir, name):
    import __spark_entry__ as entry
    from conftest import same_rows

    same_rows(entry.queries()[name](spark, sf_dir), duck.execute(entry.oracle_sql()[name]))


def test_general_folding(spark):
    """Identities of sites never seen before: short and embedded forms, numbers, named parameters, media files."""
    same = [
        ["https://films.one.example/watch?v=aB3dE6gH9jK", "https://sh.ort/aB3dE6gH9jK?utm_source=x", "http://www.films.one.example/embed/aB3dE6gH9jK"],
        ["https://pics.example/photo/harbour-view-88412345/", "https://cdn.pics.example/88412345/88412345-large.jpg?w=640"],
        ["https://news.co.uk/item/lamp", "http://m.news.co.uk/x?id=lamp&sid=9"],
        ["https://wiki.example/File:Old_pier_7.jpg", "https://up.wiki.example/a/ab/Old%20pier%207.jpg", "https://up.wiki.example/thumb/a/ab/Old_pier_7.jpg/320px-Old_pier_7.jpg"],
    ]
    other = ["https://films.one.example/watch?v=aB3dE6gH9jL", "https://other.example/photo/88412345", "https://news.co.uk/item/lamps", "https://bbc.co.uk/item/lamp", "https://wiki.example/File:Old_pier_8.jpg", "https://films.one.example/list/master.mov", "https://films.one.example/mix/master.mov"]
    found = [set(keys(spark, g)) for g in same]
    assert all(len(s) == 1 and None not in s for s in found), found
    rest = keys(spark, other)
    assert len({*rest} | set.union(*found)) == len(other) + len(same)


def test_history_is_not_shuffled(spark):
    """Only the folded batch moves: above the scan of the history no exchange stands, with broadcasts off as at scale."""
    past = H.History(spark, 8)
    past.append(records(spark, BATCHES[0]))
    hashed = H.written(records(spark, BATCHES[1]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        lines = past.known(hashed)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    scan = next(i for i, line in enumerate(lines) if past.name in line)
    assert "ShuffledHashJoin" in lines[0] and "LeftSemi" in lines[0] and not any("Exchange" in line or "Sort" in line for line in lines[:scan])


def test_named_history_is_opened_again(spark, tmp_path):
    past = H.History(spark, 4, name="media", folder=f"file://{tmp_path}")
    past.append(records(spark, BATCHES[0]))
    again = H.History(spark, 9, name="media", folder=f"file://{tmp_path}")
    assert again.written and again.buckets == 4 and again.rows().count() == past.rows().count()
    found = {(r["first_rec_id"], r["rec_id"]) for r in again.check(records(spark, BATCHES[1])).collect()}
    assert found == {(2, 6), (7, 8)}


def test_rounds_equal_one_backlog(spark):
    rows = [(i, a, b, n) for n, batch in enumerate(BATCHES) for i, a, b in batch]
    df = spark.createDataFrame(rows, "rec_id bigint, a string, b string, batch_no int")
    hashed = H.written(H.signatures(df, "rec_id", F.array("a", "b"), F.col("batch_no")))
    for round_rows in (1, 5, 1_000_000):
        past = H.History(spark, 4)
        assert {(r["first_rec_id"], r["rec_id"]) for r in past.take(hashed, round_rows).collect()} == model(BATCHES), round_rows
        assert past.rows().select("hash").distinct().count() == past.rows().count()
    assert {(r["batch"]) for r in past.rows().collect()} == {0, 1, 2, 3}


def test_hot_hash_is_spread(spark):
    """One address in a third of all records."""
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"u{i}") for i in range(3000)], "rec_id bigint, a string")
    rows = H.History(spark, 4).check(H.signatures(df, "rec_id", F.array("a"))).collect()
    assert len(rows) == 999 and {r["first_rec_id"] for r in rows} == {0}
