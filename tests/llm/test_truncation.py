import random

from beatloom.llm import truncation as U

SUBJECTS = ["The old harbour office", "A narrow channel", "Nobody at the pier", "Every engineer of the yard", "The second survey team"]
VERBS = ["counted the lamps of", "left the quiet port near", "studied the long route to", "found the sealed crate under", "has mapped the caves below"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(['Zolburn', 'Marwick', 'Tirholm', 'Venrick'])} in {rng.randrange(1900, 2020)}."


def corpus():
    rng = random.Random(6)
    rows, cut = [], set()
    for i in range(1200):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 6)))
        source = ("chars", "dots", "bytes", "free")[i % 4]
        if source == "chars" and len(text) > 100:
            text = text[:100]
        elif source == "dots" and len(text) > 80:
            text = text[:79] + "…"
        elif source == "bytes":
            text = text.replace("office", "öffice")
            data = text.encode()
            text = data[:120].decode(errors="ignore")
        whole = text.rstrip().endswith(".")
        rows.append((i, source, text))
        if not whole:
            cut.add(i)
    return rows, cut


def run(spark, rows):
    df = spark.createDataFrame([(k, s, t, "x", True) for k, s, t in rows], "k bigint, s string, t string, body string, cut boolean")
    return U.texts(df, "t", "k", "s", "t")


def found(spark, rows):
    return {r["row_key"] for r in U.judged(run(spark, rows)).where("cut").collect()}


def test_limits_and_cuts(spark):
    rows, cut = corpus()
    assert found(spark, rows) == cut
    limits = {(r["source"], r["encoding"]): r["at_length"] for r in U.limits(run(spark, rows)).collect()}
    assert limits[("chars", "chars")] == 100 and limits[("dots", "chars")] == 80 and limits[("bytes", "utf8")] == 120
    assert not any(s == "free" for s, _ in limits)
    rates = {r["source"]: (r["n_texts"], r["n_cut"]) for r in U.rates(run(spark, rows)).collect()}
    assert rates["free"] == (300, 0) and sum(n for _, n in rates.values()) == len(cut)


def test_endings(spark):
    rows, _ = corpus()
    lists = [(5000 + i, "lists", ", ".join(random.Random(i).sample(["aerial", "night trial", "static display", "Zolburn Bay", "open water", "formation pass"], 6))) for i in range(80)]
    cases = {
        9001: ("Coming up next…", False), 9002: ("And then the lights went out...", False), 9003: ("Haxmar Point", False), 9004: ("Imenespela", False), 9005: ("ZOLBURN | night trial / open water", False),
        9006: ("The old harbour office counted the la", True), 9007: ('"The pier of the yard closed in 1988."', False), 9008: ('"The pier of the yard closed in 19', True), 9009: ("aerial, open water, static displ", True), 9010: ("aerial, open water, static display", False),
        9011: ("通往港口的道路被封闭了三十二次，物资只能从", True), 9012: ("通往港口的道路被封闭了三十二次。", False), 9013: (None, False), 9014: ("", False), 9015: ("   ", False), 9016: ("Autumn storms ", True), 9017: ("Is it so?", False), 9018: ("x " * 40_000, True),
    }
    got = found(spark, rows + lists + [(8000, "free", "The road to Haxmar Point was closed.")] + [(k, "free", t) for k, (t, _) in cases.items()])
    assert {k: k in got for k in cases} == {k: want for k, (_, want) in cases.items()}
    assert not {k for k, _, _ in lists} & got


def test_repeated_rows_and_null_source(spark):
    rows = [(1, None, "The old harbour office counted the"), (1, None, "The old harbour office counted the"), (2, None, "Whole sentence here.")]
    assert [r["row_key"] for r in U.judged(run(spark, rows)).where("cut").collect()] == [1, 1]


def test_empty(spark):
    assert found(spark, []) == set() and U.limits(run(spark, [])).count() == 0 and U.rates(run(spark, [])).count() == 0


def test_encodings(spark):
    text = 'a"<é&💥\n'
    df = spark.createDataFrame([(text,)], "t string")
    from pyspark.sql import functions as F

    row = df.select(*[c.alias(n) for n, c in U.encodings(F.col("t")).items()]).first().asDict()
    import html
    import json

    assert row == {"chars": len(text), "utf8": len(text.encode()), "utf16": len(text.encode("utf-16-le")) // 2, "html": len(html.escape(text)), "json": len(json.dumps(text)) - 2, "crlf": len(text) + 1}


def test_complete_phrases_are_not_cut(spark):
    """Phrases without a stop, alone in their sources and at no limit, beside a corpus of sentences."""
    rows, cut = corpus()
    phrases = ["Convoy near the bay", "Sunrise over Risven harbour", "Night trial at dawn", "Boats of the second team", "Three lamps by an old pier", "Ein Boot am Morgen", "Vue du port au matin"]
    got = found(spark, rows + [(7000 + i, f"source {i}", p) for i, p in enumerate(phrases)])
    assert got == cut


def test_cut_away_from_any_limit(spark):
    """Endings alone tell: a broken word, a dangling article, an unfinished second sentence, the opening of known sentences."""
    rows, cut = corpus()
    ends = ["Every engineer of the yard counted the lam", "Lanterns were sent to the", "The pier closed in 1988. Later the crew", "Nobody at the pier found the sealed crate under Zolburn"]
    got = found(spark, rows + [(7000 + i, f"source {i}", p) for i, p in enumerate(ends)])
    assert got == cut | {7000, 7001, 7002, 7003}


def test_small_source_has_its_limit(spark):
    """Six texts at one length are a limit in a small source as in a large one; texts of all lengths are none."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(99)) + "…" for _ in range(6)] + [sentence(rng)[: 20 + 3 * i] for i in range(12)]
    limits = U.limits(run(spark, [(i, "small", t) for i, t in enumerate(texts)])).where("encoding = 'chars'").collect()
    assert [(r["at_length"], r["n_texts"]) for r in limits] == [(100, 6)]


def test_rates_and_limits_against_brute_force(spark):
    import math
    from collections import Counter, defaultdict

    rows, cut = corpus()
    rates = {r["source"]: (r["n_texts"], r["n_cut"], r["share_cut"]) for r in U.rates(run(spark, rows)).collect()}
    for source in {s for _, s, _ in rows}:
        own = [k for k, s, t in rows if s == source and t.strip()]
        assert rates[source] == (len(own), len(cut.intersection(own)), round(len(cut.intersection(own)) / len(own), 6))
    lengths = defaultdict(set)
    for _, s, t in rows:
        if not t.rstrip().endswith("."):
            lengths[s].add(t)
    want = set()
    for s, texts in lengths.items():
        counts = Counter(len(t.encode()) for t in texts)
        for length, n in counts.items():
            usual = max(sum(counts[k] for k in range(length - U.NEIGHBOURS, length + U.NEIGHBOURS + 1) if k != length) / (2 * U.NEIGHBOURS), 1 / U.NEIGHBOURS)
            if n >= U.LIMIT_TIMES * usual and n * math.log(n / usual) - (n - usual) >= U.SURPRISE:
                want.add((s, length, n))
    assert {(r["source"], r["at_length"], r["n_texts"]) for r in U.limits(run(spark, rows)).where("encoding = 'utf8'").collect()} == want
