import random

from beatloom.llm import canonical as C
from pyspark.sql import functions as F

NAMES = ["Cirucen 6x6", "Cape Culasipol", "AH-62 Samoras", "Misepir Mk4", "Misepir Mk3", "Rufozuk 4C", "Rufozuk 4B", "Exercise Tujurat Anvil", "Birivalos Ducikar Harbour Authority", "Wicibin class icebreaker", "Port Runuwom", "Lake Motisis", "Fort Zojusos"]
CASES = [
    ("cirucen 6X6", 1), ("Ciruecn 6x6", 1), ("6x6 Cirucen", 1), ("Cirucen 6 × 6", 1), ("#the Cirucen_6x6", 1), ("Cirucen 8x8", -1), ("c. culasipol", 2), ("Culasipol Cape", 2), ("Cápé Culasïpol (archive) - wide", 2),
    ("AH62 Samoras", 3), ("Samoras AH-62", 3), ("ah 62 SAMROAS", 3), ("AH-63 Samoras", -1), ("Misepir Mk IV", 4), ("Misepir Mark 4", 4), ("Misepir Mk.  III", 5), ("Misеpir Mk3", 5), ("Rufozuk 4 c", 6), ("Rufozuk 4-B", 7), ("Rufozuk", -1),
    ("exer. tujurat anvil", 8), ("Tujurat Anvil, Exercise", 8), ("exercise: Tujurt Anvil", 8), ("B.D.H.A.", 9), ("bdha", 9), (" B.D.H.A..", 9), ("the-Misepir-Mk3", 5), ("Exercise-Tujurat-Anvil---wide", 8), ("Birivalos Ducikar Har. Auth.", 9), ("Ducikar Harbour Authority, Birivalos", 9), ("Wicibin -class icebreaker", 10),
    ("class icebreaker, Wicibin", 10), ("wicbin cl. icebreaker", 10), ('""Pt. Runuwom""', 11), (" L. Motisis ", 12), ("ft zojusos.", 13), ("ZZ-Pohizim", -1), ("Camp Dihecorer", -1), ("unknown vehicle", -1), ("??", -1), ("x" * 3000, -1),
]


def reference(spark, names=NAMES):
    return spark.createDataFrame([(i + 1, n, "value") for i, n in enumerate(names)], "entity_id bigint, name string, value string")


def run(spark, values, names=NAMES):
    df = spark.createDataFrame([(i, [v, None], "clash") for i, v in enumerate(values)], "rec_id bigint, entities array<string>, value string")
    items = C.exploded(df, "t", "rec_id", F.col("entities"))
    return {(r["row_key"], r["item_pos"]): r["entity_id"] for r in C.mapped_items(items, reference(spark, names)).collect()}


def test_cases(spark):
    got = run(spark, [v for v, _ in CASES])
    assert {CASES[i][0]: e for (i, _), e in got.items()} == dict(CASES)


def test_exact_blank_and_null_are_no_case(spark):
    assert run(spark, [*NAMES, "", "  ", " ", None]) == {}


def test_repeated_values_and_positions(spark):
    df = spark.createDataFrame([(1, [None, "misepir mk3", "misepir mk3", ""]), (2, None), (3, [])], "rec_id bigint, entities array<string>")
    items = C.exploded(df, "t", "rec_id", F.col("entities"))
    assert sorted(tuple(r) for r in C.mapped_items(items, reference(spark)).collect()) == [("t", 1, 1, 5), ("t", 1, 2, 5)]


def test_ties_are_reported(spark):
    assert run(spark, ["Port Marun"], ["Port Marux", "Port Maruz"]) == {(0, 0): -1}


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, ["Misepir"], []) == {(0, 0): -1}


def test_pigeonhole_finds_what_brute_force_finds(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(11)
    names = list({"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 14))) for _ in range(40)})
    values = []
    for _ in range(150):
        v = list(rng.choice(names))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(v) + 1)
            v[at : at + rng.randrange(2)] = rng.choice(["", "a", "d"])
        values.append("".join(v) or "q")
    values = [v for v in dict.fromkeys(values) if v not in names]
    got = run(spark, values, names)
    for i, v in enumerate(values):
        near = sorted((edits(v, n), k + 1) for k, n in enumerate(names) if edits(v, n) <= min(C.EDITS, len(n) // C.LETTERS_AN_EDIT))
        want = near[0][1] if near and (len(near) == 1 or near[0][0] < near[1][0]) else -1
        assert got[(i, 0)] == want, (v, near)
