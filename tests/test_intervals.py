import random

from beatloom.operators import intervals as I
from pyspark.sql import functions as F

SCHEMA = "who string, a double, b double, lo bigint, bucket string"


def rows_of(spark, data):
    df = spark.createDataFrame([(w, a, b, 7, "clash") for w, a, b in data], SCHEMA)
    return I.interval_rows(df, "t", "who", F.col("a"), F.col("b"))


def brute(data):
    holes, covered = set(), set()
    by = {}
    for who, a, b in data:
        if who is None or a is None or b is None or a != a or b != b or abs(a) > 9e12 or abs(b) > 9e12:
            continue
        lo, hi = round_ms(a), round_ms(b)
        if hi > lo:
            by.setdefault(who, []).append((lo, hi))
    for who, spans in by.items():
        spans.sort()
        begin, reach = spans[0]
        for lo, hi in spans[1:]:
            if lo > reach:
                holes.add((who, reach, lo))
                covered.add((who, begin, reach))
                begin = lo
            reach = max(reach, hi)
        covered.add((who, begin, reach))
    return holes, covered


def round_ms(x):
    import math

    y = x * 1000
    return math.floor(y + 0.5) if y >= 0 else -math.floor(-y + 0.5)


def found(df):
    return {tuple(r)[1:] for r in df.collect()}


def check(spark, data, **options):
    rows = rows_of(spark, data)
    holes, covered = brute(data)
    gaps, periods = I.gaps(rows, **options), I.periods(rows, **options)
    assert found(gaps) == holes and gaps.count() == len(holes)
    assert found(periods) == covered and periods.count() == len(covered)


def test_cases(spark):
    nan = float("nan")
    check(
        spark,
        [
            ("touch", 0.0, 1.0), ("touch", 1.0, 2.0), ("nest", 0.0, 10.0), ("nest", 2.0, 3.0), ("nest", 12.0, 13.0),
            ("again", 1.0, 2.0), ("again", 1.0, 2.0), ("again", 5.0, 6.0), ("noise", 3.7299999997, 4.0), ("noise", 4.0000000002, 5.0),
            ("bad", None, 1.0), ("bad", 1.0, None), ("bad", 3.0, 2.0), ("bad", 2.0, 2.0), ("bad", nan, 3.0), ("bad", 1.0, float("inf")), (None, 0.0, 1.0),
            ("neg", -5.5, -1.25), ("neg", 2.0, 3.0), ("long", 0.0, 20000.0), ("long", 1.0, 2.0), ("long", 30000.0, 30001.0),
        ],
    )


def test_random_with_hot_owner(spark):
    rng = random.Random(3)
    data = []
    for _ in range(1500):
        who = "hot" if rng.random() < 0.4 else f"o{rng.randrange(20)}"
        a = round(rng.uniform(0, 400), 2)
        data.append((who, a, round(a + rng.choice([0.1, 0.5, 2, 40, -1, 0]), 2)))
    check(spark, data, bucket_ms=10_000)
    check(spark, data)


def test_bucket_width_does_not_matter(spark):
    data = [("x", 0.0, 100.0), ("x", 50.0, 51.0), ("x", 101.0, 102.0), ("x", 250.0, 260.0)]
    for width in (1, 1000, 7000, 10**9):
        check(spark, data, bucket_ms=width)


def test_empty(spark):
    check(spark, [])
