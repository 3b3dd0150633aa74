from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from beatloom.operators import timestamps as TS

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*parts, offset=0, micro=0):
    return int((datetime(*parts, tzinfo=timezone.utc) - EPOCH).total_seconds()) * 1_000_000 - offset * 60_000_000 + micro


CASES = [
    ("2021-08-03T22:36:44Z", "America/Sao_Paulo", us(2021, 8, 3, 22, 36, 44), "offset"),
    ("\t2021-08-03T22:36:44.5Z", None, us(2021, 8, 3, 22, 36, 44, micro=500_000), "offset"),
    ("20210730T205713Z", "Asia/Tokyo", us(2021, 7, 30, 20, 57, 13), "offset"),
    ("Tue, 08 Nov 2022 19:42:05 -0300", "Asia/Tokyo", us(2022, 11, 8, 19, 42, 5, offset=-180), "offset"),
    ("11 Aug 2022 15:45:44 WEST", "Europe/Lisbon", us(2022, 8, 11, 15, 45, 44, offset=60), "offset"),
    ("21-Oct-2022 09:27:51 +05:30", None, us(2022, 10, 21, 9, 27, 51, offset=330), "offset"),
    ("2023-12-12T11:57:08.339240719+09:00", None, us(2023, 12, 12, 11, 57, 8, offset=540, micro=339_240), "offset"),
    ("2025-04-05T03:02:58+09:00[Asia/Tokyo]", "UTC", us(2025, 4, 5, 3, 2, 58, offset=540), "offset"),
    ("2025-04-05T03:02:58[Asia/Tokyo]", "UTC", us(2025, 4, 5, 3, 2, 58, offset=540), "local"),
    ("08/04/2021 09:00 AM", "Asia/Tokyo", us(2021, 8, 4, 9, 0, offset=540), "local"),
    ("08/04/2021 12:05 AM", None, us(2021, 8, 4, 0, 5), "local"),
    ("08/04/2021 12:05 PM", None, us(2021, 8, 4, 12, 5), "local"),
    ("18.04.2021 12:04", "Europe/Berlin", us(2021, 4, 18, 12, 4, offset=120), "local"),
    ("2022-11-19", "America/Sao_Paulo", us(2022, 11, 19, offset=-180), "local"),
    ("2024-02-29 23:59", None, us(2024, 2, 29, 23, 59), "local"),
    ("1615708318698", "America/New_York", 1615708318698 * 1000, "offset"),
    ("1745978873", "America/Sao_Paulo", 1745978873 * 1_000_000, "offset"),
    ("1695425164963743", "Australia/Sydney", 1695425164963743, "offset"),
    ("2024-11-03 01:51:49.335", "America/New_York", us(2024, 11, 3, 1, 51, 49, offset=-240, micro=335_000), "ambiguous"),
    ("2024-03-31 01:02:38.274", "Europe/Lisbon", us(2024, 3, 31, 1, 2, 38, micro=274_000), "nonexistent"),
    ("03/26/2023 02:23 AM", "Europe/Berlin", us(2023, 3, 26, 2, 23, offset=60), "nonexistent"),
]
UNREADABLE = [None, "", "  ", "n/a", "yesterday", "2023-13-05 08:00", "2024-02-31T10:00:00", "2023-02-29", "0000-00-00 00:00:00", "2021-01-01T25:00:00", "13/13/2021 10:00 AM", "01/02/2021 13:00 PM", "2021-01-01 10:00:00 XYZ", "x" * 50_000]


def run(spark, rows):
    df = spark.createDataFrame([(i, v, z, "kept", "clash") for i, (v, z) in enumerate(rows)], "i int, created_at string, capture_tz string, _zone string, utc_us string")
    out = TS.normalised(df)
    assert out.columns == ["i", "created_at", "capture_tz", "_zone", "utc_us", "utc_us_kind"]
    got = out.collect()
    assert all(r["_zone"] == "kept" for r in got)
    return {r["i"]: (r["utc_us"], r["utc_us_kind"]) for r in got}


def test_notations(spark):
    got = run(spark, [(c[0], c[1]) for c in CASES])
    for i, (value, zone, want, kind) in enumerate(CASES):
        assert got[i] == (want, kind), (value, zone)


def test_unreadable(spark):
    got = run(spark, [(v, "UTC") for v in UNREADABLE] + [("2021-01-01T10:00:00", "Mars/Base")])
    assert set(got.values()) == {(None, "unreadable")}


def test_repeated_rows_and_blank_zone(spark):
    got = run(spark, [("2021-01-01", " ")] * 5)
    assert list(got.values()) == [(us(2021, 1, 1), "local")] * 5


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata", "Australia/Lord_Howe"])
def test_against_zone_data(spark, zone):
    """Every half hour around each change of two decades, against the standard library."""
    rows, want = [], []
    for _, lo, hi, off in [r for r in TS._intervals_of(zone) if us(2004, 1, 1) < r[1] < us(2026, 1, 1)]:
        for step in range(-6, 7):
            local = (EPOCH + timedelta(microseconds=lo + off) + timedelta(minutes=30 * step)).replace(tzinfo=None)
            rows.append((local.isoformat(), zone))
            aware = local.replace(tzinfo=ZoneInfo(zone), fold=0)
            want.append(int(round((aware - EPOCH).total_seconds() * 1_000_000)))
    got = run(spark, rows)
    assert [got[i][0] for i in range(len(rows))] == want


YEARS = [("1899-07-01 12:00:00", "Europe/Paris"), ("1839-01-01", "America/New_York"), ("0804-02-29 10:00", "Asia/Tokyo"), ("1844-12-31 12:00", "Asia/Manila"), ("2101-07-01 12:00:00", "Europe/Paris"), ("2400-02-29 12:00", "America/New_York"), ("9998-12-31 23:30", "Australia/Sydney"), ("2127-03-09 02:30", "America/New_York")]


def test_years_beyond_the_zone_data(spark):
    got = run(spark, YEARS)
    for i, (value, zone) in enumerate(YEARS):
        local = datetime.fromisoformat(value).replace(tzinfo=ZoneInfo(zone), fold=0)
        assert got[i][0] == (local - EPOCH) // timedelta(microseconds=1), (value, zone)
    assert got[7][1] == "nonexistent"


def test_every_later_year_has_its_equal(spark):
    """Days around the changes of every tenth year to 9990, against the standard library."""
    rows = [(f"{y:04d}-{m:02d}-{d:02d} 02:15", zone) for zone in ("America/New_York", "Australia/Sydney") for y in range(2090, 9991, 79) for m, d in ((1, 1), (3, 9), (3, 14), (4, 2), (4, 7), (10, 1), (10, 7), (11, 1), (11, 7), (12, 31))]
    got = run(spark, rows)
    for i, (value, zone) in enumerate(rows):
        assert got[i][0] == (datetime.fromisoformat(value).replace(tzinfo=ZoneInfo(zone), fold=0) - EPOCH) // timedelta(microseconds=1), (value, zone)


def test_counts_of_any_length(spark):
    counts = {"123456789": 123456789000000, "99999999999": 99999999999000000, "-86400000000": -86400000000000000, "100000000000.5": 100000000000500, "12345678901234": 12345678901234000, "16954251649637430": 16954251649637430, "1695425164963743123": 1695425164963743, "169542516496.5": 169542516496500}
    got = run(spark, [(v, "UTC") for v in counts])
    assert [got[i][0] for i in range(len(counts))] == list(counts.values())
    assert set(run(spark, [("2021", None), ("7", None), ("1234567", None)]).values()) == {(None, "unreadable")}


def test_shared_abbreviations_are_marked(spark):
    got = run(spark, [("21-Oct-2022 09:27:51 IST", None), ("21-Oct-2022 09:27:51 JST", None)])
    assert got == {0: (us(2022, 10, 21, 9, 27, 51, offset=330), "abbreviation"), 1: (us(2022, 10, 21, 9, 27, 51, offset=540), "offset")}
