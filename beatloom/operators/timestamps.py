"""One unambiguous instant from timestamps of many notations and zones.

Notations are tried in a fixed order; each is one regular expression whose
groups are rewritten into the same nine parts, so a value is matched once and
the arithmetic below is shared. Local times without a zone are resolved by an
as-of join against the zone-offset intervals of the IANA data, exploded by
calendar year: of the intervals that contain the local time, two mean that it
occurs twice, none that it never occurs, one gives the offset.

Defined cases:

* a time that occurs twice is the earlier moment; one that never occurs moves
  forward by the skipped span (the offset before the change applies);
* missing parts of a time are zero, fraction digits beyond microseconds are dropped;
* a bare number of nine digits and more counts from 1970 in the unit that its length tells
  (9 to 11 digits seconds, to 14 milliseconds, to 17 microseconds, more nanoseconds);
  shorter ones are no count: eight digits are a date, fewer a year or a serial number;
* years 0001 to 9999 are read; those before the first and after the last explicit change
  of a zone use the equal year (leap or not, same weekdays) of the table of intervals;
* second 60 and hour 24 denote no existing time here; an abbreviation that several zones
  use (``BST, CST, EST, IST, MST``) has the offset listed below and the kind ``abbreviation``;
* slashes put the month first, dots the day first;
* null, blank, unknown notations, dates that do not exist and local times of
  an unknown zone give null; a null zone means UTC;
* an explicit offset wins over a bracketed zone name, that over the record's zone;
* empty tables give empty results, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The form that needs no normalising.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "BRT": -180, "BRST": -120, "ART": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

# English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ZONE = r"(?:\s*([zZ]|[A-Za-z]{2,5}|[+-]\d{2}:?(?:\d{2})?(?::?\d{2})?))?(?:\s*\[([A-Za-z0-9_+/-]+)\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_NAME = r"([A-Za-z]{3})[a-z]*\.?"

#: Notation, and where its groups stand: year, month, day, hour, minute, second, fraction, am/pm, zone, bracketed zone.
NOTATIONS = (
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:(?:[Tt]|\s+){_TIME}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]+{_NAME}[\s-]+(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?{_NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
)

#: Abbreviations that mean other offsets elsewhere.
SHARED_ABBREVIATIONS = ("BST", "CST", "EST", "IST", "MST")

#: Digits of a count from 1970, and the microseconds of its unit as numerator and denominator.
_EPOCHS = ((r"^-?\d{9,11}(\.\d+)?$", 1_000_000, 1), (r"^-?\d{12,14}(\.\d+)?$", 1_000, 1), (r"^-?\d{15,17}(\.\d+)?$", 1, 1), (r"^-?\d{18,21}(\.\d+)?$", 1, 1_000))

#: Local years with intervals of their own: the zone data knows no change before them, and after its last explicit one (2087) only a yearly rule.
_FIRST_YEAR, _LAST_YEAR = 1840, 2128
#: The last years have every calendar (weekday of the first of January, leap or not) at least once, so that each later year has its equal among them.
_RULE_YEARS = range(_LAST_YEAR - 27, _LAST_YEAR + 1)
_DAY_US = 86_400_000_000


def _whole(c: Column) -> Column:
    return F.when(c != "", c).try_cast("bigint")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the proleptic Gregorian calendar, null if there is no such date."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    year = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(year / 400)
    of_era = year - era * 400
    of_year = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    days = era * 146_097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719_468
    return F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest), days).cast("bigint")


def _parts(value: Column) -> Column:
    """The parts of the first notation that fits, joined by ``|``; the value itself if none does.

    The patterns are anchored and match no ``|``, so a rewritten value meets no later one.
    """
    for pattern, at in NOTATIONS:
        value = F.regexp_replace(value, pattern, "|".join(f"${g}" if g else "" for g in at))
    return value


def _offset_us(zone: Column) -> Column:
    """Microseconds of an explicit offset or abbreviation, null for none or an unknown one."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    seconds = _whole(F.substring(digits, 1, 2)) * 3600 + F.coalesce(_whole(F.substring(digits, 3, 2)), F.lit(0)) * 60 + F.coalesce(_whole(F.substring(digits, 5, 2)), F.lit(0))
    signed = F.when(zone.startswith("-"), -seconds).otherwise(seconds)
    names = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.when(zone.rlike(r"^[+-]"), signed * 1_000_000).otherwise(F.try_element_at(names, F.upper(zone)).cast("bigint") * 60_000_000)


def parsed(df: DataFrame, value: str, zone: str) -> DataFrame:
    """Adds ``_local_us`` (of the written parts), ``_offset_us`` (if written) and ``_zone`` (to resolve with otherwise).

    Each step is a projection of its own, so that a part used several times is computed once.
    """
    part = lambda i: F.get("_parts", F.lit(i))
    rows = df.withColumn("_text", F.regexp_replace(F.col(f"`{value}`"), r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", ""))
    rows = rows.withColumn("_parts", F.split(_parts(F.when(~F.contains("_text", F.lit("|")), F.col("_text"))), r"\|", -1))
    rows = rows.withColumn("_parts", F.when(F.size("_parts") == 10, F.col("_parts")))
    names = F.array(*map(F.lit, MONTHS))
    rows = rows.withColumns(
        {
            "_y": _whole(part(0)),
            "_m": F.coalesce(_whole(part(1)), F.array_position(names, F.lower(part(1)))),
            "_d": _whole(part(2)),
            "_h": F.coalesce(_whole(part(3)), F.lit(0)),
            "_mi": F.coalesce(_whole(part(4)), F.lit(0)),
            "_s": F.coalesce(_whole(part(5)), F.lit(0)),
            "_f": _whole(F.rpad(F.substring(F.coalesce(part(6), F.lit("")), 1, 6), 6, "0")),
            "_half": F.lower(part(7)),
            "_written": F.nullif(part(8), F.lit("")),
            "_named": F.nullif(part(9), F.lit("")),
        }
    ).drop("_parts")
    half, hour = F.col("_half"), F.col("_h")
    rows = rows.withColumns(
        {
            "_h": F.when((half != "") & ~hour.between(1, 12), F.lit(None)).when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour),
            "_day": _days(F.col("_y"), F.col("_m"), F.col("_d")),
            "_offset_us": _offset_us(F.col("_written")),
        }
    ).drop("_half", "_y", "_m", "_d")
    epoch: Column | None = None
    for pattern, times, over in _EPOCHS:
        us = F.floor(F.col("_text").try_cast("decimal(30,6)") * times / over).try_cast("bigint")
        epoch = F.when(F.col("_text").rlike(pattern), us) if epoch is None else epoch.when(F.col("_text").rlike(pattern), us)
    readable = (F.col("_h") < 24) & (F.col("_mi") < 60) & (F.col("_s") < 60) & (F.col("_written").isNull() | F.col("_offset_us").isNotNull())
    rows = rows.withColumns(
        {
            "_local_us": F.when(readable, F.col("_day") * _DAY_US + (F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_s")) * 1_000_000 + F.col("_f")),
            "_zone": F.coalesce(F.col("_named"), _record_zone(zone)),
            "_epoch": epoch,
            "_shared": F.coalesce(F.upper("_written").isin(*SHARED_ABBREVIATIONS), F.lit(False)),
        }
    ).drop("_day", "_h", "_mi", "_s", "_f", "_named", "_written", "_text")
    return rows.withColumns({"_local_us": F.coalesce("_local_us", "_epoch"), "_offset_us": F.when(F.col("_local_us").isNull(), F.lit(0)).otherwise(F.col("_offset_us")).cast("bigint")}).drop("_epoch")


def _record_zone(zone: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(f"`{zone}`")), F.lit("")), F.lit("UTC"))


def _intervals_of(name: str) -> list[tuple]:
    """``(zone, lo_us, hi_us, offset_us)`` in UTC of every constant stretch of one zone's offset.

    Offsets are compared every twelve days, closer than any two changes in the
    IANA data of those years that cancel out, and each change is bisected to the second.
    """
    from zoneinfo import ZoneInfo

    try:
        zone = ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any name the database does not know
        return []
    origin = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def offset(second: int) -> int:
        return int((origin + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    lo = int((datetime(_FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - origin).total_seconds()) - 3 * 86_400
    end = int((datetime(_LAST_YEAR + 1, 1, 3, tzinfo=timezone.utc) - origin).total_seconds())
    out, since, at, current = [], lo, lo, offset(lo)
    while at < end:
        ahead = min(at + 12 * 86_400, end)
        if (later := offset(ahead)) != current:
            a, b = at, ahead
            while b - a > 1:
                middle = (a + b) // 2
                a, b = (middle, b) if offset(middle) == current else (a, middle)
            out.append((name, since * 1_000_000, b * 1_000_000, current * 1_000_000))
            since, at, current = b, b, offset(b)
        else:
            at, current = ahead, later
    out.append((name, since * 1_000_000, end * 1_000_000, current * 1_000_000))
    return out


def zone_intervals(zones: DataFrame) -> DataFrame:
    """Offset intervals of the zones in column ``_zone``, one array for each zone and local year.

    Bounded by the IANA data (about 600 zones, 290 years), whatever the input.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for name in batch["_zone"] if name for r in _intervals_of(name)]
            yield pd.DataFrame(rows, columns=["_zone", "lo", "hi", "off"])

    rows = zones.select("_zone").where("_zone <> ''").distinct().mapInPandas(expand, "_zone string, lo bigint, hi bigint, off bigint")
    local = rows.select("_zone", (F.col("lo") + F.col("off")).alias("lo"), (F.col("hi") + F.col("off")).alias("hi"), "off")
    year = lambda c: F.year(F.timestamp_micros(c))
    per_year = local.withColumn("_year", F.explode(F.sequence(year(F.col("lo")), year(F.col("hi")))))
    return per_year.groupBy("_zone", "_year").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "off"))).alias("_spans"))


def _first_of(y: Column) -> Column:
    return F.make_date(y, F.lit(1), F.lit(1))


def _table_year(y: Column) -> Column:
    """The year of the table of intervals whose rules and weekdays are those of year ``y``."""
    calendars = {date(r, 1, 1).weekday() * 1000 + date(r, 12, 31).timetuple().tm_yday: r for r in _RULE_YEARS}
    length = F.dayofyear(F.make_date(y, F.lit(12), F.lit(31)))
    later = F.try_element_at(F.create_map(*[F.lit(x) for pair in calendars.items() for x in pair]), F.weekday(_first_of(y)) * 1000 + length)
    return F.when(y.between(_FIRST_YEAR, _LAST_YEAR), y).when(y > _LAST_YEAR, later).otherwise(F.lit(_FIRST_YEAR) + 366 - length)


def normalised(df: DataFrame, value: str = "created_at", zone: str = "capture_tz", out: str = "utc_us") -> DataFrame:
    """Adds ``out``, the microseconds since 1970-01-01 UTC, and ``<out>_kind``.

    The kind is ``offset`` (written; ``abbreviation`` if by one that several zones use), ``local``, ``ambiguous`` or ``nonexistent``
    (resolved with a zone), or ``unreadable`` with a null ``out``. Columns of
    these names are replaced, all others pass through whatever their names.
    """
    outs = (out, f"{out}_kind")
    kept = [c for c in df.columns if c not in outs]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(None).alias("none")]).alias("_row"), F.col(f"`{value}`").alias("_value"), F.col(f"`{zone}`").alias("_capture"))
    named = F.regexp_extract("_value", r"\[([A-Za-z0-9_+/-]+)\]\s*$", 1)
    spans = zone_intervals(packed.select(F.explode(F.array(_record_zone("_capture"), named)).alias("_zone")))
    rows = parsed(packed, "_value", "_capture")
    rows = rows.withColumn("_zone", F.when(F.col("_offset_us").isNull() & F.col("_local_us").isNotNull(), F.col("_zone")))
    rows = rows.withColumn("_written_year", F.when(F.col("_zone").isNotNull(), F.year(F.timestamp_micros("_local_us"))))
    rows = rows.withColumn("_year", _table_year(F.col("_written_year")))
    joined = rows.join(F.broadcast(spans), ["_zone", "_year"], "left")
    shift = F.when(F.col("_year") != F.col("_written_year"), F.datediff(_first_of(F.col("_year")), _first_of(F.col("_written_year"))).cast("bigint") * _DAY_US).otherwise(0)
    joined = joined.withColumn("_probe", F.col("_local_us") + shift)
    local, probe = F.col("_local_us"), F.col("_probe")
    hits = F.filter("_spans", lambda s: (s["lo"] <= probe) & (probe < s["hi"]))
    before = F.filter("_spans", lambda s: s["hi"] <= probe)
    offset = F.when(F.size(hits) > 0, F.array_max(F.transform(hits, lambda s: s["off"]))).otherwise(F.element_at(F.when(F.size(before) > 0, before), -1)["off"])
    kind = (
        F.when(local.isNull(), "unreadable")
        .when(F.col("_offset_us").isNotNull(), F.when(F.col("_shared"), "abbreviation").otherwise("offset"))
        .when(F.col("_spans").isNull() | offset.isNull(), "unreadable")
        .when(F.size(hits) > 1, "ambiguous")
        .when(F.size(hits) == 1, "local")
        .otherwise("nonexistent")
    )
    return joined.select(*[F.col("_row")[c].alias(c) for c in kept], (local - F.coalesce(F.col("_offset_us"), offset)).alias(outs[0]), kind.alias(outs[1]))
