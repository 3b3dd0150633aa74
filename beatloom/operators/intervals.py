"""Merging overlapping intervals per owner and listing the holes.

The sessions come from Spark's own ``session_window`` with a row-specific
duration. An owner may hold a third of all rows, so a session is first built
within fixed time buckets of an owner; one summary row per bucket then carries
the reach of all earlier buckets forward. No task ever holds the rows of a
whole owner: within a bucket there are at most as many distinct periods as the
bucket has milliseconds, and repeated starts are folded before the shuffle. The
sessions are written to the shared folder while a query is built.

Defined cases:

* a null owner, a null or NaN bound, or an interval that is empty or reversed
  after rounding to milliseconds does not count;
* repeated rows count once; touching intervals leave no hole;
* an owner without a counting interval has no period and no hole;
* an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.session import written

#: Width of a time bucket. A parameter of the plan only: results do not depend on it.
BUCKET_MS = 3_600_000


def seconds_to_ms(seconds: Column) -> Column:
    """Nearest millisecond of a time in seconds; NaN and infinities become null."""
    finite = F.abs(seconds) < F.lit(9.0e12)
    return F.when(finite, F.round(seconds * 1000)).cast("bigint")


def interval_rows(df: DataFrame, source: str, owner: str, start: Column, end: Column) -> DataFrame:
    """Rows ``src_table, owner_id, lo, hi`` of the intervals that count."""
    lo, hi = seconds_to_ms(start), seconds_to_ms(end)
    rows = df.select(F.lit(source).alias("src_table"), F.col(f"`{owner}`").cast("string").alias("owner_id"), lo.alias("lo"), hi.alias("hi"))
    return rows.where(F.col("owner_id").isNotNull() & (F.col("hi") > F.col("lo")))


def _sessions(rows: DataFrame, bucket_ms: int) -> DataFrame:
    """Merged sessions within each bucket of each owner, by ``session_window``."""
    folded = rows.groupBy("src_table", "owner_id", "lo").agg(F.max("hi").alias("hi"))
    length = F.make_interval(secs=((F.col("hi") - F.col("lo")) / F.lit(1000)).cast("decimal(18,6)"))
    session = F.session_window(F.timestamp_millis("lo"), length)
    merged = folded.withColumn("bucket", F.floor(F.col("lo") / F.lit(bucket_ms))).groupBy("src_table", "owner_id", "bucket", session.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return merged.select("src_table", "owner_id", "bucket", F.unix_millis("w.start").alias("lo"), F.unix_millis("w.end").alias("hi"))


def _linked(rows: DataFrame, bucket_ms: int) -> DataFrame:
    """Sessions with ``reach`` (latest end so far), ``before`` (reach of all earlier ones) and ``next_lo``."""
    sessions = written(_sessions(rows, bucket_ms), "sessions")  # read twice below, while the tables are read once
    key = ["src_table", "owner_id", "bucket"]
    by_owner = Window.partitionBy("src_table", "owner_id").orderBy("bucket")
    buckets = (
        sessions.groupBy(*key)
        .agg(F.min("lo").alias("first_lo"), F.max("hi").alias("last_hi"))
        .select(*key, F.max("last_hi").over(by_owner.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.lead("first_lo").over(by_owner).alias("next_first"))
    )
    inside = Window.partitionBy(*key).orderBy("lo")
    return sessions.join(buckets, key).select(
        *key,
        "lo",
        F.greatest("carried", F.max("hi").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("reach"),
        F.greatest("carried", F.max("hi").over(inside.rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
        F.coalesce(F.lead("lo").over(inside), F.col("next_first")).alias("next_lo"),
    )


def gaps(rows: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Every maximal uncovered stretch between an owner's first start and last end.

    ``rows`` has ``src_table, owner_id, lo, hi`` as from :func:`interval_rows`.
    """
    return _linked(rows, bucket_ms).where(F.col("next_lo") > F.col("reach")).select("src_table", "owner_id", F.col("reach").alias("gap_start_ms"), F.col("next_lo").alias("gap_end_ms"))


def periods(rows: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """The continuous covered periods of each owner, touching ones joined."""
    key = ["src_table", "owner_id", "bucket"]
    marked = _linked(rows, bucket_ms).select(
        *key,
        "lo",
        (F.col("before").isNull() | (F.col("lo") > F.col("before"))).alias("opens"),
        F.when(F.col("next_lo").isNull() | (F.col("next_lo") > F.col("reach")), F.col("reach")).alias("closed_at"),
    )
    by_owner = Window.partitionBy("src_table", "owner_id").orderBy("bucket")
    later = marked.groupBy(*key).agg(F.min("closed_at").alias("first_close")).select(*key, F.min("first_close").over(by_owner.rowsBetween(1, Window.unboundedFollowing)).alias("later_close"))
    inside = Window.partitionBy(*key).orderBy("lo").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ends = marked.withColumn("here", F.min("closed_at").over(inside)).where("opens").join(later, key)
    return ends.select("src_table", "owner_id", F.col("lo").alias("period_start_ms"), F.coalesce("here", "later_close").alias("period_end_ms"))
