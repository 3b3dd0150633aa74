"""Checking new batches for duplicates against everything already accepted.

The history is one table of 64-bit hashes, bucketed by hash in the shared
folder: for each distinct whole content and each distinct part (paragraph,
address) the first record that carried it. A new batch is hashed and folded to
one row for each hash; a semi-join, bucket by bucket, tells which of its hashes
the history knows. Only the folded batch is shuffled, into the buckets of the
history; the history is streamed through, neither shuffled nor sorted nor
aggregated. Then the batch's own new hashes are appended.

A named history outlives the session: opening it again finds the same buckets.
Several batches may be checked in one round: records are compared with those of
smaller id, so that the result is the one of taking the batches in turn.

A hash that a third of all records share is folded on the map side before any
shuffle, and its rows are spread over many tasks (``operators.skew``).

Defined cases: records without any part are no case; a part repeated within a
record counts once; null and blank parts do not count; the same record checked
twice matches itself only under a smaller id; an empty batch or history gives
an empty result and appends nothing; other columns of any name do not matter.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.operators.skew import joined_unique
from beatloom.session import exists, fresh_path, hadoop_path, shared_dir
from beatloom.session import written as stored

#: Kinds of hash: of a record's whole normalised content, and of each of its parts.
WHOLE, PART = "whole", "part"
#: Records of one round at most, unless a single batch has more.
ROUND_ROWS = 1_000_000


def signatures(records: DataFrame, record_id: str, parts: Column, batch: Column | None = None) -> DataFrame:
    """``rec_id, batch, kind, hash`` of the normalised parts of each record (an array column); the kind is part of what is hashed."""
    kept = F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.trim(p) != "")))
    rows = records.select(F.col(f"`{record_id}`").cast("bigint").alias("rec_id"), (F.lit(0) if batch is None else batch).cast("bigint").alias("batch"), kept.alias("parts"))
    hashes = F.concat(
        F.array(F.struct(F.lit(WHOLE).alias("kind"), F.xxhash64(F.lit(WHOLE), F.array_join("parts", "\x1f")).alias("hash"))),
        F.transform("parts", lambda p: F.struct(F.lit(PART).alias("kind"), F.xxhash64(F.lit(PART), p).alias("hash"))),
    )
    # the outer explode keeps its test for emptiness above it, where the parts are there already
    return rows.select("rec_id", "batch", F.explode_outer(F.when(F.size("parts") > 0, hashes)).alias("s")).select("rec_id", "batch", "s.kind", "s.hash").where("hash is not null")


def written(hashed: DataFrame) -> DataFrame:
    """The signatures as a table in the shared folder, for a batch that is both checked and appended."""
    return stored(hashed, "signatures")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, folded in case and white space."""
    return F.transform(F.split(text, r"\n\s*\n"), lambda p: F.lower(F.trim(F.regexp_replace(p, r"\s+", " "))))


class History:
    """The hashes of all accepted records, in one bucketed table.

    With a ``name`` the table lies in ``folder`` (by default beside the
    checkpoints) and stays there; opened again, in whatever session, it keeps its
    number of buckets. Without one it is deleted when the application ends.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, name: str | None = None, folder: str | None = None):
        self.spark = spark
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if name is None:
            self.path = fresh_path(spark, "history")
        else:
            root = f"{(folder or shared_dir(spark)).rstrip('/')}/{name}"
            if exists(spark, f"{root}/buckets-*"):
                jvm_path, system = hadoop_path(spark, f"{root}/buckets-*")
                self.buckets = int(re.search(r"buckets-(\d+)$", system.globStatus(jvm_path)[0].getPath().toString()).group(1))
            self.path = f"{root}/buckets-{self.buckets}"
        self.name = f"history_{uuid.uuid4().hex}"
        self.written = exists(spark, f"{self.path}/*.parquet")
        if self.written:
            self._register()

    def _register(self) -> None:
        self.spark.sql(f"CREATE TABLE {self.name} (hash BIGINT, rec_id BIGINT, batch BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        """``hash, rec_id, batch`` of everything accepted so far, one row for each hash."""
        return self.spark.table(self.name)

    def known(self, hashed: DataFrame) -> DataFrame | None:
        """The rows of the history whose hash occurs in a batch: a semi-join of each bucket with the folded batch, which is its small side."""
        if not self.written:
            return None
        return self.rows().join(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).select("hash").hint("shuffle_hash"), "hash", "left_semi")

    def folded(self, hashed: DataFrame) -> DataFrame:
        """One row for each hash of a batch: its first record in the batch, and in the history; written once for checking and appending."""
        own = hashed.groupBy("hash").agg(F.min("rec_id").alias("rec_id"), F.min("batch").alias("batch"), F.count(F.lit(1)).alias("n_own"))
        if (past := self.known(hashed)) is None:
            return stored(own.withColumn("past_first", F.lit(None).cast("bigint")), "folded")
        return stored(own.join(past.select("hash", F.col("rec_id").alias("past_first")), "hash", "left"), "folded")

    def check(self, hashed: DataFrame, folded: DataFrame | None = None) -> DataFrame:
        """``rec_id, first_rec_id, full_copy, n_parts, n_shared`` of the records that repeat an earlier one.

        ``n_shared`` of the record's ``n_parts`` parts occur in earlier records;
        ``first_rec_id`` is the smallest of those, ``full_copy`` tells whether
        one of them has exactly the same parts.
        """
        folded = self.folded(hashed) if folded is None else folded
        firsts = folded.select("hash", F.least("rec_id", "past_first").alias("first"), "n_own")
        met = joined_unique(hashed.select("rec_id", "kind", "hash"), firsts, "hash", "n_own")
        earlier = F.when(F.col("first") < F.col("rec_id"), F.col("first"))
        per_record = met.groupBy("rec_id").agg(
            F.min(earlier).alias("first_rec_id"),
            F.max((F.col("kind") == WHOLE) & earlier.isNotNull()).alias("full_copy"),
            F.count(F.when(F.col("kind") == PART, 1)).alias("n_parts"),
            F.count(F.when((F.col("kind") == PART) & earlier.isNotNull(), 1)).alias("n_shared"),
        )
        return per_record.where("first_rec_id is not null")

    def append(self, hashed: DataFrame, folded: DataFrame | None = None) -> None:
        """Adds the hashes that the history lacks, written bucket by bucket."""
        folded = self.folded(hashed) if folded is None else folded
        if not self.written:
            self._register()
            self.written = True
        folded.where("past_first is null").select("hash", "rec_id", "batch").repartition(self.buckets, "hash").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def take(self, hashed: DataFrame, round_rows: int = ROUND_ROWS) -> DataFrame:
        """Checks and then appends the batches of written signatures in turn, consecutive small ones in one round; the rows of all checks.

        The driver sees one number for each batch, never a record.
        """
        sizes = hashed.where(F.col("kind") == WHOLE).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect()
        rounds: list[list] = [[None, None, 0]]
        for batch, n in sizes:
            if rounds[-1][2] and rounds[-1][2] + n > round_rows:
                rounds.append([batch, batch, n])
            else:
                rounds[-1] = [batch if rounds[-1][0] is None else rounds[-1][0], batch, rounds[-1][2] + n]
        found = []
        for lo, hi, _ in rounds:
            of_round = hashed.where(F.col("batch").between(lo, hi)) if len(rounds) > 1 else hashed
            folded = self.folded(of_round)
            found.append(self.check(of_round, folded))
            self.append(of_round, folded)
        return reduce(DataFrame.unionByName, found)


# ---------------------------------------------------------------- addresses

#: Parameters that tell a visit or a click, by public convention; never the identity of a page.
VISITS = r"utm_[a-z]+|sid|sessionid|phpsessid|jsessionid|fbclid|gclid|msclkid|dclid"
#: Parameters and folders whose value or next piece names the item, by public convention.
NAMED, NAMED_AFTER = r"(?:^|&)(?:id|v|vid|asset|item)=([^&]+)", r"(?:^|/)(?:embed|v|vi|shorts|live|item|media)/([^/]+)"
#: A media file; it is an identity if its name has a digit or several words.
FILE = r"(?i)(?:^|/)((?:[^/]*\d|[^/]+[ _-])[^/]*\.(?:jpe?g|png|gif|webp|tiff?|svg|bmp|mp4|m4v|mov|webm|mkv|avi|ogv|mp3|wav|ogg|pdf))(?=/|$)"
#: A token of mixed letters that is an identity anywhere; a number or hexadecimal token and a mixed token that are one within their site.
OPAQUE = r"(?:^|/)((?=[^/]*[a-z0-9][A-Z]|[^/]*[A-Z]{2}[a-z])[A-Za-z0-9]{11,}|(?=[^/]*[a-z][A-Z])[A-Za-z0-9_-]{11,})(?=/|$)"
NUMBER = r"(?<![^/-])(\d{6,}|[0-9a-f]{8,})(?=[/-]|$|\.[A-Za-z0-9]{2,4}(?:/|$))"
MIXED = r"(?:^|/)((?=[^/]*\d)(?=[^/]*[A-Za-z])[A-Za-z0-9]{8,})(?=/|$)"


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def with_address_key(df: DataFrame, address: str, out: str) -> DataFrame:
    """Adds ``out``, the item that an address leads to, whatever its spelling; null for none.

    No site is known by name. An address is folded (scheme, port, letter case of
    the host, percent signs, doubled slashes, fragment and parameters of visits do
    not count) and its strongest identity is taken: a token of mixed letters of
    eleven characters and more, which means the same on every host (short
    addresses, embedding pages); else, within the site (the registered domain, so
    that mirrors and mobile hosts agree), the longest number of six digits or
    hexadecimal token of eight, what stands where items are named by convention
    (``?id=``, ``/embed/``), a mixed token, or the name of a media file without the
    prefix of its size; else the whole folded address.
    """
    rows = df.withColumn("__bare", F.regexp_replace(F.regexp_replace(F.col(f"`{address}`"), r"^[\s\x{A0}]*(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?|#.*$", ""), r"[\s\x{A0}]+$", ""))
    rows = rows.withColumns(
        {
            "__host": F.regexp_replace(F.lower(F.regexp_extract("__bare", r"^([^/?]*)", 1)), r"^[^@]*@|:\d+$|\.$", ""),
            "__path": F.regexp_replace(_decoded(F.regexp_extract("__bare", r"^[^/?]*([^?]*)", 1)), r"/+", "/"),
            "__query": F.regexp_replace(F.regexp_extract("__bare", r"\?(.*)$", 1), rf"(?i)(?:^|(?<=&))(?:{VISITS})(?:=[^&]*)?(?:&|$)|&(?=&|$)", ""),
        }
    ).drop("__bare")
    rows = rows.withColumn("__text", F.when(F.col("__query") == "", F.col("__path")).otherwise(F.concat("__path", _decoded(F.regexp_replace("__query", r"(?:^|&)[^=&]*=?", "/")))))
    part = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    two = F.substring_index("__host", ".", -2)
    site = F.when(two.rlike(r"^(?:com?|org|net|gov|ac|edu)\.[a-z]{2}$"), F.substring_index("__host", ".", -3)).otherwise(two)
    within = lambda c: F.concat(site, F.lit(" "), c)
    longest = F.array_max(F.transform(F.regexp_extract_all("__text", F.lit(NUMBER), F.lit(1)), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    file = F.regexp_replace(F.regexp_replace(part("__text", FILE), r"^.*:|^\d+px-", ""), r"[ _]+", "_")
    plain = F.concat(
        F.regexp_replace("__host", r"^(?:www|m|amp|mobile)\.", ""), F.regexp_replace("__path", r"/$", ""),
        F.when(F.col("__query") != "", F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(_decoded(F.col("__query")), "&")), "&"))).otherwise(F.lit("")),
    )
    key = F.coalesce(part("__text", OPAQUE), within(longest), within(_decoded(part("__query", NAMED))), within(part("__path", NAMED_AFTER)), within(part("__text", MIXED)), within(file), plain)
    return rows.withColumn(out, F.when(F.col("__host") != "", key)).drop("__host", "__path", "__query", "__text")
