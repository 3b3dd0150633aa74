"""The media catalog as derived views: entries, counts, coverage, indexes, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def media_type(kind: Column) -> Column:
    """``video_clip`` and ``video`` are one type."""
    return F.when(kind == "video_clip", "video").otherwise(kind)


def entries(clips: DataFrame) -> DataFrame:
    """Catalog entries with canonical type and quality; null arrays are empty."""
    empty = F.array().cast("array<string>")
    return clips.select(
        F.col("rec_id").alias("entry_id"), "clip_id", media_type(F.col("media_type")).alias("media_type"), "source_type", "source_url", "topic", "description",
        *[F.coalesce(F.col(c), empty).alias(c) for c in ("entities", "actions", "environment")],
        F.lower("quality").alias("quality"), F.coalesce("times_used", F.lit(0)).alias("times_used"), "duration", "width", "height", "license", "strictness",
    )


def counts(catalog: DataFrame) -> DataFrame:
    """One row of totals by type."""
    of = lambda kind: F.count(F.when(F.col("media_type") == kind, 1))
    return catalog.agg(F.count(F.lit(1)).alias("total_entries"), of("video").alias("videos"), of("image").alias("images"), of("map").alias("maps"), of("graphic").alias("graphics"))


def coverage(catalog: DataFrame) -> DataFrame:
    """Clips and hundredths of seconds for each entity as written; an entity twice in an entry counts twice."""
    held = catalog.select(F.explode("entities").alias("entity"), F.round(F.coalesce("duration", F.lit(0.0)) * 100).cast("bigint").alias("centis")).where("entity is not null")
    return held.groupBy("entity").agg(F.count(F.lit(1)).alias("clips"), (F.sum("centis") / F.lit(100.0)).alias("duration"))


def postings(catalog: DataFrame, column: str, value: str) -> DataFrame:
    """Inverted index of an array column as rows ``value, entry_id``, each once."""
    held = catalog.select(F.explode(F.array_distinct(F.transform(column, F.lower))).alias(value), "entry_id")
    return held.where(F.col(value).isNotNull())


def index(catalog: DataFrame, column: str, value: str) -> DataFrame:
    """Inverted index of an array column: distinct entries for each lower-case value, with the first and last id."""
    held = catalog.select("entry_id", F.explode(F.array_distinct(F.transform(column, F.lower))).alias(value)).where(F.col(value).isNotNull())
    return held.groupBy(value).agg(F.count(F.lit(1)).alias("n_entries"), F.min("entry_id").alias("first_entry"), F.max("entry_id").alias("last_entry"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: the last written row of each key.

    An aggregate over whole rows, combined before the shuffle, so that a key
    written over and over costs one row for each partition.
    """
    return rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (key, order)])).alias("r")).select(key, "r.*")


def label_value(response: Column, label: str) -> Column:
    """The rest of the first line that starts with ``label:``, trimmed; empty if there is none."""
    return F.trim(F.regexp_extract(response, rf"(?m)^{label}:(.*)$", 1))


def catalogued(responses: DataFrame, response: str, path: str, source: str) -> DataFrame:
    """Catalog fields from a labelled response: lists by comma, blank items dropped, quality medium by default."""
    listed = lambda label: F.filter(F.transform(F.split(label_value(F.col(response), label), ","), lambda x: F.trim(x)), lambda x: x != "")
    prefix = F.when(F.col(source) == "pexels", "PEX").when(F.col(source) == "wikimedia", "WIK").when(F.col(source) == "youtube", "YT").when(F.col(source) == "local", "LOC").otherwise("UNK")
    return responses.withColumns(
        {
            "catalog_id": F.concat(prefix, F.lit("_"), F.substring(F.md5(F.col(path)), 1, 6)),
            "description": label_value(F.col(response), "DESCRIPTION"),
            "entities": listed("ENTITIES"),
            "actions": listed("ACTIONS"),
            "environment": listed("ENVIRONMENT"),
            "quality": F.coalesce(F.nullif(label_value(F.col(response), "QUALITY"), F.lit("")), F.lit("medium")),
            "shot_type": F.coalesce(F.nullif(label_value(F.col(response), "SHOT_TYPE"), F.lit("")), F.lit("medium")),
        }
    )
