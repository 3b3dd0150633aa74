"""Bounded ingest from several sources: queries, quotas, first-seen deduplication, library first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NONE = "array<string>"


def topic_queries(topic: Column, entities: Column) -> Column:
    """The topic, the topic with its first three entities, and two general ones; at most five."""
    some = F.coalesce(entities, F.array().cast(_NONE))
    named = F.transform(F.slice(some, 1, 3), lambda e: F.concat_ws(" ", topic, e))
    return F.slice(F.concat(F.array(topic), named, F.array(F.concat(topic, F.lit(" high quality")), F.concat(topic, F.lit(" footage")))), 1, 5)


def beat_queries(terms: Column, entities: Column, actions: Column, narration: Column) -> Column:
    """Search terms, then the first two entities with the first two actions (or ``footage``), else the narration; at most five different ones."""
    empty = F.array().cast(_NONE)
    present = lambda a: F.slice(F.filter(F.coalesce(a, empty), lambda x: x.isNotNull()), 1, 2)
    acts = present(actions)
    named = F.flatten(F.transform(present(entities), lambda e: F.when(F.size(acts) > 0, F.transform(acts, lambda a: F.concat_ws(" ", e, a))).otherwise(F.array(F.concat(e, F.lit(" footage"))))))
    own = F.concat(F.when(F.coalesce(terms, F.lit("")) != "", F.array(terms)).otherwise(empty), named)
    return F.slice(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(F.array(F.substring(F.coalesce(narration, F.lit("")), 1, 80)))), 1, 5)


def first_seen(assets: DataFrame, url: str, order: str) -> DataFrame:
    """The first asset of each url. An aggregate, combined before the shuffle; null urls are one asset each."""
    rest = [c for c in assets.columns if c not in (url, order)]
    known = assets.where(F.col(url).isNotNull()).groupBy(url).agg(F.min(F.struct(order, *rest)).alias("r")).select(url, "r.*")
    return known.select(*assets.columns).unionByName(assets.where(F.col(url).isNull()))


def quota(assets: DataFrame, request: list[str], order: str, count: int, n_queries: int) -> DataFrame:
    """Of each request at most ``count // n_queries + 1`` assets, in order."""
    ranked = assets.withColumn("_n", F.row_number().over(Window.partitionBy(*request).orderBy(order)))
    return ranked.where(F.col("_n") <= count // n_queries + 1).drop("_n")


def as_entries(assets: DataFrame) -> DataFrame:
    """Scraped assets as catalog rows: topic of 50 and description of 200 characters, medium quality."""
    return assets.select(
        "rec_id", F.col("asset_id").alias("clip_id"), "media_type", "source_type", "source_url", F.substring("topic", 1, 50).alias("topic"),
        F.substring("description", 1, 200).alias("description"), F.lit("medium").alias("quality"), "duration", "width", "height", "license",
    )


def metadata_gate(assets: DataFrame, sources: DataFrame, least_height: int = 1080) -> DataFrame:
    """Assets of whitelisted sources (``source_type``) and sufficient height, by cheap predicates first."""
    return assets.where(F.col("height") >= least_height).join(sources.select("source_type").distinct(), "source_type", "left_semi")


def asset_name(asset_id: Column, media_type: Column, url: Column) -> Column:
    """Local file name of an asset: safe characters, thirty at most, and the url's ending or the type's."""
    safe = F.substring(F.regexp_replace(asset_id, r"[^A-Za-z0-9_-]", "_"), 1, 30)
    ending = F.regexp_extract(url, r"(\.[A-Za-z0-9]{2,4})(?:[?#].*)?$", 1)
    return F.concat(safe, F.when(ending != "", ending).when(media_type == "video", ".mp4").otherwise(".jpg"))
