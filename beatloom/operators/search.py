"""Searching the catalog: hard gates and ranking, additive scoring, best match per beat.

Requests and catalog meet through their vocabularies only. Which catalog
entities a requested entity hits is settled once per distinct pair, by joining
the substrings of the one with the other, never by comparing rows. Scores are
whole tenths, so that sums do not depend on their order.

Requests: ``request_id, query, entities, actions, context`` (arrays),
``strictness, min_quality, asset_type``. Catalog: as ``catalog.entries``.
Empty and null filters are passed over; blank requested values hit nothing;
ties keep the catalog's order (``entry_id``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.functions import text as T
from beatloom.operators import best, blocks

QUALITY = {"low": 0, "medium": 1, "high": 2}
#: Points of a gate in tenths: an exact and a partial entity, an action, a context.
EXACT, PARTIAL, ACTION, CONTEXT = 30, 10, 15, 9


def quality_rank(quality: Column) -> Column:
    lower = F.coalesce(quality, F.lit("medium"))
    return F.when(lower == "high", 2).when(lower == "medium", 1).otherwise(0)


def _lowered(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), F.lower), lambda v: v != "")


def _pieces(c: Column, lengths: Column) -> Column:
    """The substrings of a value that have one of the given lengths."""
    n = F.length(c)
    fitting = F.filter(lengths, lambda k: k <= n)
    return F.array_distinct(F.flatten(F.transform(fitting, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(c, i, k)))))


def containing_pairs(requested: DataFrame, held: DataFrame) -> DataFrame:
    """``req, held, exact`` for each two distinct values of which one contains the other.

    Only substrings of lengths that the other side has are formed; the lengths
    come as one row.
    """
    r, h = requested.select("req").where("req <> ''").distinct(), held.select("held").where("held <> ''").distinct()
    sizes = lambda df, c: F.broadcast(df.agg(F.sort_array(F.collect_set(F.length(c))).alias("sizes")))
    inside = h.join(sizes(r, "req"), F.lit(True)).select("held", F.explode(_pieces(F.col("held"), F.col("sizes"))).alias("req")).join(r, "req").select("req", "held")
    around = r.join(sizes(h, "held"), F.lit(True)).select("req", F.explode(_pieces(F.col("req"), F.col("sizes"))).alias("held")).join(h, "held").select("req", "held")
    return inside.unionByName(around).distinct().withColumn("exact", F.col("req") == F.col("held"))


def _penalty(times_used: Column) -> Column:
    return F.least(F.coalesce(times_used, F.lit(0)) * 2, F.lit(10))


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("request_id").orderBy(F.desc("tenths"), "entry_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("request_id", "entry_id", F.col("rank").cast("bigint").alias("rank"), (F.col("tenths") / F.lit(10.0)).alias("score"))


def text_search(requests: DataFrame, catalog: DataFrame, k: int = 20) -> DataFrame:
    """Top ``k`` entries of each request by words and reuse alone, after the quality gate."""
    return _top(blocks.scored(requests, catalog, "text", k), k)


def gated_search(requests: DataFrame, catalog: DataFrame, k: int = 20) -> DataFrame:
    """Top ``k`` entries of each request that pass the entity, action, context, type and quality gates.

    The first requested entity that an entry holds, wholly or in part, decides:
    a partial hit is refused under ``exact`` and ``specific``.
    """
    return _top(blocks.scored(requests, catalog, "gated", k), k)


def additive_search(requests: DataFrame, catalog: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` entries of each request by summed points: no gate but the type and a positive score."""
    return _top(blocks.scored(requests, catalog, "additive", k), k)


def best_per_beat(beats: DataFrame, catalog: DataFrame, key: str, visual: Column) -> DataFrame:
    """``key, entry_id, media_type, quality, score`` of the beats that the catalog serves.

    The gates and points are those of :func:`gated_search` under its defaults:
    strictness general, quality medium, no other filter. A visual without
    entities is searched by its query alone; a beat without visual is not
    searched. Each beat looks through the lists of its entities' entries (see
    :mod:`beatloom.operators.best`).
    """
    words = F.array_join(F.array_sort(F.array_distinct(T.words(F.lower(F.coalesce(visual["search_query"], F.lit("")))))), " ")
    wanted = beats.where(visual.isNotNull()).select(key, F.monotonically_increasing_id().alias("_n"), _lowered(visual["entities"]).alias("entities"), words.alias("query"))
    allowed = catalog.where((quality_rank(F.col("quality")) >= QUALITY["medium"]) & F.col("entry_id").isNotNull()).select(
        "entry_id", "media_type", "quality", _penalty(F.col("times_used")).alias("penalty"), F.array_distinct(_lowered(F.col("entities"))).alias("held"), *blocks.word_columns()
    )
    found = best.best_entries(wanted, allowed, [key, "_n"])
    return found.select(key, "entry_id", "media_type", "quality", (F.col("tenths") / F.lit(10.0)).alias("score"))
