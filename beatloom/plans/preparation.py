"""Queries of the core data-preparation problems 1, 4 and 5 over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.operators import intervals, nested, timestamps
from beatloom.plans.preparation_sql import ORACLES  # noqa: F401 - part of the module's registry
from beatloom.session import table


def _interval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats, items = table(spark, sf_dir, "beats"), table(spark, sf_dir, "timeline_items")
    of_beats = intervals.interval_rows(beats, "beats", "script_id", F.col("start_time"), F.col("end_time"))
    of_items = intervals.interval_rows(items, "timeline_items", "job_id", F.col("start_time"), F.col("start_time") + F.col("duration"))
    return of_beats.unionByName(of_items)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes between the intervals of each script and job."""
    return intervals.gaps(_interval_rows(spark, sf_dir))


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous covered periods of each script and job."""
    return intervals.periods(_interval_rows(spark, sf_dir))


def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("rec_id", "created_at", "capture_tz")
    return table(spark, sf_dir, "scraped_assets").select(*columns).unionByName(table(spark, sf_dir, "clip_entries").select(*columns))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every readable ``created_at`` that is not written in the canonical form.

    The rows are chosen by kind: a test of ``utc_us`` would be pushed below the
    join and drag the whole parsing with it.
    """
    rows = timestamps.normalised(_created(spark, sf_dir).where(~F.col("created_at").rlike(timestamps.CANONICAL)))
    return rows.where(F.col("utc_us_kind") != "unreadable").select("rec_id", "utc_us")


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the values of each recording zone were resolved."""
    return timestamps.normalised(_created(spark, sf_dir)).groupBy("capture_tz", F.col("utc_us_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and overlay contents with the positions of their parents."""
    return nested.item_table(nested.nodes(table(spark, sf_dir, "clue_payloads"), kinds=("entity", "overlay")))


def p5_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of beats."""
    return nested.beat_table(nested.nodes(table(spark, sf_dir, "clue_payloads"), kinds=("beat",))).select("raw_id", "beat_pos", "beat_id")


def p5_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of visuals with the beat that holds them."""
    return nested.visual_table(nested.nodes(table(spark, sf_dir, "clue_payloads"), kinds=("visual",))).select("raw_id", "beat_pos", "node", "node_pos", "media_type")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of entities, actions and contexts with the visual that holds them."""
    return nested.term_table(nested.nodes(table(spark, sf_dir, "clue_payloads"), kinds=("entity", "action", "context"))).drop("copy")


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p4_found, p4_kinds, p5_found, p5_beats, p5_visuals, p5_terms)}
