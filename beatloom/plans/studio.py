"""Queries of catalog, search, scripts, jobs, ingest and timelines over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions import text as T
from beatloom.operators import catalog, ingest, jobs, search, timeline
from beatloom.session import fresh_path, table
from beatloom.sources import dimensions
from beatloom.streaming import queue
from beatloom.plans.studio_sql import ORACLES  # noqa: F401 - part of the module's registry

# -------------------------------------------------------------------- scripts


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.segmented(table(spark, sf_dir, "documents"), "doc_id", "text")


def script_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.script_lengths(table(spark, sf_dir, "documents"), "doc_id", "text")


def entities_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "beats").where("narration_verbatim is not null")
    return rows.select("row_id", F.array_join(T.entities(F.col("narration_verbatim")), "|").alias("entities"))


def entity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(T.entities(F.col("text"))).alias("entity"))
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_docs"))


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("detected"))


def lang_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("lang is not null").select("lang", T.language(F.col("text")).alias("detected"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("lang") == F.col("detected"), 1)).alias("n_agree"))


def topic_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "beats").select("row_id", T.topic(F.col("narration_verbatim")).alias("t")).where("t is not null")
    return rows.select("row_id", "t.topic", F.array_join("t.entities", "|").alias("entities"), "t.asset_type")


def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.speech_text(F.col("text")).alias("spoken"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clue_payloads").select("raw_id", T.extracted_json(F.col("payload")).alias("x"))
    return rows.select("raw_id", "x.how", "x.json")


# -------------------------------------------------------------------- catalog


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.entries(table(spark, sf_dir, "clip_entries"))


def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts(_catalog(spark, sf_dir))


def coverage_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.coverage(_catalog(spark, sf_dir))


def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index(_catalog(spark, sf_dir), "entities", "entity")


def action_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index(_catalog(spark, sf_dir), "actions", "action")


def entity_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index itself, one row for each entity and entry."""
    return catalog.postings(_catalog(spark, sf_dir), "entities", "entity")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each asset; records without an id are no upserts."""
    rows = table(spark, sf_dir, "scraped_assets").select("asset_id", "rec_id", "source_type", "topic").where("asset_id is not null")
    return catalog.latest(rows, "asset_id", "rec_id")


# --------------------------------------------------------------------- search

#: Every such row of the beats is a request.
REQUEST_EVERY = 20


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of the searches: the visuals of the beats whose id is divisible by ``REQUEST_EVERY``.

    A missing visual asks for nothing; the quality is the search's default.
    """
    v, none = F.col("primary_visual"), F.array().cast("array<string>")
    listed = lambda c: F.coalesce(v[c], none).alias(c)
    return table(spark, sf_dir, "beats").where(F.col("row_id") % REQUEST_EVERY == 0).select(
        F.col("row_id").alias("request_id"), F.coalesce(v["search_query"], F.lit("")).alias("query"), listed("entities"), listed("actions"), listed("context"),
        v["strictness"].alias("strictness"), F.lit("medium").alias("min_quality"), catalog.media_type(v["media_type"]).alias("asset_type"),
    )


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_search(_requests(spark, sf_dir), _catalog(spark, sf_dir))


def search_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    untyped = _requests(spark, sf_dir).withColumn("asset_type", F.lit(None).cast("string"))  # the type filter is off by default
    return search.gated_search(untyped, _catalog(spark, sf_dir))


def search_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.additive_search(_requests(spark, sf_dir), _catalog(spark, sf_dir))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_per_beat(table(spark, sf_dir, "beats"), _catalog(spark, sf_dir), "row_id", F.col("primary_visual"))


def best_match_per_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("row_id", "entry_id", "media_type", "score")


def gap_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of beats that the catalog does not serve, with the number of such beats."""
    rows = table(spark, sf_dir, "beats")
    open_beats = rows.join(_best(spark, sf_dir).select("row_id"), "row_id", "left_anti")
    asked = open_beats.select(F.explode(F.array_distinct(F.transform("primary_visual.entities", F.lower))).alias("entity")).where("entity <> ''")
    return asked.groupBy("entity").agg(F.count(F.lit(1)).alias("n_beats"))


def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.asset_summary(table(spark, sf_dir, "beats"), _best(spark, sf_dir))


# ----------------------------------------------------------------------- jobs


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.preflight(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "clue_payloads"))


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.summary(table(spark, sf_dir, "jobs"))


def job_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("job_id", "readiness", "problems")


def variant_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.variants(_checked(spark, sf_dir))


def job_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.as_json(table(spark, sf_dir, "jobs").select("job_id", "title", "niche", "status", "format_variant"))


def append_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = table(spark, sf_dir, "jobs").select("job_id", "script_id", "title")
    failed = table(spark, sf_dir, "jobs").where(jobs.status(F.col("status")) == "error").select("script_id", F.concat("title", F.lit(" (again)")).alias("title"))
    return jobs.appended(queued, failed.distinct())


def stem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jobs")
    return jobs.paired(rows.select(F.col("script").alias("path")), rows.select(F.col("audio").alias("path")))


def stem_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jobs")
    return jobs.unpaired(rows.select(F.col("script").alias("path")), rows.select(F.col("audio").alias("path")))


def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs to process as polled from a drop folder; run over the table's files to the end."""
    schema = table(spark, sf_dir, "jobs").schema
    folder = f"{sf_dir}/jobs.parquet"
    taken = queue.drained(spark, _as_folder(spark, folder), schema, fresh_path(spark, "queue-checkpoint"), fresh_path(spark, "queue-taken"))
    return taken.select("job_id", "state")


def _as_folder(spark: SparkSession, path: str) -> str:
    """A folder to poll; a table kept as one file is dropped into a fresh one first."""
    if len(spark.read.parquet(path).inputFiles()) == 1 and spark.read.parquet(path).inputFiles()[0].endswith("/jobs.parquet"):
        folder = fresh_path(spark, "queue-drop")
        spark.read.parquet(path).write.parquet(folder)
        return folder
    return path


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = queue.windowed_activity(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"))
    return windows.select(F.unix_seconds("window_start").alias("window_start_s"), "event_type", "n_events")


# --------------------------------------------------------------------- ingest


def query_build_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries of each asset's topic; an asset without a topic asks for nothing."""
    rows = table(spark, sf_dir, "scraped_assets").where("topic is not null")
    return rows.select("rec_id", F.array_join(ingest.topic_queries(F.col("topic"), F.filter("entities", lambda e: e.isNotNull())), "|").alias("queries"))


def query_build_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("primary_visual")
    rows = table(spark, sf_dir, "beats")
    return rows.select("row_id", F.array_join(ingest.beat_queries(v["search_query"], v["entities"], v["actions"], F.col("narration_verbatim")), "|").alias("queries"))


def url_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_seen(table(spark, sf_dir, "scraped_assets").select("download_url", "rec_id", "source_type"), "download_url", "rec_id")


def source_union_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables as one stream of assets, and of each topic and source the first four; assets without a topic answer no request."""
    columns = ("rec_id", "topic", "source_type")
    both = table(spark, sf_dir, "clip_entries").select(*columns).unionByName(table(spark, sf_dir, "scraped_assets").select(*columns))
    return ingest.quota(both.where("topic is not null"), ["topic", "source_type"], "rec_id", count=10, n_queries=3)


def library_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped assets whose topic the library lacks, as catalog rows."""
    known = table(spark, sf_dir, "clip_entries").select("topic")
    return ingest.as_entries(table(spark, sf_dir, "scraped_assets").join(known, "topic", "left_anti")).select("rec_id", "clip_id", "topic", "description", "quality")


def metadata_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "clip_entries").where("license is not null").select("source_type")
    return ingest.metadata_gate(table(spark, sf_dir, "scraped_assets"), trusted).select("rec_id", "source_type", "height")


def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local file names; an asset without an id has none."""
    rows = table(spark, sf_dir, "scraped_assets").where("asset_id is not null")
    return rows.select("rec_id", ingest.asset_name(F.col("asset_id"), catalog.media_type(F.col("media_type")), F.coalesce("download_url", F.lit(""))).alias("file_name"))


# ------------------------------------------------------------------- timeline


def beat_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.offsets(table(spark, sf_dir, "beats"))


def timeline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.segments(table(spark, sf_dir, "beats"), _best(spark, sf_dir))


def render_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.render_items(table(spark, sf_dir, "beats"), _best(spark, sf_dir))


def motion_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "beats").select("row_id", "mood").join(_best(spark, sf_dir).select("row_id", "quality"), "row_id")
    return rows.select("row_id", timeline.motion(F.col("mood"), F.col("quality")).alias("motion"))


def first_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.first_mentions(table(spark, sf_dir, "beats"), F.col("primary_visual.entities"))


def transition_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.transitions(table(spark, sf_dir, "beats"), F.col("visual_intent"))


def shot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.long_runs(table(spark, sf_dir, "beats"), F.col("primary_visual.shot_type"))


def overlay_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.overlay_style(table(spark, sf_dir, "beats"), dimensions.languages(spark))


def drawtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "timeline_items").where("text_overlay <> '' and item_id is not null")
    return rows.select("item_id", timeline.drawtext(F.col("text_overlay"), F.lit(5), T.language(F.col("text_overlay")).isin("ar")).alias("filter"))


QUERIES = {
    f.__name__: f
    for f in (
        beats, script_duration, entities_caps, entity_terms, lang_detect, lang_accuracy, topic_analysis, text_clean, json_extract, catalog_counts, coverage_by_entity, entity_index, entity_postings, action_index,
        upsert_latest, search_text, search_gated, search_additive, best_match_per_beat, gap_requests, coverage_ratio, job_status, job_preflight, variant_round_robin, job_json, append_job, stem_join,
        stem_anti, queue_stream, event_windows, query_build_a, query_build_b, url_first_seen, source_union_quota, library_first, metadata_gate, asset_names, beat_timeline, timeline_segments,
        render_items, motion_assign, first_mention, transition_by_topic, shot_runs, overlay_style, drawtext,
    )
}
