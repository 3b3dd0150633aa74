"""Queries from script to shots: retrieval, gates, looks, filters, answers of media sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions import text as T
from beatloom.operators import catalog, ingest, nested, production, render, responses, search, timeline
from beatloom.plans.production_sql import ORACLES  # noqa: F401 - part of the module's registry
from beatloom.plans.studio import _best, _catalog, _checked, _requests
from beatloom.session import fresh_path, table
from beatloom.sources import dimensions, files


#: A year in a text, between characters that are no ASCII letters or digits.
YEAR = r"(?<![0-9A-Za-z_])((?:19|20)[0-9]{2})(?![0-9A-Za-z_])"


def clue_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beats of all payloads in one flat shape."""
    return production.flat_beats(nested.beat_objects(table(spark, sf_dir, "clue_payloads")), "beat")


def beats_multilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production.multilingual_beats(table(spark, sf_dir, "documents"), "doc_id", "text", dimensions.languages(spark))


def entity_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each beat: its own, else those found in the narration."""
    own = F.filter("primary_visual.entities", lambda e: e != "")
    found = F.when(F.size(own) > 0, own).otherwise(T.family_entities(F.coalesce("narration_verbatim", F.lit(""))))
    return table(spark, sf_dir, "beats").select("row_id", F.array_join(found, "|").alias("entities"))


def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production.retrieval(table(spark, sf_dir, "beats"), _best(spark, sf_dir), F.col("primary_visual"))


def library_then_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's best entry of each beat; for beats without one, the first two scraped assets of an entity they ask for, each address once."""
    assets = ingest.first_seen(table(spark, sf_dir, "scraped_assets").select("rec_id", "download_url", "entities"), "download_url", "rec_id")
    held = assets.select("rec_id", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("entity")).where("entity <> ''")
    firsts = ingest.quota(held, ["entity"], "rec_id", count=2, n_queries=2)  # two of each entity are enough for two of each beat

    def scraped(beats: DataFrame) -> DataFrame:
        asked = beats.select("row_id", F.explode(F.array_distinct(F.transform("primary_visual.entities", F.lower))).alias("entity"))
        return ingest.quota(asked.join(firsts, "entity").select("row_id", "rec_id").distinct(), ["row_id"], "rec_id", count=2, n_queries=2)

    return production.with_library_first(table(spark, sf_dir, "beats").select("row_id", "primary_visual"), lambda b: _best(spark, sf_dir), scraped)


def identity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the additive search's entries pass the identity gates of the request: designations as variants, the narration's years."""
    beats = table(spark, sf_dir, "beats").select(F.col("row_id").alias("request_id"), F.regexp_extract_all(F.coalesce("narration_verbatim", F.lit("")), F.lit(YEAR), F.lit(1)).alias("years"))
    found = search.additive_search(_requests(spark, sf_dir), _catalog(spark, sf_dir)).select("request_id", "entry_id")
    asked = _requests(spark, sf_dir).select("request_id", F.filter(F.filter("entities", lambda e: e.isNotNull()), lambda e: e.rlike("[0-9]")).alias("variants")).join(beats, "request_id")
    rows = found.join(asked, "request_id").join(_catalog(spark, sf_dir).select("entry_id", "entities", "description"), "entry_id")
    return rows.select("request_id", "entry_id", production.identity_gate(F.col("variants"), F.col("years"), F.col("entities"), F.col("description")).alias("passes"))


def query_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled templates of each scraped asset: its first entity, first tag and the year of its time."""
    some = lambda c: F.get(F.filter(c, lambda x: x != ""), F.lit(0))
    fields = {"entity": some("entities"), "action": some("tags"), "year": F.regexp_extract(F.coalesce("created_at", F.lit("")), YEAR, 1)}
    return table(spark, sf_dir, "scraped_assets").select("rec_id", F.array_join(production.filled_templates(fields), "|").alias("queries"))


def mood_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "beats").select("row_id", production.look(F.col("mood")).alias("l")).select("row_id", "l.grade", "l.shots")


def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which visual of each beat of the payloads comes to be used."""
    at = lambda path: F.get_json_object("beat", f"$.{path}")
    rows = nested.beat_objects(table(spark, sf_dir, "clue_payloads"))
    chosen = production.fallback(at("primary_visual.media_type"), at("fallback_visual.media_type"), at("last_resort.type"))
    return rows.select("raw_id", "beat_pos", chosen.alias("f")).select("raw_id", "beat_pos", "f.level", "f.media_type")


def visual_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of visual of each beat; a place is an entity of that category, new on the first beat of its script."""
    places = table(spark, sf_dir, "entity_reference").where("category = 'location'").select("name")
    beats = table(spark, sf_dir, "beats")
    asked = beats.select("row_id", "script_id", F.coalesce("beat_number", F.lit(-1)).alias("n"), F.explode(F.array_distinct("primary_visual.entities")).alias("name")).join(places, "name")
    first = asked.groupBy("script_id", "name").agg(F.min("n").alias("first"))
    marked = asked.join(first, ["script_id", "name"]).groupBy("row_id").agg(F.max(F.col("n") == F.col("first")).alias("new"))
    rows = beats.join(marked, "row_id", "left")
    kind = production.visual_type(F.coalesce("narration_verbatim", F.lit("")), F.col("new").isNotNull(), F.coalesce("new", F.lit(False)), F.col("primary_visual.media_type"))
    return rows.select("row_id", kind.alias("visual_type"))


def narration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production.narration_files(table(spark, sf_dir, "beats"))


def script_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (production.estimated_centis(F.col("text")) / F.lit(100.0)).alias("seconds"))


def language_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice, font and direction of each document's language; English for one that is not known."""
    known = F.broadcast(dimensions.languages(spark))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("lang")).alias("code")).join(known.select("code", F.lit(True).alias("there")), "code", "left")
    rows = rows.select("doc_id", F.when(F.col("there"), F.col("code")).otherwise("en").alias("code"))
    return rows.join(known, "code").select("doc_id", "code", "display_name", "font_file", "voice", "voice_female", F.when(F.col("rtl"), "rtl").otherwise("ltr").alias("direction"))


def asset_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "entity_reference").where("category = 'location'")
    return production.needed_assets(table(spark, sf_dir, "beats"), F.col("primary_visual"), places)


def times_used_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production.used(_catalog(spark, sf_dir), _best(spark, sf_dir))


def job_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs from readiness to their timelines in one plan."""
    segments = timeline.segments(table(spark, sf_dir, "beats"), _best(spark, sf_dir))
    return production.processed(_checked(spark, sf_dir), segments)


def preview_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten items of each job's timeline."""
    items = table(spark, sf_dir, "timeline_items").withColumn("at", F.coalesce("start_time", F.lit(0.0)))
    first = ingest.quota(items.select("job_id", "item_id", F.struct("at", "item_id").alias("o")), ["job_id"], "o", count=9, n_queries=1)
    return first.select("job_id", "item_id")


def render_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter string of each timeline item by its type, and of its narration."""
    c = F.col
    kind = F.when(c("item_type") == "video", render.clip_filter(c("item_id"), c("start_time"), c("duration"), c("motion")))
    kind = kind.when(c("item_type") == "image", render.still_filter(c("item_id"), c("duration"), c("motion")))
    kind = kind.otherwise(render.card_filter(c("item_id"), c("text_overlay"), c("duration"), c("text_position"), c("position_x"), c("position_y")))
    sound = render.sound_filter(c("item_id"), c("narration_start"), c("narration_end"), c("duration"))
    return table(spark, sf_dir, "timeline_items").where("item_id is not null").select("item_id", kind.alias("filter"), sound.alias("sound"))


# ------------------------------------------------- answers of media sources


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scraped_assets").select(F.col("rec_id").cast("string").alias("id"), "source_url", "download_url", "thumbnail_url", "photographer", "description", "license", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height")])


def _answers(rows: DataFrame, body: Column) -> DataFrame:
    """The answers as a source would have sent them, one for each asset."""
    return rows.select(F.to_json(body).alias("response"))


def video_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of a video source: of a small, a wide and another wide file the first wide one is taken."""
    file = lambda link, w, h: F.struct(link.alias("link"), w.alias("width"), h.alias("height"))
    files = F.array(file(F.lit("small"), F.lit(0), F.lit(1)), file(F.col("download_url"), F.col("width") + 1, F.col("height")), file(F.lit("later"), F.col("width") + 1, F.lit(7)))
    video = F.struct(F.col("id").alias("id"), F.col("source_url").alias("url"), F.col("thumbnail_url").alias("image"), F.struct(F.col("photographer").alias("name")).alias("user"), files.alias("video_files"))
    found = responses.videos(_answers(_assets(spark, sf_dir), F.struct(F.array(video).alias("videos"))), "response")
    return found.select("source_id", "source_url", "download_url", "thumbnail_url", "photographer", "width", "height")


def photo_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of a photo source: the large file or else the original, the medium preview or else the small one."""
    src = F.struct(F.when(F.col("width") > 1000, F.col("download_url")).alias("large"), F.col("source_url").alias("original"), F.lit(None).cast("string").alias("medium"), F.col("thumbnail_url").alias("small"))
    photo = F.struct(F.col("id").alias("id"), F.col("source_url").alias("url"), F.col("description").alias("alt"), F.col("width").alias("width"), F.col("height").alias("height"), F.col("photographer").alias("photographer"), src.alias("src"))
    found = responses.photos(_answers(_assets(spark, sf_dir), F.struct(F.array(photo).alias("photos"))), "response")
    return found.select("source_id", "download_url", "thumbnail_url", "description", "width", "height")


def archive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of an archive: images only; short licence, licence, attribution, ``CC``."""
    meta = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("*"))
    licence = F.create_map(F.lit("a"), meta("License", F.coalesce("license", F.lit(""))), F.lit("b"), meta("Attribution", F.coalesce("photographer", F.lit(""))))
    mime = F.when(F.col("download_url").rlike(r"\.jpg"), "image/jpeg").when(F.col("download_url").rlike(r"\.mp4"), "video/mp4").otherwise("image/svg+xml")
    info = F.struct(F.col("download_url").alias("url"), F.col("source_url").alias("descriptionurl"), mime.alias("mime"), F.col("width").alias("width"), F.col("height").alias("height"), licence.alias("extmetadata"))
    page = F.struct(F.col("id").alias("pageid"), F.col("description").alias("extract"), F.array(info).alias("imageinfo"))
    found = responses.archive(_answers(_assets(spark, sf_dir), F.struct(F.struct(F.create_map("id", page).alias("pages")).alias("query"))), "response")
    return found.select("source_id", "source_url", "download_url", "thumbnail_url", "description", "license", "width", "height")


def thumbnail_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the preview that a video address leads to, by the quality in its name."""
    rows = table(spark, sf_dir, "scraped_assets").select("rec_id", F.regexp_extract(F.coalesce("download_url", F.lit("")), r"/vi/.*/([a-z]+)\.jpg", 1).alias("quality")).where("quality <> ''")
    return rows.select("rec_id", "quality", responses.thumbnail_size(F.col("quality")).alias("s")).select("rec_id", "quality", "s.width", "s.height")


def labelled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog fields read back from the labelled text that a model would have written of each entry."""
    c = F.col
    line = lambda label, value: F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit("")))
    listed = lambda name: F.array_join(F.filter(name, lambda x: x != ""), ", ")
    clips = table(spark, sf_dir, "clip_entries").where("file_path is not null")
    answer = F.concat_ws("\n", line("DESCRIPTION", F.regexp_replace("description", r"[\r\n]+", " ")), line("ENTITIES", listed("actions")), line("QUALITY", F.lower("quality")))
    rows = catalog.catalogued(clips.select("rec_id", "file_path", "source_type", answer.alias("answer")), "answer", "file_path", "source_type")
    return rows.select("rec_id", "catalog_id", F.array_join("entities", "|").alias("entities"), "quality", "shot_type", F.length("description").cast("bigint").alias("n_chars"), c("description"))


def library_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library written as documents of at most a thousand entries, while the query is built, and read back with its defaults."""
    fields = ("media_type", "file_path", "topic", "entities", "quality", "times_used")
    entry = F.struct(F.col("rec_id").cast("string").alias("id"), *[F.col(c).alias("type" if c == "media_type" else c) for c in fields])
    rows = table(spark, sf_dir, "clip_entries").groupBy(F.floor(F.col("rec_id") / 1000)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("rec_id").cast("string"), entry))).alias("entries"))
    path = fresh_path(spark, "library")
    rows.select("entries").write.json(path)
    return files.library(spark, path).select("id", "type", "file_path", "topic", F.array_join("entities", "|").alias("entities"), "quality", "times_used")


QUERIES = {
    f.__name__: f
    for f in (
        clue_beats, beats_multilingual, entity_families, retrieval, library_then_scrape, identity_gates, query_templates, mood_looks, fallback_chain, visual_types, narration_files, script_estimates,
        language_contexts, asset_needs, times_used_after, job_pipeline, preview_items, render_filters, video_answers, photo_answers, archive_answers, thumbnail_sizes, labelled_answers, library_file,
    )
}
