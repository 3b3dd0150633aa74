"""From script to shots: flat beats, retrieval, gates, looks, fallbacks, narration files, summaries.

Null texts and lists are empty; null ids meet nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.functions import text as T
from beatloom.operators import timeline
from beatloom.operators.ordered import running_total
from beatloom.session import written

#: Texts for a speaker have so many characters at least.
SPOKEN_LEAST = 10

#: What a search may be phrased as; only templates whose fields are all known are filled.
TEMPLATES = ("{entity} official video", "{entity} demonstration", "{entity} exercise {year}", "{action} near {entity}")

# Colour grade and style of shots of each mood.
MOODS = (("neutral", "standard", "steady"), ("tension", "darker", "closer"), ("epic", "wide", "dramatic pacing"), ("historical", "desaturated", "grainy"), ("technical", "clean", "precise overlays"), ("emotional", "softer", "slower"))

_NONE = "array<string>"


def flat_beats(beats: DataFrame, json: str) -> DataFrame:
    """The flat fields of beats ``json`` of either shape: fields of their own, else those of the primary visual."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(F.col(json), f"$.{p}") for p in paths])
    return beats.select(
        *[c for c in beats.columns if c != json], at("beat_id").alias("beat_id"), at("narration_verbatim").alias("narration"), at("start_time", "start").try_cast("double").alias("start_time"), at("end_time", "end").try_cast("double").alias("end_time"),
        F.coalesce(at("asset_type", "primary_visual.media_type"), F.lit("text_card")).alias("asset_type"), F.coalesce(at("search_terms", "primary_visual.search_query"), F.lit("")).alias("search_terms"),
        F.coalesce(at("strictness", "primary_visual.strictness"), F.lit("general")).alias("strictness"), F.coalesce(at("mood"), F.lit("neutral")).alias("mood"), F.coalesce(at("text_overlay_title", "text_overlay.content"), F.lit("")).alias("overlay_title"),
    )


def retrieval(beats: DataFrame, best: DataFrame, visual: Column) -> DataFrame:
    """``row_id, media_type, source, entry_id, needs_scraping``: text cards are not searched for, others come from the library or are to be scraped."""
    rows = beats.select("row_id", F.coalesce(visual["media_type"], F.lit("text_card")).alias("wanted")).join(best.select("row_id", "entry_id", F.col("media_type").alias("held")), "row_id", "left")
    card, hit = F.col("wanted") == "text_card", F.col("entry_id").isNotNull()
    source = F.when(card, F.lit(None).cast("string")).when(hit, "library").otherwise("scrape_required")
    return rows.select("row_id", F.when(~card & hit, F.col("held")).otherwise("text_card").alias("media_type"), source.alias("source"), F.when(~card, F.col("entry_id")).alias("entry_id"), (~card & ~hit).alias("needs_scraping"))


def with_library_first(beats: DataFrame, search, scraped) -> DataFrame:
    """``row_id, rec_id, origin``: what ``search`` (a function of beats) finds, and for the beats without a hit what ``scraped`` finds."""
    hits = written(search(beats).select("row_id", F.col("entry_id").alias("rec_id")), "library-hits").withColumn("origin", F.lit("library"))  # both parts below read it
    rest = beats.join(hits.select("row_id").distinct(), "row_id", "left_anti")
    return hits.unionByName(scraped(rest).select("row_id", "rec_id", F.lit("scraped").alias("origin")))


def identity_gate(variants: Column, years: Column, entities: Column, description: Column) -> Column:
    """Whether a clip has every required variant among its entities and every required year in its description."""
    held = F.transform(F.coalesce(entities, F.array().cast(_NONE)), F.lower)
    return F.forall(variants, lambda v: F.array_contains(held, F.lower(v))) & F.forall(years, lambda y: F.contains(F.coalesce(description, F.lit("")), y))


def filled_templates(fields: dict[str, Column], templates: tuple[str, ...] = TEMPLATES) -> Column:
    """The templates filled with the fields; those with an unknown one are left out."""
    out = []
    for t in templates:
        c, known = F.lit(t), F.lit(True)
        for name, value in fields.items():
            if f"{{{name}}}" in t:
                c, known = F.replace(c, F.lit(f"{{{name}}}"), value), known & F.coalesce(value != "", F.lit(False))
        out.append(F.when(known, c))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def look(mood: Column) -> Column:
    """``struct<grade, shots>`` of a mood, those of neutral for an unknown one."""
    pick = lambda at: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m in MOODS for x in (m[0], m[at])]), F.lower(F.trim(mood))), F.lit(MOODS[0][at]))
    return F.struct(pick(1).alias("grade"), pick(2).alias("shots"))


def fallback(primary: Column, second: Column, last: Column) -> Column:
    """``struct<level, media_type>``: the first visual there is, else a text card."""
    level = F.when(primary.isNotNull(), "primary").when(second.isNotNull(), "fallback").otherwise("last_resort")
    return F.struct(level.alias("level"), F.coalesce(primary, second, last, F.lit("text_card")).alias("media_type"))


def visual_type(narration: Column, location: Column, first: Column, wanted: Column) -> Column:
    """Kind of visual of a beat: a map for a place (animated when it is new), a card for a number, else what it asks for."""
    low = F.lower(narration)
    return (
        F.when(location & low.rlike(r"\b(?:route|road|crossing)\b"), "map_route").when(location & first, "animated_map").when(location, "map_highlight")
        .when(narration.rlike(r"[0-9]{3,}"), "text_card").when(low.rlike(r"\b(?:compared|than|versus)\b"), "comparison_graphic").otherwise(F.coalesce(wanted, F.lit("stock_image")))
    )


def narration_files(beats: DataFrame) -> DataFrame:
    """``row_id, script_id, file_name`` of the beats with enough to say; the number counts all beats of the script."""
    rows = beats.select("row_id", "script_id", "beat_number", "narration_verbatim").where("script_id is not null")
    placed = running_total(rows, ["script_id"], timeline.beat_order(), timeline.beat_bucket(), F.lit(1), "place")
    spoken = placed.where(F.length(T.stripped(F.col("narration_verbatim"))) >= SPOKEN_LEAST)
    return spoken.select("row_id", "script_id", F.format_string("%s_%03d", F.col("script_id"), F.col("place")).alias("file_name"))


def estimated_centis(text: Column) -> Column:
    """Hundredths of a second that a whole script takes: 0.15 s a word."""
    return (F.size(T.words(text)) * 15).cast("bigint")


def multilingual_beats(scripts: DataFrame, key: str, text: str, languages: DataFrame) -> DataFrame:
    """Beats of scripts with their entities, search terms, overlay title and the language of the whole script."""
    known = F.broadcast(languages.select("code", F.col("name").alias("language_name"), "rtl"))
    rows = scripts.select(key, text, T.language(F.col(text)).alias("code")).join(known, "code")
    beats = timeline.segmented(rows, key, text, "code", "language_name", "rtl")
    named = F.array_join(T.family_entities(F.col("narration")), " ")
    title = T.stripped(F.col("narration"))
    return beats.select(
        key, "beat_id", "start_time", "end_time", "duration", F.when(named != "", named).otherwise(F.substring(title, 1, 80)).alias("search_terms"), F.substring(title, 1, 100).alias("overlay_title"), F.col("code").alias("language"), "language_name",
        F.when(F.col("rtl"), "rtl").otherwise("ltr").alias("direction"),
    )


def needed_assets(beats: DataFrame, visual: Column, places: DataFrame) -> DataFrame:
    """``script_id``, the number of assets needed by kind, the entities involved and those of them that are places (``name``), each in order."""
    kind = F.coalesce(visual["media_type"], F.lit("text_card"))
    of = lambda *kinds: F.count(F.when(kind.isin(*kinds), 1))
    counts = beats.groupBy("script_id").agg(of("video", "video_clip").alias("n_videos"), of("image").alias("n_images"), of("map", "animated_map").alias("n_maps"), of("text_card").alias("n_text_cards"), of("graphic").alias("n_graphics"))
    named = beats.select("script_id", F.explode(visual["entities"]).alias("name")).where("name <> ''").distinct()
    marked = named.join(places.select("name", F.lit(True).alias("place")).distinct(), "name", "left")
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "|")
    lists = marked.groupBy("script_id").agg(listed(F.col("name")).alias("entities"), listed(F.when(F.col("place"), F.col("name"))).alias("locations"))
    joined = counts.join(lists, counts["script_id"].eqNullSafe(lists["script_id"]), "left").drop(lists["script_id"])
    return joined.select("script_id", "n_videos", "n_images", "n_maps", "n_text_cards", "n_graphics", F.coalesce("entities", F.lit("")).alias("entities"), F.coalesce("locations", F.lit("")).alias("locations"))


def used(catalog: DataFrame, best: DataFrame) -> DataFrame:
    """``entry_id, times_used`` after the beats' best entries have been used once each."""
    uses = best.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))
    return catalog.select("entry_id", "times_used").join(uses, "entry_id", "left").select("entry_id", (F.col("times_used") + F.coalesce("n", F.lit(0))).cast("bigint").alias("times_used"))


def processed(checked: DataFrame, segments: DataFrame) -> DataFrame:
    """One plan over all jobs: readiness, and the length and coverage of the timeline of each job that is not blocked; ``error`` says why one is not done."""
    per_script = segments.where("script_id is not null").groupBy("script_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count("entry_id").alias("n_matched"), (F.sum(F.round(F.col("duration") * 100).cast("bigint")) / F.lit(100.0)).alias("seconds"))
    rows = checked.join(per_script, "script_id", "left")
    blocked = F.col("readiness") == "blocked"
    shown = lambda c: F.when(~blocked, F.coalesce(c, F.lit(0)))
    error = F.when(blocked, F.col("problems")).when(F.col("n_segments").isNull(), "no beats")
    return rows.select("job_id", "readiness", shown(F.col("n_segments")).alias("n_segments"), shown(F.col("n_matched")).alias("n_matched"), F.when(~blocked, F.coalesce("seconds", F.lit(0.0))).alias("seconds"), error.alias("error"))
