"""Beats and timelines: segmentation, running offsets, segments, overlays, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.functions import text as T
from beatloom.operators.ordered import lagged, running_total
from beatloom.session import written

#: Beats of one bucket of a script's running computations.
BEATS_A_BUCKET = 1000
#: Silence between two beats of a clue script, in hundredths of a second.
GAP = 30


def beat_bucket() -> Column:
    return F.floor(F.coalesce(F.col("beat_number"), F.lit(-1)) / F.lit(BEATS_A_BUCKET))


def beat_order() -> list[Column]:
    return [F.coalesce(F.col("beat_number"), F.lit(-1)), F.col("row_id")]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _before(sizes: Column) -> Column:
    """For each place of an array the sum of all earlier values.

    Sums of blocks as long as the array's root come first, so the work is the
    length times its root, and nothing has to be shuffled for a running total.
    """
    places = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))

    def of(values: Column, width: Column) -> Column:
        blocks = F.transform(places(F.ceil(F.size(values) / width).cast("int")), lambda b: _sum(F.slice(values, b * width + 1, width)))
        carried = T.let(blocks, lambda sums: F.transform(places(F.size(sums)), lambda b: _sum(F.slice(sums, F.lit(1), b))))
        block = lambda i: F.floor(i / width).cast("int")
        return T.let(carried, lambda c: F.transform(places(F.size(values)), lambda i: F.get(c, block(i)) + _sum(F.slice(values, block(i) * width + 1, i % width))))

    # every array is bound once, so that no lambda computes it again for each place
    return T.let(sizes, lambda values: T.let(F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1)), lambda width: of(values, width)))


def segmented(scripts: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """Beats of scripts: sentences of five characters and more, with spoken length and running offsets.

    Sentences passed over leave holes in the numbering. The text of one script
    lies in one row, so its offsets are summed where it is split; columns in
    ``more`` pass through.
    """
    pieces = F.transform(T.sentence_array(F.col(text)), lambda s, i: F.struct(i.alias("idx"), s.alias("narration"), T.speech_centis(F.size(T.words(s))).alias("centis")))
    rows = scripts.select(key, *more, F.filter(pieces, lambda p: F.length(p["narration"]) >= 5).alias("kept"))
    rows = rows.select(key, *more, "kept", _before(F.transform("kept", lambda p: p["centis"] + GAP)).alias("begin"))
    beats = rows.select(key, *more, F.explode(F.arrays_zip("kept", "begin")).alias("b")).select(key, *more, "b.kept.idx", "b.kept.narration", "b.kept.centis", "b.begin")
    begin = F.col("begin")
    return beats.select(
        key, *more, F.format_string("B%03d", F.col("idx") + 1).alias("beat_id"), "narration", (begin / F.lit(100.0)).alias("start_time"), ((begin + F.col("centis")) / F.lit(100.0)).alias("end_time"), (F.col("centis") / F.lit(100.0)).alias("duration")
    )


def script_lengths(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_beats, clue_seconds, timeline_seconds`` without splitting into rows."""
    sizes = F.transform(F.filter(T.sentence_array(F.col(text)), lambda s: F.length(s) >= 5), lambda s: T.speech_centis(F.size(T.words(s))))
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = F.size(sizes)
    rows = scripts.select(key, n.cast("bigint").alias("n_beats"), total.alias("t")).where("n_beats > 0")
    return rows.select(key, "n_beats", ((F.col("t") + F.col("n_beats") * GAP) / F.lit(100.0)).alias("clue_seconds"), (F.col("t") / F.lit(100.0)).alias("timeline_seconds"))


def duration_centis(duration: Column) -> Column:
    """Hundredths of a second of a beat, five seconds if it has none."""
    return F.round(F.coalesce(duration, F.lit(5.0)) * 100).cast("bigint")


def offsets(beats: DataFrame) -> DataFrame:
    """``row_id, script_id, start, end, duration`` of all beats laid end to end in their script."""
    rows = beats.select("row_id", "script_id", "beat_number", duration_centis(F.col("duration")).alias("centis"))
    placed = running_total(rows, ["script_id"], beat_order(), beat_bucket(), F.col("centis"), "at")
    return placed.select("row_id", "script_id", (F.col("at") / F.lit(100.0)).alias("start"), ((F.col("at") + F.col("centis")) / F.lit(100.0)).alias("end"), (F.col("centis") / F.lit(100.0)).alias("duration"))


def motion(mood: Column, quality: Column) -> Column:
    """Motion effect of a matched asset."""
    return F.when(mood.isin("tension", "action", "epic"), "push_in_slow").when(mood.isin("hopeful", "triumphant"), "pan_right").when(quality == "high", "push_in_slow").otherwise("static")


def segments(beats: DataFrame, best: DataFrame) -> DataFrame:
    """Timeline segments: offsets of every beat, and asset, motion and transition of the matched ones.

    ``best`` has ``row_id, entry_id, media_type, quality``.
    """
    matched = F.col("entry_id").isNotNull()
    mood = F.coalesce("mood", F.lit("neutral"))
    rows = offsets(beats).join(beats.select("row_id", mood.alias("mood")), "row_id").join(best.select("row_id", "entry_id", "media_type", "quality"), "row_id", "left")
    return rows.select(
        "row_id", "script_id", "start", "end", "duration", "mood", F.when(matched, F.col("media_type")).otherwise("text_card").alias("media_type"), "entry_id",
        F.when(matched, motion(F.col("mood"), F.col("quality"))).alias("motion"), F.when(matched, F.lit("cut")).alias("transition"),
    )


def render_items(beats: DataFrame, best: DataFrame) -> DataFrame:
    """Items for rendering: clips, stills with a caption, text cards; nothing for a beat with neither asset nor words.

    The first beat's card is cut to 60 characters and five seconds, later ones to 120 with an ellipsis.
    Items are placed without their words, which join them at the end.
    """
    words = F.coalesce("narration_verbatim", F.lit(""))
    rows = beats.select("row_id", "script_id", "beat_number", (words != "").alias("spoken"), duration_centis(F.col("duration")).alias("full"))
    rows = rows.join(best.select("row_id", "entry_id", "media_type", "quality"), "row_id", "left")
    first = beats.groupBy("script_id").agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(beat_order())])).alias("f")).select("script_id", F.col("f.o1").alias("first_row"))
    rows = rows.join(first, "script_id").withColumn("is_first", F.col("row_id") == F.col("first_row"))
    kind = F.when(F.col("media_type") == "video", "video").when(F.col("media_type") == "image", "image").when(F.col("spoken"), "text_card")
    rows = rows.withColumn("item_type", kind).where("item_type is not null")
    rows = rows.withColumn("centis", F.when((F.col("item_type") == "text_card") & F.col("is_first"), F.least("full", F.lit(500))).otherwise(F.col("full")))
    thin = written(rows.select("row_id", "script_id", "beat_number", "item_type", "is_first", "quality", "centis"), "render-items")
    placed = running_total(thin, ["script_id"], beat_order(), beat_bucket(), F.col("centis"), "at")
    placed = placed.join(beats.select("row_id", "script_id", words.alias("narration")), ["row_id", "script_id"])
    n = F.length("narration")
    card = F.when(F.col("is_first"), F.substring("narration", 1, 60)).when(n > 120, F.concat(F.substring("narration", 1, 120), F.lit("..."))).otherwise(F.col("narration"))
    overlay = F.when(F.col("item_type") == "text_card", card).when((F.col("item_type") == "image") & (n > 50), F.substring("narration", 1, 100)).otherwise("")
    motion_of = F.when(F.col("item_type") == "image", "push_in").when((F.col("item_type") == "video") & (F.col("quality") == "high"), "push_in_slow").otherwise("static")
    into = F.when(F.col("item_type") == "image", "dissolve").when((F.col("item_type") == "video") | F.col("is_first"), "cut").otherwise("fade")
    return placed.select(
        "row_id", "script_id", "item_type", (F.col("at") / F.lit(100.0)).alias("start_time"), (F.col("centis") / F.lit(100.0)).alias("duration"), overlay.alias("text_overlay"), motion_of.alias("motion"), into.alias("transition_in")
    )


def asset_summary(beats: DataFrame, best: DataFrame) -> DataFrame:
    """``script_id, n_beats, n_matched, share_matched``."""
    rows = beats.select("row_id", "script_id").join(best.select("row_id", F.lit(1).alias("hit")), "row_id", "left")
    out = rows.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_beats"), F.count("hit").alias("n_matched"))
    return out.withColumn("share_matched", F.round(F.col("n_matched") / F.col("n_beats"), 6))


def first_mentions(beats: DataFrame, entities: Column) -> DataFrame:
    """``script_id, entity, first_beat, n_beats`` of every entity of a script."""
    rows = beats.select("script_id", F.coalesce("beat_number", F.lit(-1)).alias("beat_number"), F.explode(F.array_distinct(F.transform(entities, F.lower))).alias("entity"))
    return rows.where("entity <> ''").groupBy("script_id", "entity").agg(F.min("beat_number").cast("bigint").alias("first_beat"), F.count(F.lit(1)).alias("n_beats"))


def transitions(beats: DataFrame, topic: Column) -> DataFrame:
    """``row_id, transition``: ``cut`` while the topic stays, ``dissolve`` where it changes, ``start`` on the first beat."""
    rows = beats.select("row_id", "script_id", "beat_number", F.coalesce(topic, F.lit("")).alias("topic"))
    seen = lagged(rows, ["script_id"], beat_order(), beat_bucket(), {"before": F.col("topic")})
    return seen.select("row_id", F.when(F.col("before").isNull(), "start").when(F.col("before") == F.col("topic"), "cut").otherwise("dissolve").alias("transition"))


def long_runs(beats: DataFrame, shot: Column) -> DataFrame:
    """``row_id`` of the beats that are the third or later of one shot type in a row."""
    rows = beats.select("row_id", "script_id", "beat_number", shot.alias("shot"))
    once = lagged(rows, ["script_id"], beat_order(), beat_bucket(), {"shot_1": F.col("shot")})
    twice = lagged(once, ["script_id"], beat_order(), beat_bucket(), {"shot_2": F.col("shot_1")})
    return twice.where((F.col("shot") == F.col("shot_1")) & (F.col("shot") == F.col("shot_2"))).select("row_id", "shot")


def overlay_style(beats: DataFrame, languages: DataFrame) -> DataFrame:
    """``row_id, title, subtitle, code, font, direction`` of each beat's overlay; the narration stands in for a missing title.

    The subtitle is the beat's own (column ``text_overlay_subtitle``, where there is one), at most 80 characters.
    """
    own = F.col("text_overlay_subtitle") if "text_overlay_subtitle" in beats.columns else F.lit("")
    rows = beats.select("row_id", F.substring(F.coalesce("text_overlay_title", "narration_verbatim", F.lit("")), 1, 120).alias("title"), F.substring(F.coalesce(own, F.lit("")), 1, 80).alias("subtitle"), T.language(F.col("narration_verbatim")).alias("code"))
    return rows.join(F.broadcast(languages), "code").select("row_id", "title", "subtitle", "code", "font", F.when(F.col("rtl"), "rtl").otherwise("ltr").alias("direction"))


def drawtext(title: Column, seconds: Column, rtl: Column) -> Column:
    """Filter string that draws a title: right-aligned for right-to-left scripts, else centred."""
    safe = title
    for mark in ("'", ":", "%"):
        safe = F.replace(safe, F.lit(mark), F.lit("\\" + mark))
    place = F.when(rtl, "x=w-text_w-50:y=h-160").otherwise("x=(w-text_w)/2:y=h-140")
    return F.concat(F.lit("drawtext=text='"), safe, F.lit("':fontsize=52:fontcolor=white:box=1:boxcolor=black@0.7:boxborderw=10:"), place, F.lit(":enable='between(t,0,"), seconds.cast("string"), F.lit(")'"))
