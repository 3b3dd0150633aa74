"""The batch queue: status, readiness, resuming, format variants, pairing of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.operators.ordered import numbered

STATUSES = ("queued", "running", "done", "error", "blocked", "skipped")


def status(raw: Column) -> Column:
    """Status of the checked domain whatever its spelling; anything else is ``unknown``, null is ``queued``."""
    bare = F.lower(F.trim(F.coalesce(raw, F.lit("queued"))))
    return F.when(bare.isin(*STATUSES), bare).otherwise("unknown")


def summary(jobs: DataFrame) -> DataFrame:
    """Totals of the queue by status, in one row."""
    of = lambda s: F.count(F.when(status(F.col("status")) == s, 1))
    return jobs.agg(F.count(F.lit(1)).alias("total_jobs"), of("done").alias("completed"), of("error").alias("failed"), of("queued").alias("remaining"), of("blocked").alias("blocked"), of("running").alias("running"))


def preflight(jobs: DataFrame, scripts: DataFrame, clues: DataFrame) -> DataFrame:
    """``job_id, readiness, problems``: ready, gaps (can be made good) or blocked (no script).

    ``scripts`` and ``clues`` hold the ``script_id`` of what exists. The status is left alone.
    """
    there = lambda df, name: df.select("script_id").where("script_id is not null").distinct().withColumn(name, F.lit(True))
    rows = jobs.join(there(scripts, "has_script"), "script_id", "left").join(there(clues, "has_clue"), "script_id", "left")
    no_script, no_clue = F.col("has_script").isNull(), F.col("has_clue").isNull()
    no_audio, no_niche = F.col("audio").isNull(), F.col("niche").isNull()
    problems = F.concat_ws("; ", F.when(no_script, "script not found"), F.when(no_audio, "audio not found"), F.when(no_clue, "clue script missing"), F.when(no_niche, "niche pack not found"))
    readiness = F.when(no_script, "blocked").when(no_audio | no_clue | no_niche, "gaps").otherwise("ready")
    return rows.select("job_id", "script_id", "status", readiness.alias("readiness"), problems.alias("problems"))


def variants(checked: DataFrame) -> DataFrame:
    """``job_id, position, format_variant`` of the jobs to process: ready ones, then those with gaps, done ones passed over.

    Positions run over the whole queue; they are numbered range by range.
    """
    todo = checked.where((F.col("readiness") != "blocked") & (status(F.col("status")) != "done"))
    order = F.when(F.col("readiness") == "ready", 0).otherwise(1)
    placed = numbered(todo.select("job_id", order.alias("_order")), [F.col("_order"), F.col("job_id")], None, "position")
    return placed.select("job_id", F.col("position").cast("bigint").alias("position"), F.concat(F.lit("F"), (F.col("position") % 10 + 1).cast("string")).alias("format_variant"))


def stem(path: Column) -> Column:
    """File name without folder and last ending."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def title(file_stem: Column) -> Column:
    """Title of a stem: underlines to blanks, every run of letters capitalised (``mh60r`` is ``Mh60R``)."""
    runs = F.regexp_extract_all(F.replace(file_stem, F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def paired(scripts: DataFrame, audio: DataFrame) -> DataFrame:
    """Scripts with audio of the same stem: ``script, audio, title``; both inputs have a column ``path``."""
    left = scripts.select(F.col("path").alias("script"), stem(F.col("path")).alias("stem")).where("stem <> ''").distinct()
    right = audio.select(F.col("path").alias("audio"), stem(F.col("path")).alias("stem")).where("stem <> ''").distinct()
    return left.join(right, "stem").select("script", "audio", title(F.col("stem")).alias("title"))


def unpaired(scripts: DataFrame, audio: DataFrame) -> DataFrame:
    """Scripts without audio of the same stem."""
    left = scripts.select(F.col("path").alias("script"), stem(F.col("path")).alias("stem")).where("stem <> ''").distinct()
    right = audio.select(stem(F.col("path")).alias("stem"))
    return left.join(right, "stem", "left_anti").select("script")


def as_json(jobs: DataFrame) -> DataFrame:
    """``job_id, json``: each job as an object without its null fields."""
    return jobs.select("job_id", F.to_json(F.struct(*[F.col(c) for c in jobs.columns])).alias("json"))


def appended(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with new jobs behind it, numbered on from its length as ``J001`` and so forth."""
    size = jobs.agg(F.count(F.lit(1)).alias("_n"))
    added = numbered(new, [F.col("script_id"), F.col("title")], None, "_i").join(F.broadcast(size), F.lit(True))
    return jobs.unionByName(added.withColumn("job_id", F.format_string("J%03d", F.col("_n") + F.col("_i"))).drop("_n", "_i"), allowMissingColumns=True)
