"""Readers and writers of the studio's files: libraries, queues, scripts, folders, packs.

Every reader has an explicit schema; a missing file gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.session import exists


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _TEXTS, _NUMBER, _WHOLE = T.StringType(), T.ArrayType(T.StringType()), T.DoubleType(), T.IntegerType()

ENTRY = _struct(
    id=_TEXT, type=_TEXT, file=_TEXT, file_path=_TEXT, source_type=_TEXT, source_url=_TEXT, topic=_TEXT, entities=_TEXTS, actions=_TEXTS, environment=_TEXTS, description=_TEXT, quality=_TEXT,
    duration=_NUMBER, width=_WHOLE, height=_WHOLE, license=_TEXT, strictness=_TEXT, times_used=_WHOLE, created_at=_TEXT, cataloged_by=_TEXT,
)
JOB = _struct(
    id=_TEXT, script=_TEXT, audio=_TEXT, clue=_TEXT, niche=_TEXT, title=_TEXT, status=_TEXT, progress=_NUMBER, error=_TEXT, output=_TEXT, started_at=_TEXT, finished_at=_TEXT, format_variant=_TEXT
)


def library(spark: SparkSession, path: str) -> DataFrame:
    """Entries of library documents (``entries`` by id); the path of a hit is ``file_path`` or ``file``."""
    schema = T.StructType([T.StructField("entries", T.MapType(T.StringType(), ENTRY))])
    found = spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)
    rows = found.select(F.explode("entries").alias("key", "e"))
    entry = rows.select("key", "e.*").withColumn("id", F.coalesce("id", "key")).drop("key")
    return entry.withColumns({"file_path": F.coalesce("file_path", "file"), "quality": F.coalesce("quality", F.lit("medium"))})


def queue(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of queue documents with their defaults, and the queue's own fields."""
    header = [T.StructField(n, T.StringType()) for n in ("queue_id", "created_at", "niche", "format", "style")]
    schema = T.StructType([*header, T.StructField("jobs", T.ArrayType(JOB))])
    found = spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)
    rows = found.select("queue_id", F.posexplode("jobs").alias("position", "j"))
    return rows.select("queue_id", "position", "j.*").withColumns({"status": F.coalesce("status", F.lit("queued")), "progress": F.coalesce("progress", F.lit(0.0)), "format_variant": F.coalesce("format_variant", F.lit("F1"))})


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text`` of the text files below a folder, each whole."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("text"))


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, length`` of the files of a folder in the order of their paths; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "length").orderBy("path")


def from_folders(spark: SparkSession, scripts_folder: str, audio_folder: str, niche: str) -> DataFrame:
    """Jobs of the scripts with audio of the same stem: ``script, audio, title, niche, status``."""
    from beatloom.operators.jobs import paired

    pairs = paired(listing(spark, scripts_folder, "*.txt"), listing(spark, audio_folder, "*.mp3"))
    return pairs.withColumns({"niche": F.lit(niche), "status": F.lit("queued")})


def save_queue(jobs: DataFrame, header: dict[str, str], path: str) -> None:
    """Writes jobs as one document with the queue's own fields and the number of jobs by status; null fields are left out.

    A queue is one document, as its readers expect, and as such read and written by one task.
    """
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    fields = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in jobs.columns])))
    document = jobs.agg(F.count(F.lit(1)).alias("total_jobs"), of("done").alias("completed"), of("error").alias("failed"), fields.alias("jobs"))
    document.select(*[F.lit(v).alias(k) for k, v in header.items()], "*").coalesce(1).write.mode("overwrite").json(path)


def pack(spark: SparkSession, path: str) -> DataFrame:
    """``category, name, value`` of a pack's lists; an unreadable pack is empty."""
    rows: list[tuple] = []
    try:
        import yaml

        text = spark.read.text(path, wholetext=True).first()["value"] if exists(spark, path) else ""
        content = yaml.safe_load(text) or {}
        for category, value in content.items():
            if isinstance(value, dict):
                rows += [(category, str(k), str(x)) for k, v in value.items() for x in (v if isinstance(v, list) else [v])]
            else:
                rows += [(category, None, str(x)) for x in (value if isinstance(value, list) else [value])]
    except Exception:  # noqa: BLE001 - whatever makes a pack unreadable, PyYAML missing included
        rows = []
    return spark.createDataFrame(rows, "category string, name string, value string")


def save_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Writes rows as JSON lines without null fields, stamped with the time of writing."""
    writer = df.withColumn("saved_at", F.current_timestamp()).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)
