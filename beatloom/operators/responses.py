"""Reading the answers of media sources: one JSON text for each request, as rows of assets.

Defined cases: null, broken and empty answers give no asset; of several files the
widest counts, the first of equals; fields that are missing are empty or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FILES = "array<struct<link:string,width:int,height:int,duration:double>>"
_VIDEOS = f"struct<videos:array<struct<id:string,url:string,image:string,tags:array<string>,user:struct<name:string>,video_files:{_FILES}>>>"
_PHOTOS = "struct<photos:array<struct<id:string,url:string,alt:string,width:int,height:int,photographer:string,src:struct<large:string,original:string,medium:string,small:string>>>>"
_META = "map<string,struct<name:string,`*`:string>>"
_PAGES = f"struct<query:struct<pages:map<string,struct<pageid:string,extract:string,imageinfo:array<struct<url:string,thumburl:string,descriptionurl:string,mime:string,width:int,height:int,thumbwidth:int,thumbheight:int,extmetadata:{_META}>>>>>>"
#: Kinds of image that an archive's page may be taken for.
MIMES = ("image/jpeg", "image/png", "image/webp")


def _opened(df: DataFrame, response: str, schema: str) -> DataFrame:
    return df.withColumn("_r", F.from_json(F.col(f"`{response}`"), schema))


def _kept(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def videos(df: DataFrame, response: str) -> DataFrame:
    """Adds ``source_id, source_url, download_url, thumbnail_url, photographer, width, height, duration`` of each video with a file."""
    rows = _opened(df, response, _VIDEOS).select(*_kept(df), F.explode("_r.videos").alias("v"))
    ranked = F.transform("v.video_files", lambda f, i: F.struct(F.coalesce(f["width"], F.lit(0)).alias("w"), (-i).alias("place"), f.alias("f")))
    rows = rows.where("size(v.video_files) > 0").withColumn("best", F.array_max(F.transform(ranked, lambda x: F.struct(x["w"], x["place"])))).withColumn("f", F.get("v.video_files", -F.col("best.place")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        *_kept(df), F.col("v.id").alias("source_id"), empty(F.col("v.url")).alias("source_url"), empty(F.col("f.link")).alias("download_url"), empty(F.col("v.image")).alias("thumbnail_url"),
        empty(F.col("v.user.name")).alias("photographer"), F.coalesce("f.width", F.lit(0)).alias("width"), F.coalesce("f.height", F.lit(0)).alias("height"), F.coalesce("f.duration", F.lit(0.0)).alias("duration"),
    )


def photos(df: DataFrame, response: str) -> DataFrame:
    """Adds ``source_id, source_url, download_url, thumbnail_url, description, photographer, width, height`` of each photo: the large file, else the original; the medium preview, else the small one."""
    rows = _opened(df, response, _PHOTOS).select(*_kept(df), F.explode("_r.photos").alias("p"))
    empty = lambda *c: F.coalesce(*c, F.lit(""))
    return rows.select(
        *_kept(df), F.col("p.id").alias("source_id"), empty("p.url").alias("source_url"), empty("p.src.large", "p.src.original").alias("download_url"), empty("p.src.medium", "p.src.small").alias("thumbnail_url"),
        empty("p.alt").alias("description"), empty("p.photographer").alias("photographer"), F.coalesce("p.width", F.lit(0)).alias("width"), F.coalesce("p.height", F.lit(0)).alias("height"),
    )


def archive(df: DataFrame, response: str) -> DataFrame:
    """Adds ``source_id, source_url, download_url, thumbnail_url, description, license, width, height`` of each page that is an image of a kind in ``MIMES``.

    The licence is the short name, else the licence, else the attribution, else ``CC``.
    """
    rows = _opened(df, response, _PAGES).select(*_kept(df), F.explode("_r.query.pages").alias("key", "p")).withColumn("i", F.get("p.imageinfo", F.lit(0)))
    rows = rows.where(F.col("i.mime").isin(*MIMES)).withColumn("m", F.map_values("i.extmetadata"))
    named = lambda name: F.nullif(F.get(F.filter("m", lambda x: x["name"] == name), F.lit(0))["*"], F.lit(""))
    empty = lambda *c: F.coalesce(*c, F.lit(""))
    return rows.select(
        *_kept(df), F.coalesce("p.pageid", "key").alias("source_id"), empty("i.descriptionurl").alias("source_url"), empty("i.url").alias("download_url"), empty("i.thumburl", "i.url").alias("thumbnail_url"),
        F.substring(empty("p.extract"), 1, 200).alias("description"), F.coalesce(named("LicenseShortName"), named("License"), named("Attribution"), F.lit("CC")).alias("license"),
        F.coalesce("i.thumbwidth", "i.width", F.lit(0)).alias("width"), F.coalesce("i.thumbheight", "i.height", F.lit(0)).alias("height"),
    )


def thumbnail_size(quality: Column) -> Column:
    """``struct<width, height>`` of a preview by its quality."""
    best = quality == "maxresdefault"
    return F.struct(F.when(best, 1280).otherwise(640).alias("width"), F.when(best, 720).otherwise(480).alias("height"))


def voice_names(listing: Column) -> Column:
    """Names of the voices in a printed list: the lines that begin with ``Name:``."""
    return F.transform(F.regexp_extract_all(listing, F.lit(r"(?m)^Name:(.*)$"), F.lit(1)), lambda n: F.trim(n))


def fallback_seconds(n_bytes: Column) -> Column:
    """Length of a sound file whose length could not be read: 16000 bytes a second."""
    return n_bytes / F.lit(16000.0)
