"""The searches answer the beats whose id is divisible by 20, with their own fields."""

from beatloom.plans import studio
from pyspark.sql import functions as F


def test_requests_are_the_beats(spark, sf_dir):
    beats = spark.read.parquet(f"{sf_dir}/beats.parquet").where("row_id % 20 = 0")
    rows = {r["request_id"]: r for r in studio._requests(spark, sf_dir).collect()}
    visuals = {r["row_id"]: r["primary_visual"] for r in beats.select("row_id", "primary_visual").collect()}
    assert rows.keys() == visuals.keys()
    for key, v in visuals.items():
        if v:
            assert (rows[key]["query"], rows[key]["entities"], rows[key]["strictness"]) == (v["search_query"] or "", v["entities"] or [], v["strictness"])


def test_every_request_is_searched_by_text(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/beats.parquet").where(F.col("row_id") % 20 == 0).count()
    assert studio.search_text(spark, sf_dir).select("request_id").distinct().count() == n
