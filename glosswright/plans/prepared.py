"""Prepared posts: a caption with its boxes and where it comes from, ready for readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.functions import boxes as b
from glosswright.operators.relational import first_image, projected, unseen
from glosswright.sources.files import PROVENANCE

#: What a prepared post says of its origin.
ORIGIN = ("post_url", "author_url", "author_name", "author_id", "publish_time", "scrape_time", "post_id_fb", "post_id_numeric", "group_id", "group_name")


def prepared(posts: DataFrame, pictures: DataFrame, detections: DataFrame, source: str, done: DataFrame | None = None) -> DataFrame:
    """``post_id, original_metadata, yolo_columns, yolo_signatures, facebook, source, image`` of posts (``post_id, caption`` and what there is of their origin) that aren't ``done``.

    A post's picture is the first ``.jpg`` by name, else the first file; posts without one go. ``detections`` are raw boxes by picture (``post_id, name, boxes``): confident ones from
    right to left, columns and signatures apart; none where the picture has none. A missing caption is empty.
    """
    if done is not None:
        posts = unseen(posts, done, "post_id")
    kinds = dict(c.strip().rsplit(" ", 1) for c in PROVENANCE.split(","))
    origin = projected(posts, {"post_id": "string", "caption": "string", **{k: kinds[k] for k in ORIGIN}})
    rows = origin.join(first_image(pictures).withColumnRenamed("name", "image"), "post_id")
    found = detections.select("post_id", F.col("name").alias("image"), b.with_layout(F.col("boxes")).alias("boxes"))
    rows = rows.join(found, ["post_id", "image"], "left")
    boxes = lambda kind: F.coalesce(b.of_class(F.col("boxes"), kind), F.array().cast(f"array<{b.BOX}>"))
    return rows.select(
        "post_id",
        F.coalesce("caption", F.lit("")).alias("original_metadata"),
        boxes(0).alias("yolo_columns"),
        boxes(1).alias("yolo_signatures"),
        F.struct(*ORIGIN).alias("facebook"),
        F.lit(source).alias("source"),
        "image",
    )
