"""The direct pipeline as a funnel: cheap checks first, the models' answers (landed tables) joined only to what they leave; each post gets one outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.functions import boxes as b
from glosswright.functions import text as t

LEAST_VISIBLE = 0.20


def first_reason(*checks: tuple[Column, Column | str]) -> Column:
    """The reason of the first check that fails, or null."""
    return F.coalesce(*[F.when(fails, F.lit(why) if isinstance(why, str) else why) for fails, why in checks])


def best_image(detections: DataFrame) -> DataFrame:
    """Of each post (``post_id, ordinal, image, columns, signatures``) the image of most columns, the first of equals."""
    return detections.groupBy("post_id").agg(F.max_by(F.struct("image", "columns", "signatures"), F.struct(F.size("columns"), -F.col("ordinal"))).alias("d")).select("post_id", "d.*")


def with_picture(posts: DataFrame, pictures: DataFrame) -> DataFrame:
    """Posts with ``image, image_height`` of their first ``.jpg`` by name, else their first file (``post_id, name, height``, as the files' heads tell); nulls without one."""
    first = pictures.groupBy("post_id").agg(F.min(F.struct((~F.col("name").endswith(".jpg")).alias("k"), F.col("name").alias("image"), F.col("height").alias("image_height"))).alias("p"))
    # Spark takes pictures for as small as the list of their files or archives, and would send them all through the driver.
    return posts.join(first.select("post_id", "p.image", "p.image_height").hint("merge"), "post_id", "left")


def too_dense(columns: Column, text: Column, image_height: Column) -> Column:
    """Whether characters are too small for the picture; null where its height isn't known."""
    return b.char_height(columns, text) < image_height / b.DENSITY_DIVISOR


def layout_checks(rows: DataFrame, kept: str = t.HAN_EXT) -> DataFrame:
    """``post_id, caption, n_images, columns`` with ``reason`` where images or layout rule a post out."""
    n, chars = F.coalesce(F.size("columns"), F.lit(0)), F.length(t.keep_chars(F.col("caption"), kept))
    aspect = b.mean_aspect(F.col("columns"))
    return rows.withColumn(
        "reason",
        first_reason(
            (F.coalesce("n_images", F.lit(0)) == 0, "no images"),
            (n <= 0, "no columns"),
            (n > F.greatest(chars, F.lit(1)), "more columns than characters"),
            (aspect < b.LEAST_ASPECT, "horizontal layout"),
        ),
    )


def funnel(posts: DataFrame, readings: DataFrame, sightings: DataFrame, kept: str = t.HAN_EXT) -> DataFrame:
    """``posts`` (``post_id, caption, n_images, columns, image_height``), ``readings`` (``post_id, reply``) and ``sightings`` (``post_id, reply``) to outcomes.

    A missing reply is a failed call: no calligraphy, nothing visible.
    """
    checked = layout_checks(posts, kept)
    out = [checked.where("reason IS NOT NULL")]
    left = checked.where("reason IS NULL").join(readings.select("post_id", t.reply_fields(F.col("reply"), kept).alias("r")), "post_id", "left")
    left = left.withColumn("clean_text", F.coalesce("r.clean_text", F.lit("")))
    bad = t.verify_label(F.col("clean_text"), F.col("caption"), kept)
    left = left.withColumn(
        "reason",
        first_reason(
            (~F.coalesce("r.has_calligraphy", F.lit(False)), "not calligraphy"),
            (F.col("clean_text") == "", "no text in caption"),
            (bad.isNotNull(), bad),
            (F.size("columns") > F.length("clean_text"), "more columns than label characters"),
        ),
    ).drop("r")
    out.append(left.where("reason IS NOT NULL"))
    left = left.where("reason IS NULL").join(sightings.select("post_id", t.reply_fields(F.col("reply"), kept)["high_count"].alias("high")), "post_id", "left")
    ratio = F.coalesce("high", F.lit(0)) / F.length("clean_text")
    height = b.char_height(F.col("columns"), F.col("clean_text"))
    left = left.withColumn("visible_ratio", F.bround(ratio, 3)).withColumn("avg_char_h", height)
    left = left.withColumn("reason", first_reason((ratio < LEAST_VISIBLE, "low visibility"), (too_dense(F.col("columns"), F.col("clean_text"), F.col("image_height")), "too dense"))).drop("high")
    lines = b.allocated_lines(F.col("clean_text"), F.transform("columns", lambda c: c["height"]), keep_empty=True)
    left = left.withColumn("lines", F.when(F.col("reason").isNull(), lines)).withColumn("label", F.array_join("lines", "\n")).withColumn("char_counts", F.transform("lines", F.length))
    left = left.withColumn("coverage", t.coverage(F.col("clean_text"), F.col("caption"), kept))
    out.append(left)
    rows = out[0].unionByName(out[1], True).unionByName(out[2], True)
    return rows.withColumn("status", F.when(F.col("reason").isNull(), "SUCCESS").otherwise("FAIL"))


def pass_rate(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("passed")).withColumn("rate", F.col("passed") / F.greatest("n", F.lit(1)) * 100)


def job_state(jobs: DataFrame) -> DataFrame:
    """Remote jobs (``job, state, n``) with ``outcome``: done, failed (its replies are empty) or open."""
    state = F.coalesce("state", F.lit(""))
    return jobs.withColumn("outcome", F.when(F.contains(state, F.lit("SUCCEEDED")), "done").when(state.rlike("FAILED|EXPIRED|CANCELLED"), "failed").otherwise("open"))
