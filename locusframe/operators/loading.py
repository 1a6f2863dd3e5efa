"""Joins that put a data set together from files, annotations and ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profiles_with_annotation(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """files (stem, more) with their annotation's columns."""
    return files.join(annotations, "stem")


def profiles_without_annotation(files: DataFrame, annotations: DataFrame) -> DataFrame:
    return files.join(annotations, "stem", "left_anti")


def profiles_with_ladder(files: DataFrame, ladders: DataFrame) -> DataFrame:
    """files (stem) with ladder_path; null where there is none."""
    return files.join(ladders.select("stem", "ladder_path"), "stem", "left")


def skip_missing_ladder(profiles: DataFrame) -> DataFrame:
    return profiles.where("ladder_path is not null")


def drop_incomplete_profiles(profiles: DataFrame, pixels: DataFrame, calls: DataFrame) -> DataFrame:
    """Profiles with data and with calls. Their hids are made distinct first: they take little room in a file, so Spark
    would broadcast all of them."""
    have = lambda rows: rows.select("hid").distinct()
    return profiles.join(have(pixels), "hid", "left_semi").join(have(calls), "hid", "left_semi")


def profile_by_name(profiles: DataFrame, stem: str) -> DataFrame:
    """The profile of that stem; none if unknown, an error for several."""
    found = profiles.where(F.col("stem") == stem)
    many = F.count(F.lit(1)).over(Window.partitionBy("stem"))
    return found.withColumn("stem", F.when(many > 1, F.raise_error(F.lit("more than one profile")).cast("string")).otherwise(F.col("stem")))


def align_predictions(images: DataFrame, predictions: DataFrame) -> DataFrame:
    return images.join(predictions, "hid")


def profile_dimensions(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("hid").agg(F.countDistinct("dye").alias("height"), (F.max("px") + 1).cast("bigint").alias("width"))


def validate_image_format(pixels: DataFrame, width: int = 4096) -> DataFrame:
    """hid, dye, ok: exactly the pixels 0 .. width - 1."""
    n, low, high = F.count("px"), F.min("px"), F.max("px")
    distinct = F.countDistinct("px")
    return pixels.groupBy("hid", "dye").agg(((n == width) & (distinct == width) & (low == 0) & (high == width - 1)).alias("ok"))


def latest_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row (by order) of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
