"""Pixel and allele metrics; every one is a single pass of conditional sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LOCUS_THRESHOLDS
from ..functions.names import locus_allele_key, threshold_mask


def both_rates(tp: Column, fp: Column, fn: Column, empty: Column) -> list[Column]:
    """precision, recall and F1; ``empty`` stands for 0 / 0."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), empty), F.coalesce(F.try_divide(tp, tp + fn), empty)
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def pixel_confusion(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn over all pixels (prob, mask)."""
    y, p = F.col("mask").cast("int"), threshold_mask(F.col("prob"), threshold)
    count = lambda on: F.coalesce(F.sum(F.when(on, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return pixels.agg(count((y == 1) & (p == 1)).alias("tp"), count((y == 0) & (p == 1)).alias("fp"), count((y == 1) & (p == 0)).alias("fn"))


def pixel_scores(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """precision, recall, f1; null where nothing can be counted."""
    return pixel_confusion(pixels, threshold).select(*both_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.lit(None).cast("double")))


def average_binary_iou(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean over images of intersection by union (prob above threshold); an empty union counts as 0."""
    y, p = F.col("mask").cast("int"), threshold_mask(F.col("prob"), threshold, inclusive=False)
    each = pixels.groupBy("hid").agg(F.sum(y * p).alias("i"), F.sum(y + p - y * p).alias("u"))
    return each.agg(F.avg(F.coalesce(F.try_divide("i", "u"), F.lit(0.0))).alias("iou"))


def per_group(rows: DataFrame, groups: DataFrame | None, *sums: Column) -> DataFrame:
    """The sums of all rows, or one row of them for each of the groups (a table of their keys), with or without rows."""
    if groups is None:
        return rows.agg(*sums)
    return groups.join(rows.groupBy(*groups.columns).agg(*sums), groups.columns, "left")


def pixel_metrics(pixels: DataFrame, threshold: float = 0.5, groups: DataFrame | None = None) -> DataFrame:
    """metric, value of precision, recall, F1 and IoU of the pixels, all from one aggregate by profile; for each
    of the groups (whose keys the pixels have), if given."""
    keys = [] if groups is None else groups.columns
    y, p, q = F.col("mask").cast("int"), threshold_mask(F.col("prob"), threshold), threshold_mask(F.col("prob"), threshold, inclusive=False)
    each = pixels.groupBy(*keys, "hid").agg(F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum(y * (1 - p)).alias("fn"), F.sum(y * q).alias("i"), F.sum(y + q - y * q).alias("u"))
    whole = per_group(each, groups, *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg(F.coalesce(F.try_divide("i", "u"), F.lit(0.0))).alias("iou"))
    rates = whole.select(*keys, "iou", *both_rates(*[F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn")], F.lit(None).cast("double")))
    named = {"pixel_precision": "precision", "pixel_recall": "recall", "pixel_f1": "f1", "average_binary_iou": "iou"}
    return rates.select(*keys, F.explode(F.create_map(*[x for k, c in named.items() for x in (F.lit(k), F.col(c))])).alias("metric", "value"))


def locus_table(spark) -> DataFrame:
    return spark.createDataFrame([(marker, *limits) for marker, limits in LOCUS_THRESHOLDS.items()], "marker string, low int, high int")


def locus_thresholds(spark, locus: str | None = None, low_or_high: str | None = None, min_rfu: int | None = None) -> DataFrame:
    """marker, above (heights from it on; strictly when below is set), below. The mode goes before
    min_rfu; a min_rfu of 0 is none."""
    if low_or_high not in (None, "low", "high", "between"):
        raise ValueError(f"unknown mode {low_or_high}")
    rows = locus_table(spark)
    if locus is not None:
        if locus not in LOCUS_THRESHOLDS:
            raise ValueError(f"unknown locus {locus}")
        rows = rows.where(F.col("marker") == locus)
    above = {"low": F.col("low"), "high": F.col("high"), "between": F.col("low")}.get(low_or_high, F.lit(min_rfu or None).cast("int"))
    below = F.col("high") if low_or_high == "between" else F.lit(None).cast("int")
    return rows.select("marker", above.alias("above"), below.alias("below"))


def passing(calls: DataFrame, height: Column | None = None) -> DataFrame:
    """calls (height, above, below) that pass their thresholds; no threshold and one of 0 let all pass."""
    h = F.col("height") if height is None else height
    between = (h > F.col("above")) & (h < F.col("below"))
    return calls.where(F.when(F.col("below").isNotNull(), between).otherwise(F.col("above").isNull() | (F.col("above") == 0) | (h >= F.col("above"))))


def locus_allele_set(calls: DataFrame, thresholds: DataFrame | None = None, min_rfu: float | None = None, strict: bool = False) -> DataFrame:
    """hid (and source), key of the calls that pass the thresholds; duplicates are an error if strict."""
    keys = [c for c in ("hid", "source") if c in calls.columns]
    kept = calls
    if thresholds is not None:
        height = F.col("height")
        if strict:
            height = F.coalesce(height, F.raise_error(F.lit("a call without height has no threshold")).cast("double"))
        kept = passing(calls.join(thresholds, "marker"), height)
    elif min_rfu:
        kept = calls.where(F.col("height") >= min_rfu)
    sets = kept.select(*keys, locus_allele_key(F.col("marker"), F.col("allele")).alias("key")).groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("_n"))
    if strict:
        sets = sets.withColumn("key", F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate allele")).cast("string")).otherwise(F.col("key")))
    return sets.drop("_n")


def allele_flags(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """hid, key, p, t: in the predicted set, in the true one. One shuffle brings both together."""
    both = predicted.select("hid", "key", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select("hid", "key", F.lit(0).alias("p"), F.lit(1).alias("t")))
    return both.groupBy("hid", "key").agg(F.max("p").alias("p"), F.max("t").alias("t"))


def allele_confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    count = lambda on: F.coalesce(F.sum(F.when(on, 1).otherwise(0)), F.lit(0)).cast("bigint")
    p, t = F.col("p") == 1, F.col("t") == 1
    return allele_flags(predicted, truth).agg(count(p & t).alias("tp"), count(p & ~t).alias("fp"), count(~p & t).alias("fn"))


def allele_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return allele_confusion(predicted, truth).select(*both_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0.0)))


VARIANTS = ("none", "between", "low", "high")


def evaluation_suite(pixels: DataFrame, predicted: DataFrame, truth: DataFrame, threshold_truth: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """metric, variant, value: IoU and pixel rates, allele rates without thresholds, and allele
    precision and recall for the variants between, low and high, which share one pass; for each of the groups
    (whose keys all tables have), if given."""
    spark = pixels.sparkSession
    keys = [] if groups is None else groups.columns
    limits = locus_table(spark)

    def flagged(calls: DataFrame, limited: bool, shift: int) -> DataFrame:
        """hid, key and a bit for every variant that a call counts in, from ``shift`` on."""
        h = F.col("height")
        low, high = (h >= F.col("low"), h >= F.col("high")) if limited else (F.lit(True), F.lit(True))
        passed = {"none": F.lit(True), "between": (h > F.col("low")) & (h < F.col("high")) if limited else F.lit(True), "low": low, "high": high}
        bits = reduce(Column.bitwiseOR, [F.when(passed[x], 1 << (shift + i)).otherwise(0) for i, x in enumerate(VARIANTS)])
        joined = calls.join(F.broadcast(limits), "marker", "left")  # 27 rows
        return joined.select(*keys, "hid", locus_allele_key(F.col("marker"), F.col("allele")).alias("key"), bits.alias("bits"))

    # an allele is one row for all variants and both sets
    flags = flagged(predicted, True, 0).unionByName(flagged(truth, threshold_truth, len(VARIANTS))).groupBy(*keys, "hid", "key").agg(F.bit_or("bits").alias("bits"))
    has = lambda i: F.col("bits").bitwiseAND(1 << i) != 0
    count = lambda on: F.count(F.when(on, 1))
    pairs = [(x, has(i), has(i + len(VARIANTS))) for i, x in enumerate(VARIANTS)]
    whole = per_group(flags, groups, *[c for x, p, t in pairs for c in (count(p & t).alias(f"tp_{x}"), count(p & ~t).alias(f"fp_{x}"), count(~p & t).alias(f"fn_{x}"))])
    found = F.array(*[F.struct(F.lit(x).alias("variant"), *[F.coalesce(f"{n}_{x}", F.lit(0)).alias(n) for n in ("tp", "fp", "fn")]) for x in VARIANTS])
    rates = whole.select(*keys, F.explode(found).alias("_s")).select(*keys, "_s.*").select(*keys, "variant", *both_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0.0)))
    alleles = rates.select(*keys, "variant", F.explode(F.create_map(F.lit("allele_precision"), F.col("precision"), F.lit("allele_recall"), F.col("recall"), F.lit("allele_f1"), F.col("f1"))).alias("metric", "value"))
    alleles = alleles.where("variant = 'none' or metric <> 'allele_f1'")
    pixel = pixel_metrics(pixels, groups=groups).withColumn("variant", F.lit("none"))
    return pixel.unionByName(alleles).select(*keys, "metric", "variant", "value")


def dice_loss(pixels: DataFrame) -> DataFrame:
    p, y = F.col("prob"), F.col("mask").cast("double")
    return pixels.agg((1 - (2 * F.sum(p * y) + 1) / (F.sum(p) + F.sum(y) + 1)).alias("loss"))


def binary_accuracy(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pixels.agg(F.avg((threshold_mask(F.col("prob"), threshold) == F.col("mask").cast("int")).cast("double")).alias("accuracy"))


def running_mean_loss(batches: DataFrame, keys: list[str], loss: str = "loss") -> DataFrame:
    """The mean loss of the batches of each epoch (keys), which a running mean ends in."""
    return batches.groupBy(*keys).agg(F.avg(loss).alias("loss"))


def fold_means(metrics: DataFrame) -> DataFrame:
    keys = [c for c in ("metric", "variant") if c in metrics.columns]
    return metrics.groupBy(*keys).agg(F.avg("value").alias("mean_value"))


def load_report(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def profiles_per_noc(profiles: DataFrame) -> DataFrame:
    """noc, prefix, name, n: every profile with the number of profiles of its prefix."""
    counts = profiles.groupBy("noc", "prefix").agg(F.count(F.lit(1)).alias("n"))
    return profiles.select("noc", "prefix", "name").join(counts, ["noc", "prefix"])
