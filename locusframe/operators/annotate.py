"""Masks from called alleles, mask adjustment, allele calling and the ground truth.

Masks are sparse: a row (hid, dye, px) stands for a 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import DETECTION_FLOOR, NON_AUTOSOMAL
from ..functions.names import donors_of_sample, threshold_mask
from .panel import allele_info, nearest_allele
from .signal import KEYS, peak_boundary, peak_in_or_near_run, runs_of_ones, scaler_places, with_pixels


def drop_non_autosomal(calls: DataFrame) -> DataFrame:
    return calls.where(~F.col("marker").isin(NON_AUTOSOMAL))


def allele_spans(calls: DataFrame, scaler: DataFrame, on: str = "hid") -> DataFrame:
    """The distinct rows of calls (hid, bp_left, bp_right, more) with l and r, the pixels of both ends."""
    return with_pixels(calls.distinct(), scaler_places(scaler, on), on, l=F.col("bp_left"), r=F.col("bp_right"))


def spans_to_mask(spans: DataFrame) -> DataFrame:
    """Distinct pixels l to r - 1; equal ends make an empty bin. Of spans that overlap, each gives the pixels after
    the furthest one before it, so no pixel is made twice."""
    before = F.max("r").over(Window.partitionBy(*KEYS).orderBy("l", "r").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.where("l < r").select(*KEYS, F.greatest(F.col("l"), before).alias("l"), "r").where("l < r")
    return new.select(*KEYS, F.explode(F.sequence("l", F.col("r") - 1)).alias("px"))


def segmentation_mask(calls: DataFrame, panel: DataFrame, scaler: DataFrame, on: str = "hid") -> DataFrame:
    """hid, dye, px inside the bin of a called allele (calls: hid, dye, marker, allele). ``on`` names
    the scaler of a call where several profiles share one. Alleles that are not in the panel lie below the
    range, where a bin is empty; they are left out before anything is joined."""
    keys = dict.fromkeys([*KEYS, on])
    return spans_to_mask(allele_spans(allele_info(calls, panel).where("in_panel").select(*keys, "bp_left", "bp_right"), scaler, on))


def later_runs_win(mask_runs: DataFrame, covers: DataFrame) -> DataFrame:
    """Pixels set when runs are processed in order, each first clearing its own pixels: a pixel stays
    if the last run that covers it (covers: hid, dye, run, left, right) is not before the run it is in."""
    covered = covers.select(*KEYS, "run", F.explode(F.sequence("left", "right")).alias("px")).groupBy(*KEYS, "px").agg(F.max("run").alias("_last"))
    own = mask_runs.select(*KEYS, F.col("run").alias("_own"), F.explode(F.sequence("start", "end")).alias("px"))
    joined = covered.join(own, [*KEYS, "px"], "left")
    return joined.where(F.col("_own").isNull() | (F.col("_last") >= F.col("_own"))).select(*KEYS, "px")


def adjust_top(pixels: DataFrame, on: str = "mask", floor: int = DETECTION_FLOOR) -> DataFrame:
    """Each run of the mask becomes its peak; runs without a peak of ``floor`` go."""
    runs = runs_of_ones(pixels, F.col(on))
    peaks = peak_in_or_near_run(pixels, runs, floor)
    return later_runs_win(runs, peaks.select(*KEYS, "run", F.col("peak").alias("left"), F.col("peak").alias("right")))


def adjust_complete(pixels: DataFrame, on: str = "mask", floor: int = DETECTION_FLOOR) -> DataFrame:
    """Each run of the mask becomes the whole peak it is in or near."""
    runs = runs_of_ones(pixels, F.col(on))
    peaks = peak_in_or_near_run(pixels, runs, floor).withColumnRenamed("peak", "px")
    bounds = peak_boundary(pixels, floor).select(*KEYS, "px", "left", "right")
    return later_runs_win(runs, peaks.select(*KEYS, "px", "run").join(bounds, [*KEYS, "px"]))


def call_alleles(pixels: DataFrame, panel: DataFrame, threshold: float = 0.5, digits: int | None = None) -> DataFrame:
    """hid, dye, marker, allele, height from pixels (hid, dye, px, bp, rfu, prob): runs of positive
    pixels take the allele nearest their mean base pair; an allele's height is its highest pixel."""
    grouped = pixels.where(threshold_mask(F.col("prob"), threshold) == 1).withColumn("_g", F.col("px") - F.row_number().over(Window.partitionBy(*KEYS).orderBy("px")))
    runs = grouped.groupBy(*KEYS, "_g").agg(F.avg("bp").alias("bp"), F.max("rfu").alias("height"))
    return nearest_allele(runs, panel, digits=digits).groupBy(*KEYS, "marker", "allele").agg(F.max("height").alias("height"))


def human_baseline(calls: DataFrame) -> DataFrame:
    """The analyst's calls as prediction, without non-autosomal markers."""
    return drop_non_autosomal(calls.where("source = 'analyst'")).withColumn("source", F.lit("predicted"))


def donor_alleles(samples: DataFrame, donors: DataFrame, panel: DataFrame) -> DataFrame:
    """hid, marker, alleles (distinct, sorted as text) of each sample's donors, with the marker's dye.
    samples: hid, name; donors: donor, marker, allele1, allele2."""
    wanted = samples.select("hid", F.explode(donors_of_sample(F.col("name"))).alias("donor")).groupBy("hid").agg(F.array_sort(F.collect_set("donor")).alias("_donors"))
    known = donors.select("donor", "marker", F.explode(F.array("allele1", "allele2")).alias("allele")).distinct()
    # samples of the same donors have the same alleles, which are put together once
    both = wanted.select("_donors").distinct().withColumn("donor", F.explode("_donors")).join(known, "donor")
    sets = both.groupBy("_donors", "marker").agg(F.array_sort(F.collect_set("allele")).alias("alleles"))
    with_dye = sets.join(panel.groupBy("marker").agg(F.min("dye").alias("dye")), "marker", "left")
    return wanted.join(with_dye, "_donors").select("hid", "dye", "marker", "alleles")


def attach_ground_truth(calls: DataFrame, donors: DataFrame) -> DataFrame:
    """calls (hid, marker, allele, height) as source analyst, donors' alleles (hid, marker, alleles) as source donor."""
    truth = donors.select("hid", "marker", F.explode("alleles").alias("allele")).withColumn("height", F.lit(None).cast("double")).withColumn("source", F.lit("donor"))
    return calls.select("hid", "marker", "allele", F.col("height").cast("double").alias("height")).withColumn("source", F.lit("analyst")).unionByName(truth)


SOURCES = ("predicted", "analyst", "donor")


def allele_comparison(calls: DataFrame, panel: DataFrame, truth: str = "donor") -> DataFrame:
    """One row per hid, marker, allele of any source: which sources have it, the heights of the
    prediction and the analyst, TP, FP or FN against ``truth`` (null if neither has it), and the bin."""
    has = {f"in_{x}": F.bool_or(F.col("source") == x) for x in SOURCES}
    high = lambda x: F.max(F.when(F.col("source") == x, F.col("height")))
    found = calls.where(F.col("source").isin(*SOURCES)).groupBy("hid", "marker", "allele").agg(*[c.alias(n) for n, c in has.items()], high("predicted").alias("height"), high("analyst").alias("analyst_height"))
    p, t = F.col("in_predicted"), F.col(f"in_{truth}")
    return allele_info(found.withColumn("kind", F.when(p & t, "TP").when(p, "FP").when(t, "FN")), panel)


def comparison_masks(calls: DataFrame, panel: DataFrame, scaler: DataFrame, on: str = "hid") -> DataFrame:
    """source, hid, dye, px: the segmentation mask of each source (calls: source, hid, dye, marker, allele), all in one pass."""
    named = calls.where(F.col("source").isin(*SOURCES)).withColumn("_scaler", F.col(on)).withColumn("hid", F.struct(F.col("hid").alias("key"), "source"))
    return segmentation_mask(named, panel, scaler.withColumnRenamed(on, "_scaler"), "_scaler").select("hid.source", F.col("hid.key").alias("hid"), "dye", "px")
