"""One path from listed files to calibrated, annotated profiles."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import sample_noc, sample_prefix
from ..sources.abif import any_number, channel_samples, channel_tops, file_channels
from ..sources.scratch import written
from .annotate import adjust_complete, adjust_top, attach_ground_truth, donor_alleles, segmentation_mask
from .loading import drop_incomplete_profiles, profiles_with_annotation, profiles_with_ladder, skip_missing_ladder
from .panel import dye_row_of_marker, resolve_panel
from .signal import KEYS, grid_of, scaler_arrays, scaler_rows, segment_arrays, spread, trace_rows, valid_knots
from .splits import grouped_holdout_split, limit_profiles

DEFAULT = "default"
ADJUSTMENTS = {"top": adjust_top, "complete": adjust_complete}


class Dataset(NamedTuple):
    profiles: DataFrame  # hid, annotation, report, panel_id
    pixels: DataFrame  # hid, dye, px, rfu
    scaler: DataFrame  # hid, px, bp
    calls: DataFrame  # hid, marker, allele, height, source
    mask: DataFrame  # hid, dye, px
    outcomes: DataFrame  # hid, status: kept, or the first reason why not
    traces: DataFrame  # hid, dye, first, rfu: the pixels as one row per dye
    places: DataFrame  # hid, first, bps: the scaler as one row per profile


#: Why a file is no profile, in the order in which the reasons are looked at.
REASONS = ("no annotation", "no ladder", "not chosen", "not ABIF", "channels missing", "standard invalid", "no calls")


def chosen_files(listed: DataFrame, limit: int | None, holdout: tuple[float, int] | None, seed: int | str | None) -> DataFrame:
    """The hid of the files that are to be read: one part of a grouped hold-out, then the first ``limit``,
    by name or in seeded order. Nothing is decoded for this."""
    if holdout is not None:
        fraction, part = holdout
        named = listed.select("hid", sample_noc(F.col("hid")).alias("noc"), sample_prefix(F.col("hid")).alias("prefix"))
        listed = grouped_holdout_split(named, fraction, 0 if seed is None else seed).where(F.col("part") == part)
    return (listed if limit is None else limit_profiles(listed, limit, "hid", seed)).select("hid")


def load_profiles(
    samples: DataFrame,
    annotations: DataFrame,
    reported: DataFrame,
    panel: DataFrame,
    ladders: DataFrame | None = None,
    ladder_panels: DataFrame | None = None,
    skip_without_ladder: bool = False,
    adjustment: str | None = None,
    donors: DataFrame | None = None,
    limit: int | None = None,
    holdout: tuple[float, int] | None = None,
    seed: int | str | None = None,
) -> Dataset:
    """samples: stem, content (scan_profiles); annotations: stem, annotation, report; reported: sample,
    marker, allele, height (read_allele_report); panel: the kit's panel; ladders: stem, ladder_path, and
    ladder_panels: the adjusted panels of valid ladders with panel_id, the ladder's path; donors: donor,
    marker, allele1, allele2. ``limit`` and ``holdout`` (fraction, part) choose files before they are decoded.
    Files without annotation, whose data cannot be decoded or calibrated, or without any call of a marker
    of the kit are left out; ``outcomes`` has every file with what became of it. For the outcomes standards alone are
    decoded; the other channels are when pixels are asked for, from the files again."""
    if adjustment is not None and adjustment not in ADJUSTMENTS:
        raise ValueError(f"unknown adjustment {adjustment}")
    named = profiles_with_annotation(samples, annotations).withColumnRenamed("stem", "hid")
    listed = named.select("hid", "annotation", "report").withColumn("ladder_id", F.lit(None).cast("string"))
    if ladders is not None:
        with_path = profiles_with_ladder(listed.drop("ladder_id").withColumnRenamed("hid", "stem"), ladders)
        kept = skip_missing_ladder(with_path) if skip_without_ladder else with_path
        listed = kept.withColumnRenamed("stem", "hid").withColumnRenamed("ladder_path", "ladder_id")
    with_ladder = listed.select("hid")
    if limit is not None or holdout is not None:
        listed = listed.join(written(chosen_files(listed, limit, holdout, seed), "chosen-files"), "hid", "left_semi")
    panels = panel.withColumn("panel_id", F.lit(DEFAULT))
    if ladder_panels is not None:
        panels = panels.unionByName(ladder_panels.select(panels.columns))
    own_panels = panels.where(F.col("panel_id") != DEFAULT).select(F.col("panel_id").alias("ladder_id")).distinct()
    profiles = resolve_panel(listed, own_panels, DEFAULT).drop("ladder_id")

    wanted = named.join(profiles.select("hid"), "hid", "left_semi").select("hid", "content")
    read, knots, traces = read_traces(wanted)
    places, valid = scaler_arrays(knots), knots.select("hid").distinct()
    pixels, scaler = trace_rows(traces), scaler_rows(places)

    own = reported.withColumnRenamed("sample", "annotation").join(profiles.select("hid", "annotation", "panel_id"), "annotation")
    called = dye_row_of_marker(own.select("hid", "panel_id", "marker", "allele", "height"), panel).where("dye is not null")
    called = written(called.join(valid, "hid", "left_semi"), "calls")
    complete = written(drop_incomplete_profiles(profiles, valid, called), "profiles")
    mask = segmentation_mask(called, panels, places)
    if adjustment is not None:
        marked = pixels.join(mask.withColumn("mask", F.lit(True)), [*KEYS, "px"], "left").withColumn("mask", F.coalesce("mask", F.lit(False)))
        mask = ADJUSTMENTS[adjustment](marked)
    calls = called.select("hid", "marker", "allele", "height").withColumn("source", F.lit("analyst"))
    if donors is not None:
        calls = attach_ground_truth(calls, donor_alleles(complete.select("hid", F.col("hid").alias("name")), donors, panel))
    have = complete.select("hid")
    passed = [named.select("hid"), with_ladder, profiles.select("hid"), read.where("abif").select("hid"), read.where("whole").select("hid"), valid, have]
    outcomes = outcomes_of(samples.select(F.col("stem").alias("hid")), passed)
    return Dataset(complete, *[t.join(have, "hid", "left_semi") for t in (pixels, scaler)], calls, mask, outcomes, *[t.join(have, "hid", "left_semi") for t in (traces, places)])


#: The least height of a peak of the size standard (size_standard_peaks).
LOW = 120


def read_traces(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (hid, content): hid, abif, whole (all six channels are there) of each file and the knots of valid
    standards, both written; and the traces (hid, dye, first, rfu) of the files with one, whose channels are
    decoded when they are read. A file stays one row: of its standard the tops and what lies beside them become
    rows, among which size_standard_peaks finds the same peaks; of its dyes none."""
    channels = file_channels(files)
    of = lambda on: F.filter("channels", on)
    standard = channels.select("hid", "abif", any_number(F.col("channels")).alias("whole"), of(lambda e: e["dye"] == 5).alias("_standard"))
    asked = standard.select("hid", "abif", "whole", (F.size("_standard") > 1).alias("every"), F.explode_outer("_standard").alias("channel"))
    read = written(channel_tops(asked, LOW), "read-files")
    tops = read.select("hid", F.explode(F.arrays_zip("scan", "rfu")).alias("_t")).select("hid", F.lit(5).alias("dye"), "_t.scan", "_t.rfu")
    knots = written(valid_knots(tops), "knots")
    # no filter on channels: Spark would copy all that makes them into it; files without six have no knots anyway
    grids = spread(channels, "hid").join(segment_arrays(knots).hint("shuffle_hash"), "hid").select("hid", "channels", grid_of(F.col("_segments")).alias("_grid"))
    dyes = grids.select("hid", F.get("_grid", F.lit(0))["px"].alias("first"), F.col("_grid")["scan"].alias("scans"), F.explode(of(lambda e: e["dye"] < 5)).alias("channel"))
    traces = channel_samples(dyes.select("hid", "channel.dye", "first", "scans", "channel"))
    return read.select("hid", "abif", "whole").distinct(), knots, traces


def outcomes_of(files: DataFrame, passed: list[DataFrame]) -> DataFrame:
    """hid, status of every file: the first of REASONS whose table (hid of those that passed) lacks it, else kept."""
    marks = reduce(DataFrame.unionByName, [t.select("hid", F.lit(i).alias("_step")) for i, t in enumerate(passed)]).distinct()
    every = files.join(marks.groupBy("hid").agg(F.collect_set("_step").alias("_steps")), "hid", "left")
    missing = [F.when(~F.coalesce(F.array_contains("_steps", i), F.lit(False)), reason) for i, reason in enumerate(REASONS)]
    return every.select("hid", F.coalesce(*missing, F.lit("kept")).alias("status"))
