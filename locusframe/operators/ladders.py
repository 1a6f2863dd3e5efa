"""From ladder files to the ladder that fits each profile best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_candidate_ladder
from ..sources.scratch import written
from .annotate import allele_spans
from .dataset import DEFAULT, Dataset, read_traces
from .panel import adjust_panel, allele_info, best_ladder, dye_row_of_marker, ladder_candidates, spans_have_peak
from .signal import high_rows, ladder_peaks, scaler_arrays


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ladder_panels(ladder_files: DataFrame, panel: DataFrame, ladder_alleles: DataFrame) -> DataFrame:
    """The panel moved to the peaks of each valid ladder, with panel_id, the ladder's path; written.
    ladder_files: path, content; ladder_alleles: dye, k, marker, allele (read_ladder_alleles). Every
    ladder is decoded, calibrated and re-based once, however many profiles it serves. A ladder is valid if
    it can be calibrated and has as many peaks on each dye as alleles."""
    _, knots, traces = read_traces(ladder_files.select(F.col("path").alias("hid"), "content"))
    peaks = written(ladder_peaks(written(high_rows(traces), "ladder-rows"), ladder_alleles.groupBy("dye").agg(F.count(F.lit(1)).alias("n"))), "ladder-peaks")
    kit = F.lit(DEFAULT).alias("panel_id")
    valid = peaks.select("hid").distinct().select("hid", kit)
    return written(adjust_panel(panel.select("*", kit), ladder_alleles.select("*", kit), peaks, scaler_arrays(knots), valid), "ladder-panels")


def distinct_ladders(ladders: DataFrame, panels: DataFrame) -> DataFrame:
    """Of the ladders (ladder_id, folder) that lie in one folder and whose panels (panel_id) are the same, the first
    path. The others fit each profile just as well and come after it, so they are never chosen."""
    entries = F.struct("marker", "allele", "dye", "base_pair", "left_off", "right_off", "ord")
    content = panels.groupBy(F.col("panel_id").alias("ladder_id")).agg(F.sort_array(F.collect_list(entries)).alias("_entries"))
    return ladders.join(content, "ladder_id").groupBy("folder", "_entries").agg(F.min("ladder_id").alias("ladder_id")).select("ladder_id", "folder")


def ladder_bins(profiles: DataFrame, calls: DataFrame, scaler: DataFrame, panels: DataFrame, candidates: DataFrame) -> DataFrame:
    """ladder_id, hid, dye, marker, allele, l, r: where each candidate puts each called allele on the profile;
    alleles that no panel has are left out. profiles: hid; calls: hid, dye, marker, allele; candidates: hid,
    ladder_id. Bins are looked up once for each ladder and allele, whatever the number of profiles."""
    asked = candidates.join(profiles.select("hid"), "hid", "left_semi").join(calls.select("hid", "dye", "marker", "allele").distinct().hint("merge"), "hid")
    wanted = asked.select(F.col("ladder_id").alias("panel_id"), "marker", "allele").distinct()
    info = allele_info(wanted, panels).where("in_panel").select(F.col("panel_id").alias("ladder_id"), "marker", "allele", "bp_left", "bp_right")
    placed = allele_spans(asked.join(info, ["ladder_id", "marker", "allele"]), scaler)
    return placed.select("ladder_id", "hid", "dye", "marker", "allele", "l", "r")


def select_ladders(samples: DataFrame, loaded: Dataset, ladder_files: DataFrame, panel: DataFrame, ladder_alleles: DataFrame) -> DataFrame:
    """image_path (the profile's hid), ladder_path (null if no valid ladder of its folder fits any call) of
    every loaded profile. samples: stem, path; ladder_files: path, name, content (scan_profiles with
    ladders). A ladder fits better the more of the analyst's calls have a peak in the bin where it puts
    them; of equal ones the first path is taken. A call that is reported several times counts as often."""
    candidates = ladder_files.where(is_candidate_ladder(F.col("name")))
    panels = ladder_panels(candidates, panel, ladder_alleles)
    here = written(distinct_ladders(candidates.select(F.col("path").alias("ladder_id"), folder_of(F.col("path")).alias("folder")), panels), "distinct-ladders")
    profiles = loaded.profiles.select("hid").distinct().join(samples.select(F.col("stem").alias("hid"), folder_of(F.col("path")).alias("folder")), "hid")
    calls = dye_row_of_marker(loaded.calls.where("source = 'analyst'").select("hid", "marker", "allele"), panel)
    times = calls.groupBy("hid", "marker", "allele").agg(F.count(F.lit(1)).alias("times"))
    spans = written(ladder_bins(profiles, calls, loaded.places, panels, ladder_candidates(profiles, here)), "ladder-bins")
    hits = written(spans_have_peak(spans, loaded.traces).where("has_peak"), "bins-with-peak")
    # hits and calls grow with the profiles and are small as files, so they are never broadcast
    found = spans.join(hits.hint("merge"), ["hid", "dye", "l", "r"]).join(times.hint("merge"), ["hid", "marker", "allele"])
    best = best_ladder(found)
    return profiles.join(best, "hid", "left").select(F.col("hid").alias("image_path"), F.col("ladder_id").alias("ladder_path"))
