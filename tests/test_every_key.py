"""Registered queries take every key of their tables, not a subset or a few folded ones."""

from bisect import bisect_left
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusframe.operators import annotate, panel, signal
from locusframe.plans import views as v
from locusframe.plans.queries import QUERIES, asked, good_knots, scaler
from locusframe.sources import files


def nearest(grid, bp):
    """The first pixel whose base pair is nearest."""
    k = bisect_left(grid, bp)
    return min(range(max(0, k - 2), min(len(grid), k + 2)), key=lambda i: (abs(grid[i] - bp), i))


@pytest.fixture(scope="module")
def standards(spark, sf):
    """Suppliers with a valid standard in order, and the base pairs of their pixels."""
    grids = defaultdict(dict)
    for r in scaler(spark, sf).collect():
        grids[r["hid"]][r["px"]] = r["bp"]
    return sorted(grids), {h: [g[i] for i in range(4096)] for h, g in grids.items()}


def test_resample_profile_takes_every_user(spark, sf, standards):
    order, _ = standards
    knots, traces, expected = good_knots(spark, sf), v.trace(spark, sf), set()
    scans = defaultdict(lambda: defaultdict(list))
    for r in signal.rescale_to_grid(knots).collect():
        scans[r["hid"]][r["scan"]].append(r["px"])
    for r in traces.collect():
        at = 3000 + r["hid"] * 37 % 4000 + r["px"]
        expected |= {(r["hid"], r["dye"], px, r["rfu"]) for px in scans[order[r["hid"] % len(order)]][at]}
    got = [tuple(r) for r in QUERIES["resample_profile"](spark, sf).collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert {r[0] for r in got} == {r["hid"] for r in traces.select("hid").distinct().collect()}


def test_bp_to_pixel_takes_every_order_and_supplier(spark, sf, standards):
    order, grids = standards
    got = sorted(tuple(r) for r in QUERIES["bp_to_pixel"](spark, sf).collect())
    points = v.table(spark, sf, "orders").select("o_orderkey", (F.lit(50.0) + F.col("o_totalprice") % 450).alias("bp")).collect()
    assert got == sorted((order[k % len(order)], k, nearest(grids[order[k % len(order)]], bp)) for k, bp in points)
    assert {r[0] for r in got} == set(order)


def test_marker_windows_takes_every_marker_and_supplier(spark, sf, standards):
    order, grids = standards
    bins = defaultdict(list)
    for r in v.panel(spark, sf).collect():
        bins[r["ord"] % 5, r["marker"], r["dye"]].append(100.0 + r["ord"] % 40)
    expected = {}
    for h in order:
        for (kit, marker, dye), bps in bins.items():
            if kit != h % 5:
                continue
            l, r = nearest(grids[h], min(bps) - 0.5 - 1), nearest(grids[h], max(bps) + 0.75 + 1)
            expected[h, marker, dye] = (max(l - 5, 0), min(r + 5, 4096) - 1, min(r + 5, 4096) - max(l - 5, 0))
    spans = QUERIES["marker_windows"](spark, sf).groupBy("hid", "marker", "dye").agg(F.min("px"), F.max("px"), F.count("px")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in spans} == expected


def test_segmentation_mask_takes_every_order(spark, sf, standards):
    order, grids = standards
    entries = {(r["marker"], r["allele"]): r for r in v.panel(spark, sf).collect()}
    dyes = {r["marker"]: r["dye"] for r in entries.values()}
    expected = set()
    for r in asked(spark, sf).collect():
        exact = entries.get((r["marker"], r["allele"]))
        base, _, extra = r["allele"].partition(".")
        found, shift = (exact, 0) if exact else (entries.get((r["marker"], base)), int(extra)) if extra.isdigit() else (None, 0)
        low, high = (found["base_pair"] - 0.5 + shift, found["base_pair"] + 0.75 + shift) if found else (9 + shift, 11 + shift)
        grid = grids[order[r["l_orderkey"] % len(order)]]
        expected |= {(r["l_orderkey"], dyes[r["marker"]], px) for px in range(nearest(grid, low), nearest(grid, high))}
    got = [tuple(r) for r in QUERIES["segmentation_mask"](spark, sf).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_comparison_keeps_three_sources_with_a_mask_each(spark):
    kit = files.panel_from_contents(spark, [(0, "D3", "15", 120.0, 0.4, 0.6, 0), (0, "D3", "16", 124.0, 0.4, 0.6, 1), (1, "D1", "13", 150.0, 0.5, 0.5, 2)])
    rows = [("predicted", "D3", "15", 50.0), ("analyst", "D3", "15", 60.0), ("analyst", "D1", "13", 70.0), ("donor", "D3", "16", None), ("donor", "D3", "15", None)]
    calls = spark.createDataFrame([(1, int(m == "D1"), *r) for r in rows for m in (r[1],)], "hid int, dye int, source string, marker string, allele string, height double")
    got = {(r["marker"], r["allele"]): (r["in_predicted"], r["in_analyst"], r["in_donor"], r["height"], r["analyst_height"], r["kind"]) for r in annotate.allele_comparison(calls, kit).collect()}
    assert got == {("D3", "15"): (True, True, True, 50.0, 60.0, "TP"), ("D3", "16"): (False, False, True, None, None, "FN"), ("D1", "13"): (False, True, False, None, 70.0, None)}
    grid = spark.range(0, 4096).select(F.lit(1).alias("hid"), F.col("id").cast("int").alias("px"), (65 + F.col("id") * 410 / 4095).alias("bp"))
    masks = sorted(tuple(r) for r in annotate.comparison_masks(calls, kit, grid).collect())
    each = [annotate.segmentation_mask(calls.where(F.col("source") == x), kit, grid).withColumn("source", F.lit(x)).select("source", "hid", "dye", "px") for x in annotate.SOURCES]
    assert masks == sorted(tuple(r) for x in each for r in x.collect()) and {m[0] for m in masks} == set(annotate.SOURCES)


@pytest.mark.parametrize("name", ["evaluate", "cross_validate"])
def test_model_is_judged_by_all_metrics(spark, sf, name):
    got = {(r["metric"], r["variant"]) for r in QUERIES[name](spark, sf).collect()}
    alleles = {(f"allele_{m}", x) for m in ("precision", "recall") for x in ("none", "between", "low", "high")} | {("allele_f1", "none")}
    assert got == alleles | {(m, "none") for m in ("pixel_precision", "pixel_recall", "pixel_f1", "average_binary_iou")}


def test_ladder_candidates_lie_in_the_folder_of_the_profile(spark):
    profiles = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "hid int, folder string")
    ladders = spark.createDataFrame([("l1", "a"), ("l2", "a"), ("l3", "b")], "ladder_id string, folder string")
    assert sorted(map(tuple, panel.ladder_candidates(profiles, ladders).collect())) == [(1, "l1"), (1, "l2"), (2, "l3")]
