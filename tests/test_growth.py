"""Steps whose work must not outgrow the input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions.constants import LOCUS_THRESHOLDS, NOT_IN_PANEL
from locusframe.operators import annotate, dataset, ladders, loading, metrics, model, panel, signal
from locusframe.plans import views as v
from locusframe.plans.queries import QUERIES, good_knots, loaded, measured, scaler, scalers
from locusframe.sources import abif


@pytest.mark.parametrize("name", ["bp_to_pixel", "calibrated_profile", "comparison_masks", "marker_windows", "segmentation_mask", "resample_profile"])
def test_grids_are_never_broadcast(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_scalers_as_rows_and_as_arrays_are_the_same(spark, sf):
    points = spark.range(60).select((F.col("id") % 5 + 1).alias("hid"), (F.col("id") * 9.37 + 40).alias("bp"))
    by_rows, by_arrays = (sorted(map(tuple, signal.bp_to_pixel(points, s(spark, sf)).collect())) for s in (scaler, scalers))
    assert by_rows == by_arrays and by_rows


def test_ranges_keep_the_pixels_of_their_scans(spark, sf):
    raw = good_knots(spark, sf).select("hid", F.lit(0).alias("dye"), (F.col("scan") + F.col("bp").cast("bigint") % 9).alias("scan"), F.lit(1).alias("rfu"))
    raw = raw.where("bp between 100 and 300 or scan % 2 = 0")
    ranges = raw.groupBy("hid").agg(F.min("scan").alias("low"), F.max("scan").alias("high"))
    some, whole = (sorted(map(tuple, signal.resample_profile(raw, signal.pixel_places(good_knots(spark, sf), r)).collect())) for r in (ranges, None))
    assert some == whole and some


def test_masks_of_overlapping_spans(spark):
    spans = spark.createDataFrame([(1, 0, 3, 6), (1, 0, 4, 5), (1, 0, 5, 8), (1, 0, 9, 9), (1, 0, 3, 6), (1, 1, 4, 5)], "hid long, dye long, l int, r int")
    assert sorted(map(tuple, annotate.spans_to_mask(spans).collect())) == [(1, 0, x) for x in range(3, 8)] + [(1, 1, 4)]


def test_samples_of_the_same_donors_share_their_alleles(spark, sf):
    donors = spark.createDataFrame([("1A", "m", "7", "8")] * 3 + [("1B", "m", "7", "9")], "donor string, marker string, allele1 string, allele2 string")
    samples = spark.range(500).select(F.col("id").alias("hid"), F.lit("1A2_x").alias("name"))
    found = annotate.donor_alleles(samples, donors, v.panel(spark, sf).withColumn("marker", F.lit("m")))
    assert found.count() == 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (_donors" in plan  # samples meet the finished sets, not each donor's rows


def test_outcomes_make_no_rows_of_dyes(spark, sf):
    place = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(place))
    loaded(spark, sf)
    made = {x.rsplit("-", 1)[0] for x in set(os.listdir(place)) - before}
    assert made and not made & {"raw-traces", "pixels", "entries"}


def test_traces_in_arrays_are_the_calibrated_profiles(spark, sf):
    files = v.files(spark, sf).where("not ladder").select(F.col("hid").cast("string").alias("hid"), "content").localCheckpoint()
    raw = abif.select_dye_channels(abif.decode_hid_values(abif.decode_hid_elements(files))).localCheckpoint()
    pixels, grid = signal.calibrated_profile(raw)
    _, knots, traces = dataset.read_traces(files)
    got, places = signal.trace_rows(traces), signal.scaler_rows(signal.scaler_arrays(knots))
    assert got.count() == pixels.count() > 0 and got.exceptAll(pixels.select(got.columns)).isEmpty()
    assert places.count() == grid.count() and places.exceptAll(grid.select(places.columns)).isEmpty()


def test_spans_on_arrays_and_on_rows_have_the_same_peaks(spark):
    pixels = spark.range(600).select((F.col("id") % 3).alias("hid"), F.lit(0).alias("dye"), F.floor(F.col("id") / 3).alias("px"), (F.crc32(F.col("id").cast("string")) % 7).cast("bigint").alias("rfu"))
    spans = spark.range(400).select(F.lit("a").alias("ladder_id"), (F.col("id") % 3).alias("hid"), F.lit(0).alias("dye"), F.lit("m").alias("marker"), F.col("id").cast("string").alias("allele"), (F.col("id") % 150).alias("l"), (F.col("id") % 150 + F.col("id") % 9).alias("r"))
    traces = pixels.groupBy("hid", "dye").agg(F.lit(0).alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("px", "rfu"))), lambda x: x["rfu"]).alias("rfu"))
    rows = {(r["hid"], r["l"], r["r"]): r["has_peak"] for r in panel.bin_has_peak(spans, pixels).collect()}
    arrays = {(r["hid"], r["l"], r["r"]): r["has_peak"] for r in panel.spans_have_peak(spans, traces).collect()}
    assert rows == arrays and set(rows.values()) == {True, False}


def test_ladders_with_the_same_panel_count_once(spark):
    panels = spark.createDataFrame([(x, "m", "1", 0, bp, 0.5, 0.5, 0) for x, bp in (("f/a", 90.0), ("f/b", 90.0), ("f/c", 91.0), ("g/d", 90.0))], "panel_id string, marker string, allele string, dye int, base_pair double, left_off double, right_off double, ord int")
    here = spark.createDataFrame([(x, x[0]) for x in ("f/b", "f/a", "f/c", "g/d", "g/invalid")], "ladder_id string, folder string")
    assert sorted(map(tuple, ladders.distinct_ladders(here, panels).collect())) == [("f/a", "f"), ("f/c", "f"), ("g/d", "g")]


def test_calls_are_put_together_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    monkeypatch.setattr(signal, "TASK_ROWS", 100)
    calls = v.calls(spark, sf)
    rows = v.table(spark, sf, "lineitem").count()
    assert calls.rdd.getNumPartitions() == -(-rows // 100) > 8
    plan = calls._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("REPARTITION_BY_NUM") and "HashAggregate" not in plan[plan.index("REPARTITION_BY_NUM") :].split("== Initial Plan ==")[0]


def test_sources_share_one_pass_over_the_calls(spark, sf):
    for name in ("allele_comparison", "allele_comparison_of_three"):
        assert "Union" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_alleles_and_their_fallbacks_are_looked_up_in_one_join(spark):
    kit = spark.createDataFrame([("m", "9", 100.0, 0), ("m", "9", 500.0, 4), ("m", "9.2", 102.5, 1), ("m", "x.y", 110.0, 2), ("n", "9", 200.0, 3), ("m", None, 300.0, 5)], "marker string, allele string, base_pair double, ord int")
    kit = kit.select("*", F.lit(0.5).alias("left_off"), F.lit(0.75).alias("right_off"))
    alleles = ["9", "9.2", "9.3", "9.x", "9.3.1", "x", "x.y", "x.1", "7", "7.2", "", ".5", None]
    found = panel.allele_info(spark.createDataFrame([("m", a) for a in alleles], "marker string, allele string"), kit)
    got = {r["allele"]: (r["bp"], r["in_panel"]) for r in found.collect()}
    low = NOT_IN_PANEL[0]
    known = {"9": 100.0, "9.2": 102.5, "9.3": 103.0, "9.x": 100.0, "x.y": 110.0}
    unknown = {"9.3.1": low, "x": low, "x.1": low + 1, "7": low, "7.2": low + 2, "": low, ".5": low + 5, None: low}
    assert got == {a: (b, True) for a, b in known.items()} | {a: (b, False) for a, b in unknown.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1  # alleles without a fallback do not gather on an empty key


def test_an_allele_is_one_row_for_all_variants(spark):
    pixels = spark.createDataFrame([(1, 1.0, True)], "hid long, prob double, mask boolean")
    low, high = LOCUS_THRESHOLDS["FGA"]
    heights = [low - 1.0, float(low), low + 1.0, float(high), high + 1.0, None]
    made = {x: [(i % 3, m, str(i % 4), heights[(i * k) % 6]) for i in range(24) for m in ("FGA", "unknown")] for x, k in (("p", 1), ("t", 5))}
    predicted, truth = (spark.createDataFrame(made[x], "hid long, marker string, allele string, height double") for x in ("p", "t"))
    passes = {"none": lambda h: True, "between": lambda h: low < h < high, "low": lambda h: h >= low, "high": lambda h: h >= high}

    def keys(rows, variant, limited=True):
        return {r[:3] for r in rows if variant == "none" or not limited or (r[1] == "FGA" and r[3] is not None and passes[variant](r[3]))}

    for limited in (True, False):
        found = metrics.evaluation_suite(pixels, predicted.where("hid <> 0"), truth, limited)
        got = {(r["metric"], r["variant"]): r["value"] for r in found.where("metric like 'allele%'").collect()}
        assert len(got) == 9
        for variant in passes:
            p, t = keys([r for r in made["p"] if r[0] != 0], variant), keys(made["t"], variant, limited)
            assert got["allele_precision", variant] == pytest.approx(len(p & t) / max(len(p), 1)) and got["allele_recall", variant] == pytest.approx(len(p & t) / max(len(t), 1))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [hid#" in plan and "Aggregate [variant#" not in plan
    none = metrics.evaluation_suite(pixels, predicted.limit(0), truth.limit(0)).where("metric like 'allele%'").collect()
    assert len(none) == 9 and {r["value"] for r in none} == {0.0}


def test_moved_panels_are_dealt_by_their_rows(spark, sf, monkeypatch):
    whole = sorted(map(tuple, QUERIES["adjust_panel"](spark, sf).collect()))
    monkeypatch.setattr(signal, "TASK_ROWS", 100)
    dealt = QUERIES["adjust_panel"](spark, sf)
    assert dealt.rdd.getNumPartitions() == -(-len(whole) // 100) > 8
    assert sorted(map(tuple, dealt.collect())) == whole


def test_metrics_of_all_folds_come_from_one_pass(spark, sf):
    pixels, kit, truth = measured(spark, sf)
    scored = pixels.withColumns({"fold": F.col("hid") % 3, "prob": F.abs(F.sin(F.col("px") * 7 + F.col("hid")))}).where("fold <> 1").localCheckpoint()
    truth = truth.where("hid % 3 <> 2 or marker <> 'FGA'").localCheckpoint()
    for panel_, calls in ((kit, truth), (None, None)):
        together = model.all_metrics(scored, panel_, calls, spark.range(3).withColumnRenamed("id", "fold"))
        near = lambda x: x if x is None else round(x, 12)
        got = {(r["fold"], r["metric"], r["variant"]): near(r["value"]) for r in together.collect()}
        for i in range(3):  # the second fold is empty
            alone = {(i, r["metric"], r["variant"]): near(r["value"]) for r in model.all_metrics(scored.where(F.col("fold") == i), panel_, calls).collect()}
            assert {k: x for k, x in got.items() if k[0] == i} == alone and len(alone) == (4 if panel_ is None else 13)


def test_passes_over_folds_read_blocks(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("fold"), (F.col("id") % 7 < 2).cast("double").alias("label"), F.sin(F.col("id") * 0.37).alias("a"), F.cos(F.col("id") * 1.7).alias("b"))
    w = np.array([[0.3, -2.0, 0.1], [900.0, 0.0, -900.0], [0.0, 0.0, 0.0]])
    loss, slope, curve = model.fold_sums(model.packed(rows, ["a", "b"]), w)
    table = np.array([tuple(r) for r in rows.collect()])
    for i in range(3):
        own = table[table[:, 0] != i]
        x, y = np.column_stack([own[:, 2:], np.ones(len(own))]), own[:, 1]
        z = x @ w[i]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        assert np.isclose(loss[i], (np.logaddexp(0, z) - y * z).sum()) and np.allclose(slope[i], x.T @ (p - y)) and np.allclose(curve[i], (x * (p * (1 - p))[:, None]).T @ x)


def test_scalers_of_ladders_are_never_broadcast(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(ladders, "adjust_panel", lambda *args: seen.append(args) or panel.adjust_panel(*args))
    kit = v.kit(spark, sf)
    alleles = kit.where("floor(ord / 5) <> 2").select("dye", (F.floor(F.col("ord") / 5) - (F.col("ord") > 14).cast("int")).alias("k"), "marker", "allele")
    moved = ladders.ladder_panels(v.files(spark, sf).where("ladder").select("path", "content"), kit, alleles)
    kits, named, peaks, scaler, valid = seen[0]
    assert "bps" in scaler.columns  # one row per ladder, not one per pixel
    plan = panel.adjust_panel(*seen[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=shuffle_hash)" in plan
    by_rows = panel.adjust_panel(kits, named, peaks, signal.scaler_rows(scaler), valid)
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, by_rows.select(moved.columns).collect())) and not moved.isEmpty()


def test_calls_meet_their_profiles_as_distinct_hids(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("hid"))
    found = loading.drop_incomplete_profiles(spark.range(9).withColumnRenamed("id", "hid"), rows, rows.where("hid <> 3"))
    assert sorted(r["hid"] for r in found.collect()) == [0, 1, 2, 4, 5, 6]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [hid") == 2


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_scalers_are_dealt_by_their_pixels(spark, sf, monkeypatch, limit):
    whole = sorted(map(tuple, QUERIES["marker_windows"](spark, sf).collect()))
    suppliers = v.table(spark, sf, "supplier").count()
    monkeypatch.setattr(signal, "TASK_ROWS", 2048)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)  # the standards of many suppliers are not broadcast
    try:
        dealt = QUERIES["marker_windows"](spark, sf)
        assert sorted(map(tuple, dealt.collect())) == whole and dealt.rdd.getNumPartitions() == 2 * suppliers > 8
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
        assert scalers(spark, sf).rdd.getNumPartitions() == scaler(spark, sf).rdd.getNumPartitions() == 2 * suppliers
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
