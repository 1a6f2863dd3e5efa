"""Names, panels, metrics, splits, sources and the pixel model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import names as fn
from locusframe.operators import annotate, metrics, model, panel, splits
from locusframe.sources import files

PANEL = [(0, "AMEL", "X", 81.5, 0.5, 0.5, 0), (0, "AMEL", "Y", 87.68, 0.5, 0.5, 1), (0, "D3", "15", 120.0, 0.4, 0.6, 2), (0, "D3", "16", 124.0, 0.4, 0.6, 3), (1, "D1", "13", 150.0, 0.5, 0.5, 4)]


@pytest.fixture(scope="module")
def kit(spark):
    return files.panel_from_contents(spark, PANEL)


def test_names(spark):
    rows = spark.createDataFrame([("1A2_A01_01.hid",), ("2E5_B07_02",), ("1234_A01.hid",), ("",), ("12345_A01_01.hid",)], "n string")
    got = rows.select("n", fn.is_rd_sample(F.col("n")), fn.sample_noc(F.col("n")), fn.sample_prefix(F.col("n")), F.array_join(fn.donors_of_sample(F.col("n")), ",")).collect()
    assert [tuple(r)[1:] for r in got] == [(True, "2p", "1A2", "1A,1B"), (True, "5p", "2E5", "2F,2G,2H,2I,2J"), (False, None, None, None), (False, None, None, None), (False, None, None, None)]
    with pytest.raises(Exception, match="not an R&D sample"):
        rows.select(fn.sample_prefix(F.col("n"), strict=True)).collect()


def test_allele_info(spark, kit):
    calls = spark.createDataFrame([("AMEL", "X"), ("D3", "15.3"), ("D3", "99"), ("Q", "a.b.c"), ("D3", "7.2")], "marker string, allele string")
    got = {r["allele"]: tuple(r)[2:] for r in panel.allele_info(calls, kit).collect()}
    assert got["X"] == (81.5, 81.0, 82.0, True)
    assert got["15.3"] == (123.0, pytest.approx(122.6), pytest.approx(123.6), True)
    assert got["99"] == got["a.b.c"] == (10, 9, 11, False)
    assert got["7.2"] == (12, 11, 13, False)


def test_lookup_errors(spark, kit):
    points = spark.createDataFrame([(0, 81.5)], "dye int, base_pair double")
    assert panel.allele_at_dye_bp(points, kit).first()["allele"] == "X"
    with pytest.raises(Exception, match="no allele"):
        panel.allele_at_dye_bp(spark.createDataFrame([(0, 1234.0)], "dye int, base_pair double"), kit).collect()
    with pytest.raises(ValueError):
        files.panel_from_contents(spark, None)


def test_adjusted_panel_extrapolates(spark):
    kit = files.panel_from_contents(spark, [(0, "M", "a", 93.47, 0.5, 0.5, 0), (0, "M", "b", 96.0, 0.5, 0.5, 1), (0, "M", "c", 97.82, 0.5, 0.5, 2)]).withColumn("panel_id", F.lit("kit"))
    alleles = spark.createDataFrame([("kit", 0, 0, "M", "a"), ("kit", 0, 1, "M", "b")], "panel_id string, dye int, k int, marker string, allele string")
    ladders = spark.createDataFrame([("L", "kit")], "hid string, panel_id string")
    peaks = spark.createDataFrame([("L", 0, 0, 10), ("L", 0, 1, 20)], "hid string, dye int, k int, px int")
    scaler = spark.createDataFrame([("L", 10, 93.12), ("L", 20, 95.74)], "hid string, px int, bp double")
    got = {r["allele"]: r["base_pair"] for r in panel.adjust_panel(kit, alleles, peaks, scaler, ladders).collect()}
    assert got["a"] == 93.12 and got["b"] == 95.74 and got["c"] == pytest.approx(97.62474308300393)


def test_called_mask_gives_the_same_alleles(spark, kit):
    scaler = spark.range(0, 4096).select(F.lit(1).alias("hid"), F.col("id").cast("int").alias("px"), (65 + F.col("id") * 410 / 4095).alias("bp"))
    calls = spark.createDataFrame([(1, 0, "AMEL", "X"), (1, 0, "D3", "16"), (1, 1, "D1", "13")], "hid int, dye int, marker string, allele string")
    mask = annotate.segmentation_mask(calls, kit, scaler)
    pixels = mask.join(scaler, ["hid", "px"]).withColumn("prob", F.lit(1.0)).withColumn("rfu", F.col("px"))
    got = {(r["marker"], r["allele"]) for r in annotate.call_alleles(pixels, kit).collect()}
    assert got == {("AMEL", "X"), ("D3", "16"), ("D1", "13")}


def test_pixel_metrics(spark):
    mask, prob = [1, 1, 1, 0, 1, 0, 1, 0, 0], [0.6, 0.8, 0.1, 0.2, 0.7, 0.6, 0.9, 0.2, 0.7]
    pixels = spark.createDataFrame([(1, i, m == 1, p) for i, (m, p) in enumerate(zip(mask, prob))], "hid int, px int, mask boolean, prob double")
    assert tuple(metrics.pixel_confusion(pixels).first()) == (4, 2, 1)
    assert tuple(metrics.pixel_scores(pixels).first())[:2] == (pytest.approx(4 / 6), pytest.approx(4 / 5))
    assert metrics.average_binary_iou(pixels).first()[0] == pytest.approx(4 / 7)
    assert metrics.pixel_scores(pixels.where("false")).first()["precision"] is None


def test_allele_metrics(spark):
    truth = spark.createDataFrame([(1, "AMEL", "13", 50.0), (1, "AMEL", "15.1", 96.0), (1, "Penta E", "14", 45.0), (1, "Penta E", "15.1", 20.0)], "hid int, marker string, allele string, height double")
    predicted = truth.where("marker = 'AMEL'")
    sets = metrics.locus_allele_set(predicted), metrics.locus_allele_set(truth)
    assert tuple(metrics.allele_confusion(*sets).first()) == (2, 0, 2)
    assert tuple(metrics.allele_scores(*sets).first())[:2] == (1.0, 0.5)
    between = metrics.locus_allele_set(truth, metrics.locus_thresholds(spark, low_or_high="between"))
    assert [r["key"] for r in between.collect()] == ["AMEL_13"]
    assert metrics.locus_allele_set(truth, metrics.locus_thresholds(spark, min_rfu=0)).count() == 4
    with pytest.raises(Exception, match="duplicate"):
        metrics.locus_allele_set(truth.union(truth), strict=True).collect()
    with pytest.raises(ValueError):
        metrics.locus_thresholds(spark, locus="nowhere")


@pytest.mark.parametrize(("n", "fraction", "first"), [(20, 0.8, 16), (19, 0.78, 14)])
def test_holdout(spark, n, fraction, first):
    parts = splits.holdout_split(spark.range(n), fraction, 1, "id").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {1: first, 2: n - first}
    with pytest.raises(ValueError):
        splits.holdout_split(spark.range(3), 1.5, 1, "id")


def test_folds_and_batches(spark):
    rows = spark.range(58).select(F.concat((F.col("id") % 4 + 2).cast("string"), F.lit("p")).alias("noc"), F.concat_ws("-", (F.col("id") % 4).cast("string"), (F.col("id") / 8).cast("int").cast("string")).alias("prefix"), "id")
    folded = splits.grouped_kfold_split(rows, 4, 9)
    assert folded.count() == 58 and folded.groupBy("prefix").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert sorted(r["count"] for r in splits.kfold_split(spark.range(11), 4, 2, "id").groupBy("fold").count().collect()) == [2, 3, 3, 3]
    assert splits.fixed_batches(spark.range(11), 2, "id").where("batch = 5").count() == 1
    assert splits.fixed_batches(spark.range(11), 2, "id", drop_last=True).count() == 10
    with pytest.raises(ValueError):
        splits.kfold_split(spark.range(2), 3, 1, "id")


def test_report_and_panel_files(spark, tmp_path):
    report = tmp_path / "Dataset 1 DTH_AlleleReport.txt"
    report.write_text("Sample Name\tMarker\tAllele#1\tHeight#1\tAllele#2\tHeight#2\n1_a\tAMEL\tX\t11148\tOB_Y\t10495\n1_a\tD1\t15.3\t9\t\t\n")
    got = [tuple(r) for r in files.read_allele_report(spark, str(report)).orderBy("marker", "k").collect()]
    assert got == [("1_a", "AMEL", 0, "X", 11148.0), ("1_a", "AMEL", 1, "Y", 10495.0), ("1_a", "D1", 0, "15.3", 9.0)]
    (tmp_path / "empty.txt").write_text("")
    assert files.read_allele_report(spark, str(tmp_path / "empty.txt")) is None
    xml = tmp_path / "panel.xml"
    xml.write_text('<P><Locus><DyeIndex>6</DyeIndex><MarkerTitle>AMEL</MarkerTitle><Allele Label="X" Size="81.5" Left_Binning="0.5" Right_Binning="0.5"/><Allele Label="9" Size="87" Left_Binning="0.5" Right_Binning="0.5"/></Locus></P>')
    assert [(r["dye"], r["marker"], r["allele"], r["base_pair"]) for r in files.read_panel(spark, str(xml)).orderBy("ord").collect()] == [(4, "AMEL", "X", 81.5), (4, "AMEL", "9", 87.0)]


def test_scan_profiles(spark, tmp_path):
    for name in ("run 1/1A2_A01_01.hid", "run 1/Ladder_G03.hid", "run 2/2E5_B07_02.hid", "run 2/blanco_x.hid", "run 2/1A2_notes.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"ABIF")
    got = sorted(tuple(r) for r in files.scan_profiles(spark, str(tmp_path)).select("folder", "name", "stem").collect())
    assert got == [("run 1", "1A2_A01_01.hid", "1A2_A01_01"), ("run 2", "2E5_B07_02.hid", "2E5_B07_02")]
    assert files.scan_profiles(spark, str(tmp_path), ladders=True).count() == 1


def test_cache_predictions_and_ladders(spark, tmp_path):
    pixels = spark.createDataFrame([("1A2_x", 0, i, i * 3) for i in range(5)], "hid string, dye int, px int, rfu int")
    scaler = spark.createDataFrame([("1A2_x", i, 65.0 + i) for i in range(5)], "hid string, px int, bp double")
    mask = pixels.where("px = 2").select("hid", "dye", "px")
    calls = spark.createDataFrame([("1A2_x", "analyst", "AMEL", "X", 5.0)], "hid string, source string, marker string, allele string, height double")
    files.write_profile_cache(files.profile_rows(pixels, scaler, mask, calls), str(tmp_path / "cache"))
    back = files.read_profile_cache(spark, str(tmp_path / "cache"))
    assert back.first()["noc"] == "2p" and sorted(map(tuple, files.cached_pixels(back).collect())) == sorted(map(tuple, pixels.collect()))
    made = spark.createDataFrame([("a", {"x": 0.25}, [[1.0]], {"k": "v"})], files.PREDICTION)
    files.write_predictions(made, str(tmp_path / "pred"))
    assert files.read_predictions(spark, str(tmp_path / "pred")).collect() == made.collect()
    best = spark.createDataFrame([("p", "l"), ("q", None)], "image_path string, ladder_path string")
    files.write_best_ladders(best, str(tmp_path / "best"))
    assert sorted(map(str, files.read_best_ladders(spark, str(tmp_path / "best")).collect())) == sorted(map(str, best.collect()))


def test_model(spark, tmp_path):
    rows = [(h, d, i, 500 if i % 9 == 4 else i % 5, i % 9 == 4) for h in range(4) for d in range(2) for i in range(40)]
    pixels = spark.createDataFrame(rows, "hid int, dye int, px int, rfu int, mask boolean")
    fitted = model.fit_pixel_model(pixels)
    model.save_model(fitted, str(tmp_path / "model"))
    value = {r["metric"]: r["value"] for r in model.evaluate(model.load_model(str(tmp_path / "model")), pixels).collect()}
    assert value["pixel_f1"] > 0.95


def test_scores_by_numpy_on_the_fitted_weights(spark):
    rng = np.random.default_rng(6)
    rows = [(h, d, i, int(rng.integers(0, 300)) + 900 * (i % 11 == 5), i % 11 == 5) for h in range(3) for d in range(2) for i in range(50)]
    pixels = spark.createDataFrame(rows, "hid int, dye int, px int, rfu int, mask boolean")
    fitted = model.fit_pixel_model(pixels)
    weight = {r["feature"]: r["weight"] for r in model.weights(fitted, spark).collect()}
    v = {(h, d, i): np.sign(x) * np.log1p(abs(x)) for h, d, i, x, _ in rows}
    for r in model.predict_pixels(fitted, pixels).collect():
        h, d, i = r["hid"], r["dye"], r["px"]
        z = weight["intercept"] + sum(weight[f"f{k + model.REACH}"] * v.get((h, d, i + k), 0.0) for k in range(-model.REACH, model.REACH + 1))
        z += weight["fmax"] * max(v[h, d, k] for k in range(50)) + weight["fother"] * sum(v[h, o, i] for o in range(2) if o != d)
        assert r["prob"] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_metrics_of_the_model_by_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(h, 0, i, int(rng.integers(0, 300)) + 500 * (rng.random() < 0.2), bool(rng.random() < 0.3)) for h in range(6) for i in range(60)]
    pixels = spark.createDataFrame(rows, "hid int, dye int, px int, rfu int, mask boolean")

    def by_hand(scored):
        y, p = np.array([r["mask"] for r in scored]), np.array([r["prob"] for r in scored])
        tp, fp, fn = (y & (p >= 0.5)).sum(), (~y & (p >= 0.5)).sum(), (y & (p < 0.5)).sum()
        return (tp / (tp + fp) if tp + fp else None), tp / (tp + fn)

    fitted = model.fit_pixel_model(pixels)
    value = {r["metric"]: r["value"] for r in model.evaluate(fitted, pixels).collect()}
    precision, recall = by_hand(model.predict_pixels(fitted, pixels).collect())
    assert value["pixel_recall"] == pytest.approx(recall) and (value["pixel_precision"] == pytest.approx(precision) if precision is not None else value["pixel_precision"] is None)
    folded = pixels.withColumn("fold", F.col("hid") % 2)
    got = {r["metric"]: r["mean_value"] for r in model.cross_validate(folded, 2).collect()}
    each = [by_hand(model.predict_pixels(model.fit_pixel_model(pixels.where(F.col("hid") % 2 != i)), pixels.where(F.col("hid") % 2 == i)).collect()) for i in range(2)]
    assert got["pixel_recall"] == pytest.approx(np.mean([r for _, r in each]))
