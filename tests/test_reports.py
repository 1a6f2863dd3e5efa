"""Reports with headers of their own, binary numbers, seeded orders and models of folds."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import model, splits
from locusframe.sources import abif, files


def test_reports_of_three_kinds_in_one_folder(spark, tmp_path):
    made = {
        "a.txt": "Sample Name\tMarker\tAllele 1\tAllele 2\tHeight 1\tHeight 2\nS1\tD3\tOB_15.3\t\t80\t\nS1\tD1\tX\t9\t70.5\tbad\n",
        "sub/b.csv": 'Sample Name,Marker,Dye,Allele#1,Height#1,Allele#2,Height#2,Allele#3,Height#3\r\n"S,2",D3,0,12,1,13,2,14,3\r\n"S ""q""",D3,0,OL,5,,,,\r\n',
        "c.csv": "Name;Locus;Height#1;Allele#1\nS3;D7;44;7\n\nS3;D8;45;_B8O_\n",
        "utf.csv": "\ufeffMarker,Sample Name,Allele#1,Height#1\nD9,S4,1,2\n",
        "empty.csv": "",
        "other.csv": "Allele;a;b\n1;2;3\n",
    }
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    got = sorted(tuple(r) for r in files.read_allele_report(spark, str(tmp_path)).collect())
    assert got == sorted([
        ("S1", "D3", 0, "15.3", 80.0), ("S1", "D1", 0, "X", 70.5), ("S1", "D1", 1, "9", None), ("S,2", "D3", 0, "12", 1.0), ("S,2", "D3", 1, "13", 2.0), ("S,2", "D3", 2, "14", 3.0),
        ('S "q"', "D3", 0, "L", 5.0), ("S3", "D7", 0, "7", 44.0), ("S3", "D8", 0, "8", 45.0), ("S4", "D9", 0, "1", 2.0),
    ])
    assert files.read_allele_report(spark, str(tmp_path / "other.csv")) is None


@pytest.mark.parametrize(("kind", "code", "size"), [(4, "h", 2), (3, "H", 2), (5, "i", 4), (1, "i", 4)])
def test_numbers_of_whole_and_truncated_arrays(spark, kind, code, size):
    rng = np.random.default_rng(kind)
    info = np.iinfo({"h": np.int16, "H": np.uint16, "i": np.int32}[code])
    values = [info.min, info.max, 0, *rng.integers(info.min, info.max, 40, endpoint=True).tolist()]
    data = struct.pack(f">{len(values)}{code}", *values)
    rows = [(0, len(values), data), (1, 5, data), (2, len(values) + 9, data), (3, len(values), data[:-1]), (4, 3, b""), (5, 2, data[: size - 1]), (6, 0, data)]
    df = spark.createDataFrame([(i, kind, n, bytearray(d)) for i, n, d in rows], "hid int, type int, n int, data binary").withColumn("name", F.lit("DATA"))
    got = {r["hid"]: r["v_array"] for r in abif.decode_hid_values(df).collect()}
    expected = {0: values, 1: values[:5], 2: values, 3: values[:-1], 4: [], 5: []}
    assert {i: got[i] for i in expected} == expected
    assert got[6] == ([] if kind in (3, 4) else None)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_shuffled_places_are_a_bijection_that_can_be_undone(spark, n):
    rows = spark.range(n).select((F.col("id") * 7 % 1009).alias("key"), F.lit("x").alias("place_"))
    orders = []
    for seed, parts in ((3, 1), (3, 6), (4, 2)):
        got = splits.shuffle_rows(rows.repartition(parts), "key", seed).orderBy("place").collect()
        assert [r["place"] for r in got] == list(range(n))
        orders.append([r["key"] for r in got])
    assert orders[0] == orders[1] and (n < 7 or orders[0] != orders[2])
    if n == 1000:
        moved = np.array(orders[0]).argsort().argsort() - np.arange(n)
        assert abs(np.corrcoef(np.array(orders[0]).argsort().argsort(), np.arange(n))[0, 1]) < 0.1 and (moved == 0).sum() < 10
    ranks = sorted(orders[0])
    back = spark.range(n).select("id", splits.rank_of_place(F.col("id"), n, 3).alias("rank")).collect()
    assert [ranks[r["rank"]] for r in sorted(back)] == orders[0]
    assert sorted(r["place"] for r in splits.shuffle_rows(rows, "key").collect()) == list(range(n))


def test_models_of_all_folds_are_those_of_separate_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(h, d, i, int(rng.integers(0, 400)) + 600 * (rng.random() < 0.3), bool(rng.random() < 0.4), h % 3) for h in range(9) for d in range(2) for i in range(50)]
    pixels = spark.createDataFrame(rows, "hid int, dye int, px int, rfu int, mask boolean, fold int")
    features = model.pixel_features(pixels).withColumn("label", F.col("mask").cast("double")).cache()
    together = model.fit_folds(features, 3)
    for i in range(3):
        alone = model.fit_folds(features.where(F.col("fold") != i).withColumn("fold", F.lit(1)), 1)[0]
        assert together[i] == pytest.approx(alone, abs=1e-6)
        fitted = {r["feature"]: r["weight"] for r in model.weights(model.fit_pixel_model(pixels.where(F.col("fold") != i).drop("fold"), max_iter=200), spark).collect()}
        assert together[i] == pytest.approx([fitted[n] for n in (*model.feature_names(), "intercept")], abs=2e-3)
    scored = model.fold_scores(features, together, ["hid", "dye", "px"]).collect()
    by_row = {(r["hid"], r["dye"], r["px"]): r for r in features.collect()}
    for r in scored[::37]:
        x = by_row[r["hid"], r["dye"], r["px"]]
        z = sum(w * x[c] for w, c in zip(together[x["fold"]], model.feature_names())) + together[x["fold"]][-1]
        assert r["prob"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_folds_without_rows_and_constant_features(spark):
    pixels = spark.createDataFrame([(h, 0, i, 7, i % 2 == 0, 0) for h in range(3) for i in range(20)], "hid int, dye int, px int, rfu int, mask boolean, fold int")
    features = model.pixel_features(pixels).withColumn("label", F.col("mask").cast("double"))
    assert np.isfinite(model.fit_folds(features, 2)).all()
