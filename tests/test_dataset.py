"""From files in folders to calibrated, annotated profiles."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions.constants import STANDARD_BPS
from locusframe.operators import annotate, dataset, ladders, metrics, panel
from locusframe.sources import files


def abif(channels):
    """A file with a DATA entry of signed 16-bit numbers for each tag."""
    body, entries = b"", b""
    for tag, values in channels.items():
        data = np.array(values, ">i2").tobytes()
        entries += struct.pack(">4sihhiiii", b"DATA", tag, 4, 2, len(values), len(data), 128 + len(body), 0)
        body += data
    head = b"ABIF" + struct.pack(">h4sihhiiii", 101, b"tdir", 1, 1023, 28, len(channels), 28 * len(channels), 128 + len(body), 0)
    return head.ljust(128, b"\0") + body + entries


def traces(pace):
    scans = [3000 + (b - 65) * pace for b in STANDARD_BPS]
    length = scans[-1] + 400
    standard = np.zeros(length, int)
    for s in (scans[0] - 150, *scans, scans[-1] + 200):
        standard[s - 1 : s + 2] = (100, 900, 100)
    dyes = {tag: (np.arange(length) * (k + 3) % 211 + 5).tolist() for k, tag in enumerate((1, 2, 3, 4, 106))}
    return {**dyes, 205: standard.tolist()}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("profiles")
    made = {"run 1/1A2_A01_01.hid": abif(traces(9)), "run 1/1B3_A02_01.hid": abif(traces(10)), "run 2/2C2_B01_01.hid": abif(traces(20)), "run 2/3D2_B02_01.hid": b"nothing", "run 2/2E5_C01_01.hid": abif(traces(11)), "run 2/Ladder_1.hid": abif(traces(9))}
    for name, content in made.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(content)
    return root


@pytest.fixture(scope="module")
def kit(spark):
    return files.panel_from_contents(spark, [(0, "AMEL", "X", 81.5, 0.5, 0.5, 0), (0, "D3", "15", 120.0, 0.4, 0.6, 1), (1, "D1", "13", 150.0, 0.5, 0.5, 2)])


@pytest.fixture(scope="module")
def tables(spark, folder):
    samples = files.scan_profiles(spark, str(folder))
    annotations = spark.createDataFrame([(f"{n}_01", n[:3], "r") for n in ("1A2_A01", "1B3_A02", "2C2_B01", "3D2_B02")], "stem string, annotation string, report string")
    rows = [("1A2", "D3", "15", 80.0), ("1A2", "D1", "13", 70.0), ("1B3", "AMEL", "X", 60.0), ("1B3", "Unknown", "1", 50.0), ("2C2", "D3", "15", 1.0), ("3D2", "D3", "15", 1.0)]
    return samples, annotations, spark.createDataFrame(rows, "sample string, marker string, allele string, height double")


def test_files_become_profiles(tables, kit):
    got = dataset.load_profiles(*tables, kit)
    # 2C2's standard is out of range, 3D2 is no such file, 2E5 has no annotation
    assert sorted(tuple(r) for r in got.profiles.select("hid", "annotation", "panel_id").collect()) == [("1A2_A01_01", "1A2", "default"), ("1B3_A02_01", "1B3", "default")]
    assert {(r["hid"], r["dye"]): r["n"] for r in got.pixels.groupBy("hid", "dye").agg(F.countDistinct("px").alias("n")).collect()} == {(h, d): 4096 for h in ("1A2_A01_01", "1B3_A02_01") for d in range(5)}
    grid = {h: {r["px"]: r["bp"] for r in got.scaler.collect() if r["hid"] == h} for h in ("1A2_A01_01", "1B3_A02_01")}
    pace = {"1A2_A01_01": 9, "1B3_A02_01": 10}
    for r in got.pixels.where("px % 97 = 0").collect():  # the standard is linear here, so a pixel's scan is known
        scan = round(3000 + (grid[r["hid"]][r["px"]] - 65) * pace[r["hid"]])
        assert r["rfu"] == scan * (r["dye"] + 3) % 211 + 5
    expected = set()
    for h, dye, low, high in (("1A2_A01_01", 0, 119.6, 120.6), ("1A2_A01_01", 1, 149.5, 150.5), ("1B3_A02_01", 0, 81.0, 82.0)):
        nearest = lambda bp, own=grid[h]: min(own, key=lambda p: (abs(own[p] - bp), p))
        expected |= {(h, dye, px) for px in range(nearest(low), nearest(high))}
    assert {tuple(r) for r in got.mask.collect()} == expected
    assert {(r["hid"], r["marker"], r["allele"], r["source"]) for r in got.calls.collect()} == {("1A2_A01_01", "D3", "15", "analyst"), ("1A2_A01_01", "D1", "13", "analyst"), ("1B3_A02_01", "AMEL", "X", "analyst")}


def test_ladders_adjustment_and_donors(spark, tables, kit):
    ladders = spark.createDataFrame([("1A2_A01_01", "L1")], "stem string, ladder_path string")
    moved = kit.withColumn("base_pair", F.col("base_pair") + 2).withColumn("panel_id", F.lit("L1"))
    donors = spark.createDataFrame([("1A", "D3", "15", "16"), ("1B", "D3", "15", "17")], "donor string, marker string, allele1 string, allele2 string")
    plain = dataset.load_profiles(*tables, kit)
    got = dataset.load_profiles(*tables, kit, ladders, moved, skip_without_ladder=True, donors=donors)
    assert [tuple(r) for r in got.profiles.select("hid", "panel_id").collect()] == [("1A2_A01_01", "L1")]
    shifted = panel.allele_info(spark.createDataFrame([("L1", "D3", "15")], "panel_id string, marker string, allele string"), moved).first()
    assert shifted["bp"] == 122.0 and got.mask.agg(F.min("px")).first()[0] > plain.mask.where("hid = '1A2_A01_01'").agg(F.min("px")).first()[0]
    assert {(r["allele"], r["source"]) for r in got.calls.where("marker = 'D3'").collect()} == {("15", "analyst"), ("15", "donor"), ("16", "donor"), ("17", "donor")}
    top = dataset.load_profiles(*tables, kit, adjustment="top")
    marked = plain.pixels.join(plain.mask.withColumn("mask", F.lit(True)), ["hid", "dye", "px"], "left").fillna(False, ["mask"])
    assert {tuple(r) for r in top.mask.collect()} == {tuple(r) for r in annotate.adjust_top(marked).collect()}
    with pytest.raises(ValueError, match="adjustment"):
        dataset.load_profiles(*tables, kit, adjustment="none")


def test_every_file_has_an_outcome(spark, tables, kit, tmp_path):
    samples, annotations, reported = tables
    lacking = traces(9)
    del lacking[4]
    more = spark.createDataFrame([("9A2_lacking", bytearray(abif(lacking))), ("9A2_none", bytearray(abif({}))), ("9B2_silent", bytearray(abif(traces(9))))], "stem string, content binary")
    every = samples.select("stem", "content").unionByName(more)
    named = annotations.unionByName(more.select("stem", "stem", "stem").toDF("stem", "annotation", "report"))
    expected = {"1A2_A01_01": "kept", "1B3_A02_01": "kept", "2C2_B01_01": "standard invalid", "3D2_B02_01": "not ABIF", "2E5_C01_01": "no annotation", "9A2_lacking": "channels missing", "9A2_none": "channels missing", "9B2_silent": "no calls"}
    got = dataset.load_profiles(every, named, reported, kit)
    assert {r["hid"]: r["status"] for r in got.outcomes.collect()} == expected
    assert {r["status"]: r["n"] for r in metrics.load_report(got.outcomes).collect()} == {"kept": 2, "standard invalid": 1, "not ABIF": 1, "no annotation": 1, "channels missing": 2, "no calls": 1}
    paths = spark.createDataFrame([("1A2_A01_01", "L1")], "stem string, ladder_path string")
    skipped = dataset.load_profiles(every, named, reported, kit, paths, skip_without_ladder=True)
    assert {r["hid"]: r["status"] for r in skipped.outcomes.collect()} == {h: "kept" if h == "1A2_A01_01" else x if x == "no annotation" else "no ladder" for h, x in expected.items()}


def test_files_are_chosen_before_they_are_decoded(spark, tables, kit):
    samples, annotations, reported = tables
    got = dataset.load_profiles(samples, annotations, reported, kit, limit=1)
    assert [r["hid"] for r in got.profiles.collect()] == ["1A2_A01_01"]
    assert {r["hid"]: r["status"] for r in got.outcomes.collect()} == {"1A2_A01_01": "kept", "2E5_C01_01": "no annotation", **{h: "not chosen" for h in ("1B3_A02_01", "2C2_B01_01", "3D2_B02_01")}}
    listed = annotations.select(F.col("stem").alias("hid"))
    seeded = {r["hid"] for r in dataset.chosen_files(listed, 2, None, 5).collect()}
    assert len(seeded) == 2 and seeded == {r["hid"] for r in dataset.chosen_files(listed.repartition(3), 2, None, 5).collect()}
    many = spark.createDataFrame([(f"{i % 6 + 1}{'ABCDEF'[i % 5]}{2 + i % 3}_{i}",) for i in range(120)], "hid string")
    one, two = ({r["hid"] for r in dataset.chosen_files(many, None, (0.5, part), 3).collect()} for part in (1, 2))
    assert one and two and not one & two and len(one | two) == 120
    assert not {h.split("_")[0] for h in one} & {h.split("_")[0] for h in two}  # replicas stay together
    assert dataset.load_profiles(samples, annotations, reported, kit, holdout=(0.5, 2), seed=1).profiles.count() <= 2


def test_names_that_listings_escape(spark, tmp_path):
    names = ["1A2_a b.hid", "1A2_#1.hid", "1A2_50%.hid", "1A2_%20.hid", "1A2_ü+ö.hid", "1A2_a+b.hid"]
    folder = tmp_path / "run #1 50% ä+b"
    folder.mkdir()
    for n in names:
        (folder / n).write_bytes(b"x")
    (folder / "LADDER x.hid").write_bytes(b"x")
    got = files.scan_profiles(spark, str(tmp_path)).select("stem", "folder", "name").collect()
    assert sorted(r["name"] for r in got) == sorted(names) and {r["folder"] for r in got} == {folder.name}
    assert sorted(r["stem"] for r in got) == sorted(n[:-4] for n in names)
    assert [r["name"] for r in files.scan_profiles(spark, str(tmp_path), ladders=True).select("name").collect()] == ["LADDER x.hid"]


def shaped(pace, peaks, moved=0.0, missing=()):
    """Channels whose dyes have a peak at some base pairs (dye, bp)."""
    made = traces(pace)
    for dye, tag in enumerate((1, 2, 3, 4, 106)):
        values = np.full(len(made[205]), 5)
        for k, (_, bp) in enumerate(p for p in peaks if p[0] == dye):
            if (dye, k) not in missing:
                at = round(3000 + (bp + moved - 65) * pace)
                values[at - 12 : at + 13] = 1000 - 70 * np.abs(np.arange(-12, 13))
        made[tag] = values.tolist()
    return made


def test_ladders_are_selected_from_files(spark, tmp_path):
    """By hand: profiles and ladders of two folders, one of them without a valid ladder."""
    places = [(dye, 90.0 + 40 * k + 5 * dye) for dye in range(5) for k in range(4)]
    kit = files.panel_from_contents(spark, [(d, f"M{d}", str(k % 4), bp, 0.5, 0.5, k) for k, (d, bp) in enumerate(places)])
    known = spark.createDataFrame([(d, k, f"M{d}", str(k)) for d in range(5) for k in range(4)], "dye int, k int, marker string, allele string")
    made = {
        "a/1A2_x.hid": shaped(9, places, 1.0), "a/1B2_x.hid": shaped(10, places, 0.0), "a/1C2_x.hid": shaped(9, []), "b/1D2_x.hid": shaped(9, places),
        "a/Ladder_0.hid": shaped(10, places, 0.0), "a/Ladder_1.hid": shaped(9, places, 1.0), "a/Ladder_2.hid": shaped(11, places, 1.0), "a/Ladder_3.hid": shaped(9, places, 0.0, missing=[(2, 1)]),
        "a/ladder_ppy23.hid": shaped(9, places, 1.0), "b/Ladder_bad.hid": shaped(20, places), "b/Ladder_none.hid": None,
    }
    for name, channels in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"no file" if channels is None else abif(channels))
    samples = files.scan_profiles(spark, str(tmp_path))
    stems = ["1A2_x", "1B2_x", "1C2_x", "1D2_x"]
    annotations = spark.createDataFrame([(s, s, "r") for s in stems], "stem string, annotation string, report string")
    calls = [(s, f"M{d}", str(k), 100.0) for s in stems for d in range(5) for k in range(3)] + [("1A2_x", "M0", "unknown", 1.0), ("1A2_x", "M1", "2", 100.0)]
    loaded = dataset.load_profiles(samples, annotations, spark.createDataFrame(calls, "sample string, marker string, allele string, height double"), kit)
    found = ladders.select_ladders(samples, loaded, files.scan_profiles(spark, str(tmp_path), ladders=True), kit, known)
    got = {r["image_path"]: r["ladder_path"] and r["ladder_path"].rsplit("/", 1)[1] for r in found.collect()}
    assert got == {"1A2_x": "Ladder_1.hid", "1B2_x": "Ladder_0.hid", "1C2_x": None, "1D2_x": None}
    files.write_best_ladders(found, str(tmp_path / "best"))
    back = dataset.load_profiles(samples, annotations, spark.createDataFrame(calls, "sample string, marker string, allele string, height double"), kit,
        files.read_best_ladders(spark, str(tmp_path / "best")).withColumnRenamed("image_path", "stem"), ladders.ladder_panels(files.scan_profiles(spark, str(tmp_path), ladders=True), kit, known), skip_without_ladder=True)
    assert {(r["hid"], r["panel_id"].rsplit("/", 1)[1]) for r in back.profiles.collect()} == {("1A2_x", "Ladder_1.hid"), ("1B2_x", "Ladder_0.hid")}
