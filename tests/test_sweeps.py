"""Sweeps of traces: peaks far away, peaks in overlapping spans, anchors of a panel; against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import panel, signal
from locusframe.sources import files


def as_table(spark, series):
    return spark.createDataFrame([(h, 0, int(p), int(x)) for h, vs in series.items() for p, x in vs], "hid int, dye int, px int, rfu int").repartition(3)


def tops(v):
    p = [0, *v, 0]
    return [i - 1 for i in range(1, len(p) - 1) if p[i] >= max(p[i - 1], p[i + 1]) and p[i] > min(p[i - 1], p[i + 1])]


def test_nearest_peak_beyond_many_low_ones(spark):
    rng = np.random.default_rng(2)
    low = rng.integers(0, 9, 400).tolist()
    series = {
        0: [90, *low, *range(10, 400), 5],  # a long slope up: left of it nothing but low peaks, then a high one far away
        1: [*range(300, 9, -1), *low, 95],
        2: [*low, *range(10, 120), *range(120, 9, -1), *low, 200, *low],
        3: [-5, -3, -9, -2, -1],  # below the value outside
        4: [-9 - x for x in low] + [50] + [-9 - x for x in low],
        5: rng.integers(0, 50, 700).tolist(),
    }
    table = as_table(spark, {h: enumerate(v) for h, v in series.items()})
    expected = {}
    for h, v in series.items():
        peaks = np.array(tops(v), int)
        for i in range(len(v)):
            good = peaks[np.array(v)[peaks] >= v[i]] if len(peaks) else peaks
            if len(good):
                expected[h, i] = min(good.tolist(), key=lambda p: (abs(p - i), p))
    got = {(r["hid"], r["px"]): r["peak"] for r in signal.nearest_peak(table, table.select("hid", "dye", "px")).collect()}
    assert got == expected
    # queries without a pixel, twice, with more columns
    some = spark.createDataFrame([(0, 0, 300, "a"), (0, 0, 300, "a"), (0, 0, 9999, "b"), (77, 0, 1, "c")], "hid int, dye int, px int, note string")
    rows = signal.nearest_peak(table, some).collect()
    assert [(r["px"], r["note"], r["peak"], r["peak_rfu"]) for r in rows] == [(300, "a", expected[0, 300], series[0][expected[0, 300]])] * 2


def has_peak(values, share):
    """values of a slice: a strict maximum (flat tops count, edges do not) of at least share of the largest."""
    ends = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]
    runs = [values[a] for a in ends[:-1]]
    return any(x > a and x > b and x >= share * max(values) for a, x, b in zip(runs, runs[1:], runs[2:]))


def test_peaks_in_overlapping_spans(spark):
    rng = np.random.default_rng(5)
    series = {h: list(enumerate(rng.integers(0, 7, 60 + h).tolist())) for h in range(12)}
    series |= {20: [(p, x) for p, x in enumerate([3] * 40)], 21: [(p, 3 if 10 <= p < 15 else 0) for p in range(30)], 22: [(3 * p, int(x)) for p, x in enumerate(rng.integers(0, 9, 40))]}  # one with gaps
    spans = []
    for h, v in series.items():
        for k in range(60):
            l = int(rng.integers(-5, len(v) + 3))  # noqa: E741
            spans.append((f"L{k % 3}", h, 0, "m", str(k), l, l + int(rng.integers(-1, 25))))
    spans += spans[:7] + [("L0", 99, 0, "m", "no trace", 0, 9)]
    df = spark.createDataFrame(spans, "ladder_id string, hid int, dye int, marker string, allele string, l int, r int")
    for share in (0.8, 0.3):
        expected = sorted((*s, has_peak([x for p, x in series.get(s[1], []) if s[5] <= p < s[6]] or [0], share)) for s in spans)
        assert sorted(tuple(r) for r in panel.bin_has_peak(df, as_table(spark, series), share).collect()) == expected
    assert panel.bin_has_peak(df.where("false"), as_table(spark, series)).count() == 0


@pytest.mark.parametrize("known", [[], [3], [0, 1], [2, 5], [0, 9], [1, 4, 7], list(range(10))])
def test_anchors_of_a_marker(spark, known):
    bp = [100 + 4.0 * i + (i % 3) * 0.3 for i in range(10)]
    kit = files.panel_from_contents(spark, [(0, "M", str(i), b, 0.5, 0.5, i) for i, b in enumerate(bp)]).withColumn("panel_id", F.lit("kit"))
    alleles = spark.createDataFrame([("kit", 0, k, "M", str(i)) for k, i in enumerate(known)], "panel_id string, dye int, k int, marker string, allele string")
    peaks = spark.createDataFrame([("L", 0, k, 10 * k) for k in range(len(known))], "hid string, dye int, k int, px int")
    scaler = spark.createDataFrame([("L", 10 * k, bp[i] + 0.7 + 0.01 * i * i) for k, i in enumerate(known)], "hid string, px int, bp double")
    moved = panel.adjust_panel(kit, alleles, peaks, scaler, spark.createDataFrame([("L", "kit")], "hid string, panel_id string"))
    assert "collect_list" not in moved._jdf.queryExecution().optimizedPlan().toString()
    got = {int(r["allele"]): r["base_pair"] for r in moved.collect()}
    own = {i: bp[i] + 0.7 + 0.01 * i * i for i in known}
    for i in range(10):
        if i in own or len(known) < 2:
            assert got[i] == pytest.approx(own.get(i, bp[i]))
            continue
        before, after = [k for k in known if k < i], [k for k in known if k > i]
        a, b = (after[0], after[1]) if not before else (before[-2], before[-1]) if not after else (before[-1], after[0])
        assert got[i] == pytest.approx(own[a] + (bp[i] - bp[a]) * (own[b] - own[a]) / (bp[b] - bp[a]))
