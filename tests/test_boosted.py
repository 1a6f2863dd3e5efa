"""Boosted trees on multi-scale features against the linear model, held out by replicas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import model, splits
from locusframe.sources import files


@pytest.fixture(scope="module")
def pixels(spark):
    """Traces with true peaks some ten pixels wide, spikes of one pixel and broad humps of the same heights."""
    rng, rows = np.random.default_rng(21), []
    for h in range(16):
        for d in range(2):
            x, mask = rng.normal(10, 4, 300), np.zeros(300, bool)
            at = rng.permutation(np.arange(15, 285, 27))
            for k, c in enumerate(at):
                height, px = rng.uniform(150, 900), np.arange(300)
                if k % 3 == 0:
                    x += height * np.exp(-((px - c) ** 2) / 18)
                    mask |= abs(px - c) <= 4
                elif k % 3 == 1:
                    x[c] += height
                else:
                    x += height * np.exp(-((px - c) ** 2) / 300)
            rows += [(h, d, i, int(x[i]), bool(mask[i]), 65.0 + i, h % 2, h // 4) for i in range(300)]
    return spark.createDataFrame(rows, "hid int, dye int, px int, rfu int, mask boolean, bp double, noc int, prefix int").cache()


def f1(scored):
    r = scored.agg(*[F.count(F.when((F.col("prob") >= 0.5) == p, F.when(F.col("mask") == m, 1))) for p, m in ((True, True), (True, False), (False, True))]).first()
    return 2 * r[0] / (2 * r[0] + r[1] + r[2])


def test_features_by_numpy(spark, pixels):
    kit = files.panel_from_contents(spark, [(0, "A", "1", 70.0, 0.5, 0.5, 0), (0, "A", "2", 300.5, 0.5, 0.5, 1)])
    got = {(r["hid"], r["dye"], r["px"]): r for r in model.multi_scale_features(pixels.where("hid = 3"), kit).collect()}
    x = {d: np.array([r["rfu"] for r in pixels.where(f"hid = 3 and dye = {d}").orderBy("px").collect()], float) for d in (0, 1)}
    v = {d: np.sign(x[d]) * np.log1p(abs(x[d])) for d in x}
    for (_, d, i), r in got.items():
        for size in model.WIDTHS:
            around = v[d][max(0, i - size // 2) : i + size // 2 + 1]
            assert r[f"mean{size}"] == pytest.approx(around.mean()) and r[f"rise{size}"] == pytest.approx(v[d][i] - around.mean())
        assert r["top"] == pytest.approx(v[d].max()) and r["off_top"] == abs(i - int(v[d].argmax())) and r["other"] == pytest.approx(v[1 - d][i])
        assert r["bin_distance"] == pytest.approx(min(abs(65 + i - 70), abs(65 + i - 300.5)) if d == 0 else 4096)


def test_boosted_trees_beat_the_linear_model_on_other_replicas(pixels, tmp_path):
    parts = splits.grouped_holdout_split(pixels.select("hid", "noc", "prefix").distinct(), 0.7, 1).select("hid", "part")
    rows = pixels.join(parts, "hid")
    learn, judge = (rows.where(F.col("part") == p).select("hid", "dye", "px", "rfu", "mask").cache() for p in (1, 2))
    boosted = model.fit_boosted_model(learn, rounds=15)
    model.save_model(boosted, str(tmp_path / "boosted"))
    linear, trees = f1(model.predict_pixels(model.fit_pixel_model(learn), judge)), f1(model.predict_boosted(model.load_model(str(tmp_path / "boosted")), judge))
    print(f"held-out F1: linear {linear:.3f}, boosted {trees:.3f}")
    assert trees > linear + 0.05 and trees > 0.9
