"""A pixel classifier on window features with MLlib, its cross-validation and evaluation.

The models of all folds of a cross-validation come from the same passes: features are made once and
written; a pass adds up, for each fold's model, the gradient and the curvature over the rows of the other
folds (numpy inside the tasks, sums by Spark), and a Newton step moves all models at once. They minimise
what MLlib minimises: the mean loss plus reg / 2 times the squared weights of standardised features.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import sigmoid
from ..sources.scratch import written
from .annotate import call_alleles
from .metrics import evaluation_suite, fold_means, pixel_metrics
from .panel import BUCKETS, bp_bucket, bp_buckets, by_dye_bp
from .signal import along
from .splits import grouped_holdout_split

REACH = 3


def pixel_features(pixels: DataFrame, reach: int = REACH) -> DataFrame:
    """Own dye at px - reach .. px + reach, the other dyes at px, and the dye's maximum; log scale."""
    w, at, dye = along(), Window.partitionBy("hid", "px"), Window.partitionBy("hid", "dye")
    v = F.signum("rfu") * F.log1p(F.abs(F.col("rfu")).cast("double"))
    base = pixels.withColumn("_v", v)
    shifts = {f"f{k + reach}": F.coalesce(F.lag("_v", -k).over(w), F.lit(0.0)) for k in range(-reach, reach + 1)}
    near = base.withColumns(shifts).withColumn("fmax", F.max("_v").over(dye))
    return near.withColumn("fother", (F.sum("_v").over(at) - F.col("_v"))).drop("_v")


def feature_names(reach: int = REACH) -> list[str]:
    return [*[f"f{k}" for k in range(2 * reach + 1)], "fmax", "fother"]


def fit_pixel_model(pixels: DataFrame, max_iter: int = 30, reg: float = 1e-4) -> PipelineModel:
    """pixels: hid, dye, px, rfu, mask. Not the reference network: the same inputs and outputs."""
    features = pixel_features(pixels).withColumn("label", F.col("mask").cast("double"))
    steps = [VectorAssembler(inputCols=feature_names(), outputCol="features"), LogisticRegression(maxIter=max_iter, regParam=reg)]
    return Pipeline(stages=steps).fit(features)


def predict_pixels(model: PipelineModel, pixels: DataFrame) -> DataFrame:
    """pixels with prob."""
    scored = model.transform(pixel_features(pixels))
    return scored.select(*pixels.columns, vector_to_array("probability")[1].alias("prob"))


WIDTHS = (2, 4, 8, 16, 32, 64)


def multi_scale_features(pixels: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """pixels with own (log scale), the mean over each of WIDTHS pixels around it and how far it rises above
    that mean, the dye's maximum, how far the pixel lies from its place, the highest other dye at px (the mean
    of the others where the pixel's own is the highest), and, with a panel and pixels with bp, the distance to
    the dye's nearest allele. Means come from running sums, so a width costs the same whatever it is."""
    w, dye, at = along(), Window.partitionBy("hid", "dye"), Window.partitionBy("hid", "px")
    v = F.signum("rfu") * F.log1p(F.abs(F.col("rfu")).cast("double"))
    base = pixels.withColumn("own", v)
    summed = base.withColumns({"_sum": F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w)})
    whole = summed.withColumns({"_all": F.sum("own").over(dye), "_many": F.count("own").over(dye), "top": F.max("own").over(dye), "_at": F.max_by("px", F.struct("own", -F.col("px"))).over(dye)})
    made = whole
    for size in WIDTHS:
        half = size // 2
        until, before = F.coalesce(F.lead("_sum", half).over(w), F.col("_all")), F.coalesce(F.lag("_sum", half + 1).over(w), F.lit(0.0))
        many = F.least(F.col("_n") + half, F.col("_many")) - F.greatest(F.col("_n") - half - 1, F.lit(0))
        made = made.withColumn(f"mean{size}", (until - before) / many)
    rises = {f"rise{size}": F.col("own") - F.col(f"mean{size}") for size in WIDTHS}
    made = made.withColumns(rises | {"off_top": F.abs(F.col("px") - F.col("_at")).cast("double")})
    ranked = made.withColumns({"_most": F.max(F.struct("own", "dye")).over(at), "_dyes": F.count("own").over(at)})
    # the highest other dye: the pixel's own one does not count where it is itself the highest
    ranked = ranked.withColumn("other", F.when(F.col("_most.dye") != F.col("dye"), F.col("_most.own")).otherwise(F.coalesce((F.sum("own").over(at) - F.col("own")) / F.nullif(F.col("_dyes") - 1, F.lit(0)), F.lit(0.0))))
    found = ranked.drop("_sum", "_n", "_all", "_many", "_at", "_most", "_dyes")
    return found if panel is None else with_allele_distance(found, panel)


def with_allele_distance(pixels: DataFrame, panel: DataFrame) -> DataFrame:
    """pixels (dye, bp, more) with bin_distance to the nearest allele of their dye, at most BUCKETS base pairs."""
    near = pixels.withColumn("_bucket", bp_bucket(F.col("bp"))).join(bp_buckets(by_dye_bp(panel)), ["dye", "_bucket"], "left")
    gap = F.array_min(F.transform("_alleles", lambda a: F.abs(a["base_pair"] - F.col("bp"))))
    return near.withColumn("bin_distance", F.least(F.coalesce(gap, F.lit(float(BUCKETS))), F.lit(float(BUCKETS)))).drop("_bucket", "_alleles")


def multi_scale_names(panel: bool = False) -> list[str]:
    return ["own", *[f"{n}{size}" for n in ("mean", "rise") for size in WIDTHS], "top", "off_top", "other", *(["bin_distance"] if panel else [])]


def fit_boosted_model(pixels: DataFrame, panel: DataFrame | None = None, rounds: int = 20, depth: int = 5, seed: int = 7) -> PipelineModel:
    """Boosted trees on multi-scale features; pixels: hid, dye, px, rfu, mask, and bp where a panel is given."""
    features = multi_scale_features(pixels, panel).withColumn("label", F.col("mask").cast("double"))
    steps = [VectorAssembler(inputCols=multi_scale_names(panel is not None), outputCol="features"), GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)]
    return Pipeline(stages=steps).fit(features)


def predict_boosted(model: PipelineModel, pixels: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """pixels with prob."""
    scored = model.transform(multi_scale_features(pixels, panel))
    return scored.select(*pixels.columns, vector_to_array("probability")[1].alias("prob"))


def weights(model: PipelineModel, spark) -> DataFrame:
    """feature, weight of the classifier, with its intercept."""
    fitted = model.stages[-1]
    rows = [*zip(feature_names(), map(float, fitted.coefficients)), ("intercept", float(fitted.intercept))]
    return spark.createDataFrame(rows, "feature string, weight double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def all_metrics(scored: DataFrame, panel: DataFrame | None, truth: DataFrame | None, groups: DataFrame | None = None) -> DataFrame:
    """metric, variant, value: all of the evaluation suite where a panel and the true calls (hid, marker,
    allele, height) are given and pixels have bp; the pixel metrics alone otherwise. For each of the groups of
    pixels, if given."""
    keys = [] if groups is None else groups.columns
    if panel is None or truth is None:
        return pixel_metrics(scored, groups=groups).select(*keys, "metric", F.lit("none").alias("variant"), "value")
    own = truth.join(scored.select(*keys, "hid").distinct(), "hid")
    named = scored.withColumn("hid", F.struct("hid", *keys))
    called = call_alleles(named, panel).select("hid.*", "dye", "marker", "allele", "height")
    return evaluation_suite(scored, called, own, groups=groups)


def fold_moments(features: DataFrame, k: int, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per fold's model: the number of its training rows (all but the fold's own) and the deviation of each feature among them."""
    sums = [F.count(F.lit(1)).alias("n"), *[x for c in names for x in (F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"q_{c}"))]]
    found = {r["fold"]: r for r in features.groupBy("fold").agg(*sums).collect()}  # one row a fold
    columns = ("n", *[f"s_{c}" for c in names], *[f"q_{c}" for c in names])
    of = {f: np.array([r[x] for x in columns], float) for f, r in found.items()}
    rest = sum(of.values(), np.zeros(len(columns))) - np.array([of.get(f, np.zeros(len(columns))) for f in range(k)])
    n, total, squares = rest[:, :1], rest[:, 1 : len(names) + 1], rest[:, len(names) + 1 :]
    variance = np.maximum(squares - total**2 / np.maximum(n, 1), 0) / np.maximum(n - 1, 1)
    return n[:, 0], np.sqrt(variance)


def packed(features: DataFrame, names: list[str]) -> DataFrame:
    """fold, values: the labels and features of a batch's rows of one fold, a column after the other, as the bytes of
    doubles, so that passes over them need not make rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", *names)], float)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            own = np.unique(fold)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([x[:, fold == f].tobytes() for f in own], pa.binary())], names=["fold", "values"])

    return features.select("fold", "label", *names).mapInArrow(run, "fold long, values binary")


def fold_sums(blocks: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of each fold's model over the rows of the other folds (as packed gives them), in one pass."""
    k, width = weights.shape
    shared = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total = np.zeros((k, 1 + width + width * width))
        for batch in batches:
            for fold, values in zip(batch.column("fold").to_pylist(), batch.column("values")):
                made = np.frombuffer(values.as_buffer()).reshape(width, -1)
                label, x = made[0], np.vstack([made[1:], np.ones(made.shape[1])])
                for i in range(k):
                    if i == fold:
                        continue
                    z = w[i] @ x
                    e = np.exp(-np.abs(z))
                    p = np.where(z >= 0, 1.0, e) / (1 + e)
                    total[i, 0] += (np.maximum(z, 0) + np.log1p(e) - label * z).sum()
                    total[i, 1 : 1 + width] += x @ (p - label)
                    total[i, 1 + width :] += ((x * (p * (1 - p))) @ x.T).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), k)), pa.array(total.ravel())], names=["model", "place", "value"])

    parts = blocks.mapInArrow(run, "model long, place long, value double")
    rows = parts.groupBy("model", "place").agg(F.sum("value").alias("value")).toArrow()  # k models of some hundred numbers
    made = np.zeros((k, 1 + width + width * width))
    made[rows.column("model").to_numpy(), rows.column("place").to_numpy()] = rows.column("value").to_numpy()
    return made[:, 0], made[:, 1 : 1 + width], made[:, 1 + width :].reshape(k, width, width)


def fit_folds(features: DataFrame, k: int, names: list[str] | None = None, max_iter: int = 30, reg: float = 1e-4, tolerance: float = 1e-9) -> np.ndarray:
    """Weights (the features', then the intercept) of k models, each fitted on all rows of features (fold,
    label, the features) but those of its own fold. One pass for all of them an iteration."""
    names = names or feature_names()
    n, deviation = fold_moments(features, k, names)
    n = np.maximum(n, 1)
    ridge = np.column_stack([reg * deviation**2, np.zeros(k)])
    idle = np.column_stack([deviation == 0, np.zeros(k, bool)])  # constant features have weight 0
    weights, step, before = np.zeros((k, len(names) + 1)), np.zeros((k, len(names) + 1)), np.full(k, np.inf)
    blocks = written(packed(features, names), "fold-blocks")
    for _ in range(max_iter):
        loss, gradient, curve = fold_sums(blocks, weights)
        cost = loss / n + 0.5 * (ridge * weights**2).sum(axis=1)
        worse = cost > before + 1e-12
        step[worse] /= 2  # back half of the way
        weights[worse] -= step[worse]
        for i in np.flatnonzero(~worse):
            slope = np.where(idle[i], 0.0, gradient[i] / n[i] + ridge[i] * weights[i])
            bend = curve[i] / n[i] + np.diag(ridge[i] + np.where(idle[i], 1.0, 1e-12))
            step[i] = -np.linalg.solve(bend, slope)
        before[~worse] = cost[~worse]
        if np.abs(step).max() < tolerance:
            break
        weights[~worse] += step[~worse]
    return weights


def fold_scores(features: DataFrame, weights: np.ndarray, columns: list[str], names: list[str] | None = None) -> DataFrame:
    """columns, fold and prob: each row scored by the model of its own fold, which has not seen it."""
    names = names or feature_names()
    of = lambda j: F.element_at(F.array(*[F.lit(float(w)) for w in weights[:, j]]), F.col("fold").cast("int") + 1)
    z = reduce(lambda a, b: a + b, [of(j) * F.col(c) for j, c in enumerate(names)], of(len(names)))
    return features.select(*columns, "fold", sigmoid(z).alias("prob"))


def cross_validate(folded: DataFrame, k: int, panel: DataFrame | None = None, truth: DataFrame | None = None, max_iter: int = 30, reg: float = 1e-4) -> DataFrame:
    """metric, variant, mean_value over k folds (folded: pixels with fold 0 .. k - 1, a profile in one fold, as
    grouped_kfold_split deals them). Features are made and read once for all folds, and the metrics of all
    folds come from the same passes."""
    columns = [c for c in folded.columns if c != "fold"]
    features = written(pixel_features(folded).withColumn("label", F.col("mask").cast("double")), "fold-features")
    scored = written(fold_scores(features, fit_folds(features, k, max_iter=max_iter, reg=reg), columns), "fold-scores")
    folds = scored.sparkSession.range(k).select(F.col("id").cast(scored.schema["fold"].dataType).alias("fold"))
    return fold_means(all_metrics(scored, panel, truth, folds))


def evaluate(model: PipelineModel, pixels: DataFrame, fraction: float | None = None, seed: int | str = 0, profiles: DataFrame | None = None, panel: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """Metrics of the model on the pixels, or on the second part of a grouped hold-out of the profiles (hid, noc, prefix)."""
    if fraction is not None:
        kept = grouped_holdout_split(profiles, fraction, seed).where("part = 2").select("hid")
        pixels = pixels.join(kept, "hid", "left_semi")
    return all_metrics(predict_pixels(model, pixels), panel, truth)
