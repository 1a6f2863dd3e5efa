"""Quality classifier on supervised subword embeddings.

Words and character n-grams (bytes of the lower-cased text) are hashed into ``buckets`` rows of an
embedding; a document is the mean of its rows, and a softmax over two classes reads that mean. Both
matrices are trained by numpy stochastic gradient descent on at most ``max_rows`` labelled documents, the
ones with the smallest hash of doc_id (a bound on fitting only; every document is scored whole). Of rows
with the same doc_id one teaches, that with the smallest hash of its text. Tasks turn the sampled
documents into counts per bucket, so texts never reach the driver, and of these counts at most
``max_features`` do (8 bytes each): documents are left out from the largest hash on. Both bounds hold
before anything is collected. For scoring the embedding and the softmax collapse into one number per
bucket, since the mean is linear.

``repetition`` adds a row for how each word repeats earlier ones (``repeats``), which no n-gram of fixed
size can show and which is no n-gram itself; the query leaves it off.

Defined cases: null text counts as empty; a text without features has the score of the softmax's
bias. Null labels teach nothing; of several labels of a document the largest counts. With labels of
one class only, or none, the score is the share of label 1 (0.5 without any). Null doc_id is never
learnt from. Repeated rows are scored alike; an empty table gives an empty table. Columns other than
those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, discard, mapped, mixed, powers, prefix_hashes, table, text_batches, text_bytes, word_hashes, written

BUCKETS = 1 << 16
DIMENSIONS = 12
NGRAMS = (3, 5)
PERIODS = 16
MAX_ROWS = 4000
MAX_FEATURES = 1 << 25
EPOCHS = 6
RATE = 2.0
THRESHOLD = 0.3


def features(array: pa.Array, buckets: int, repetition: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word and n-gram; n-grams never cross rows."""
    raw, offsets = text_bytes(array)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    words, word_offsets = word_hashes(raw, offsets)
    made = [words]
    of = [np.repeat(np.arange(len(offsets) - 1), np.diff(word_offsets))]
    if repetition:
        made.append(repeats(words, word_offsets))
        of.append(of[0])
    sums = prefix_hashes(_LOWER[raw] + np.uint64(1))
    for size in NGRAMS:
        n = len(raw) - size + 1
        if n > 0:
            same = rows[:n] == rows[size - 1 :]
            grams = mixed((sums[size:] - sums[:-size]) * powers(len(raw) + 1)[1][:n] + np.uint64(size))
            made.append(grams[same])
            of.append(rows[:n][same])
    shift = np.uint64(64 - int(buckets - 1).bit_length())
    return (np.concatenate(made) >> shift).astype(np.int64), np.concatenate(of)


def repeats(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A token per word for how it repeats: the least of PERIODS words back at which the same word
    stands, and whether the word before it repeats at that distance too."""
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    token = np.zeros(len(words), np.uint64)
    for period in range(PERIODS, 0, -1):
        same = np.zeros(len(words), bool)
        same[period:] = (words[period:] == words[:-period]) & (place[period:] >= period)
        pair = same.copy()
        pair[1:] &= same[:-1]
        token[same] = 2 * period
        token[pair] = 2 * period + 1
    return mixed(token + np.uint64(0xABCD))


class Classifier:
    def __init__(self, embedding: np.ndarray, output: np.ndarray, bias: np.ndarray, repetition: bool = False):
        self.embedding, self.output, self.bias, self.repetition = embedding, output, bias, repetition

    def per_bucket(self) -> tuple[np.ndarray, float]:
        """What a bucket adds to the difference of the two logits, and the bias."""
        return self.embedding @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, dimensions: int, epochs: int, rate: float, seed: int = 7) -> Classifier:
    """rows: buckets, their weights (summing to 1) and the label of each document."""
    random = np.random.default_rng(seed)
    embedding = random.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions))
    output, bias = random.normal(0, 0.1, (dimensions, 2)), np.zeros(2)
    share = np.mean([y for *_, y in rows]) if rows else 0.5
    if not 0 < share < 1:
        bias[1] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Classifier(embedding, np.zeros_like(output), bias)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(len(rows)):
            where, weights, label = rows[i]
            mean = weights @ embedding[where]
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            pull = output @ p
            output -= 0.1 * step * np.outer(mean, p)
            bias -= 0.02 * step * p
            embedding[where] -= step * 10 * np.outer(weights, pull)
    return Classifier(embedding, output, bias)


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """draw, quality and text of at most max_rows documents, one row for each doc_id."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = marked.withColumn("draw", F.xxhash64(F.lit("quality"), "doc_id")).orderBy("draw", "doc_id").limit(max_rows)
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", body.alias("text")).join(F.broadcast(sample), "doc_id")  # max_rows rows
    return rows.groupBy("doc_id").agg(F.first("draw").alias("draw"), F.first("quality").cast("int").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, max_features: int = MAX_FEATURES, repetition: bool = False
) -> Classifier:
    """docs: doc_id, text; labels: doc_id, quality. The caller leaves held-out rows away."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_batches(batch, "text"):
                part = batch.slice(start, stop - start)
                bucket, row = features(part.column("text"), buckets, repetition)
                keys, counts = np.unique((row << 32) | bucket, return_counts=True)
                ends = np.searchsorted(keys >> 32, np.arange(len(part) + 1))
                offsets = pa.array(ends.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "draw", "quality")), pa.ListArray.from_arrays(offsets, pa.array((keys & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.float32)))],
                    names=["doc_id", "draw", "quality", "buckets", "counts"],
                )

    made = written(sampled(docs, labels, max_rows).mapInArrow(count, "doc_id long, draw long, quality int, buckets array<int>, counts array<float>"), "quality-sample")
    sizes = made.select("draw", F.size("buckets").alias("n")).toArrow()  # max_rows rows of two numbers
    order = np.argsort(sizes.column("draw").to_numpy(), kind="stable")
    kept = int((np.cumsum(sizes.column("n").to_numpy()[order].astype(np.int64)) <= max_features).sum())
    last = int(sizes.column("draw").to_numpy()[order][kept - 1]) if kept else None
    chosen = (made.where(F.col("draw") <= last) if kept else made.limit(0)).toArrow()
    discard(made)
    rows = []
    for i in np.argsort(chosen.column("doc_id").to_numpy(), kind="stable").tolist():
        counts = chosen.column("counts")[i].values.to_numpy()
        if len(counts):
            rows.append((chosen.column("buckets")[i].values.to_numpy(), counts / counts.sum(), int(chosen.column("quality")[i].as_py() > 0)))
    learnt = train(rows, buckets, dimensions, epochs, rate)
    learnt.repetition = repetition
    return learnt


def score(docs: DataFrame, classifier: Classifier, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score of every row."""
    weights, bias = classifier.per_bucket()
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias, classifier.repetition))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        weights, bias, repetition = shared.value
        bucket, row = features(batch.column("text"), len(weights), repetition)
        n = np.bincount(row, minlength=len(batch))
        logit = np.bincount(row, weights=weights[bucket], minlength=len(batch)) / np.maximum(n, 1) + bias
        yield {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(logit, -700, 700)))}

    return mapped(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double")


def learnable(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != 0


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    keep = learnable(F.col("doc_id"))
    classifier = fit(docs.where(keep), labels.where(keep))
    scored = score(docs, classifier)
    return scored.select("doc_id", (~keep).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
