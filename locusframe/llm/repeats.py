"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart only through ``threshold`` bytes, by most-significant-digit passes; groups of
one leave after each pass, and the groups that are left at full depth are exactly the repeated
windows. Digits are chosen by content, so that a pass over all suffixes needs few rows:

1. The first digit of a window is the 128-byte string in it with the least hash. Neighbouring windows
   mostly share that string, so a run of them is one row (about one for 140 bytes of text). Runs
   whose digit occurs once in the corpus hold no repeated window.
2. The second digit is the whole stretch of a run. Runs with equal stretches repeat wholly; of each
   stretch only one run goes on, and only where its first digit has several stretches.
3. The third digit is the core that CELL neighbouring windows share, at the same distance from the
   first digit; cells whose core occurs once leave.
4. The last digits are the few bytes on both sides of the core: first of whole cells, then, where a
   core has several kinds of sides, of each window.

A hot string costs one row per run in the first passes, which are counted before the shuffle, and
joins are with one row per digit, so Spark can split their hot side. A later pass works within the
groups of the one before it. The first digit only selects and is a 64-bit hash; what decides that
bytes are equal is compared as bytes (the sides of a core) or by SHA-256 of the bytes, cut to 128 bits
(stretches and cores). Digits are grouped, not put in order: the result needs the groups alone.

Defined cases: null text counts as empty. Texts under ``threshold`` bytes keep everything. A null
doc_id is a value of its own. Repeated rows are documents of their own, so their texts repeat.
Overlapping repeats count, in one text too; matches never cross documents. An empty table gives an
empty table. Long texts are cut into pieces that overlap by threshold - 1 bytes, which loses no
window. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, mixed, powers, prefix_hashes, row_bytes, table, text_bytes, written

THRESHOLD = 400
DIGIT = 128
CELL = 16
PIECE = 4 << 20
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
KEY = ("own_id", "own_text")  # doc_id and a hash of the text


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(raw: np.ndarray, offsets: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, rows and places in their rows of a run's texts, long ones cut with overlap."""
    sizes = np.diff(offsets)
    if len(raw) <= PIECE + threshold:
        yield raw, offsets, np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        return
    for row, (a, size) in enumerate(zip(offsets[:-1].tolist(), sizes.tolist())):
        for at in range(0, max(size - threshold + 1, 1), PIECE):
            part = raw[a + at : a + min(size, at + PIECE + threshold - 1)]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([at])


def runs(raw: np.ndarray, offsets: np.ndarray, threshold: int, digit: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with the same first digit: that digit's hash, the stretch's digest, the
    text it lies in, the first and last start, and the digit's place (in the given bytes)."""
    n = len(raw)
    empty = np.empty(0, np.int64)
    none = empty, pa.array([], pa.binary()), empty, empty, empty, empty
    if n < threshold:
        return none
    sums, down = prefix_hashes(_VALUES[raw]), powers(n + 1)[1]
    grams = mixed((sums[digit:] - sums[:-digit]) * down[: n - digit + 1])
    low = np.uint64((1 << 24) - 1)
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), threshold - digit + 1)
    room = np.zeros(n + 1, np.int32)  # windows that lie in one text
    sizes = np.diff(offsets)
    full = sizes >= threshold
    np.add.at(room, offsets[:-1][full], 1)
    np.add.at(room, (offsets[1:] - threshold + 1)[full], -1)
    starts = np.flatnonzero(np.cumsum(room[: len(least)]) > 0)
    if not len(starts):
        return none
    where = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    return grams[where[new]].view(np.int64), digests(raw, first, last + threshold), np.searchsorted(offsets, first, side="right") - 1, first, last, where[new]


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The first 16 bytes of the SHA-256 of each part of raw."""
    whole = memoryview(raw.tobytes())
    return pa.array([hashlib.sha256(whole[a:b]).digest()[:16] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())


RUNS = "own_id long, own_text long, digit long, stretch binary, first long, last long, anchor long"
CELLS = "own_id long, own_text long, digit long, cell int, core binary, low int, high int, anchor long, before binary, after binary"


def all_runs(docs: DataFrame, threshold: int, digit: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, texts = batch.column("own_id"), batch.column("own_text")
        for raw, offsets, rows, places in pieces(*text_bytes(batch.column("text")), threshold):
            digits, stretch, piece, first, last, anchor = runs(raw, offsets, threshold, digit)
            row = pa.array(rows[piece])
            base = places[piece] - offsets[piece]
            yield {"own_id": ids.take(row), "own_text": texts.take(row), "digit": digits, "stretch": stretch, "first": first + base, "last": last + base, "anchor": anchor + base}

    return mapped(docs.where(F.octet_length("text") >= threshold), run, RUNS)


def cells(docs: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """The wanted runs (collected by document) in cells of CELL neighbouring windows. A cell's windows
    start ``low`` to ``high`` bytes before its core, which all of them hold; before and after are the
    bytes on both sides that some of them hold besides."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        raw, offsets = text_bytes(batch.column("text"))
        flat, many = batch.column("runs").flatten(), np.diff(np.asarray(batch.column("runs").offsets))
        digit, first, last, anchor = (flat.field(k).to_numpy() for k in ("digit", "first", "last", "anchor"))
        near, far = anchor - last, anchor - first
        size = far // CELL - near // CELL + 1
        of = np.repeat(np.arange(len(size)), size)
        cell = near[of] // CELL + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        low, high = np.maximum(near[of] - cell * CELL, 0), np.minimum(far[of] - cell * CELL, CELL - 1)
        row = np.repeat(np.arange(len(many)), many)[of]
        begin = anchor[of] - cell * CELL + offsets[row]
        end = begin - (CELL - 1) + threshold
        core = digests(raw, begin, end)
        whole = raw.tobytes()
        before = [whole[b - h : b] for b, h in zip(begin.tolist(), high.tolist())]
        after = [whole[e : e + CELL - 1 - k] for e, k in zip(end.tolist(), low.tolist())]
        take = pa.array(row)
        yield {
            "own_id": batch.column("own_id").take(take), "own_text": batch.column("own_text").take(take), "digit": digit[of], "cell": cell.astype(np.int32), "core": core,
            "low": low.astype(np.int32), "high": high.astype(np.int32), "anchor": anchor[of], "before": pa.array(before, pa.binary()), "after": pa.array(after, pa.binary()),
        }

    by_text = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("digit", "first", "last", "anchor")).alias("runs"))  # of one text
    return mapped(docs.join(by_text, list(KEY)).select(*KEY, "text", "runs"), run, CELLS)


def again(rows: DataFrame, *digits: str) -> DataFrame:
    """Values of the digits that occur more than once; counted in every task before the shuffle. They
    are written, since Spark can split the hot side of a join only next to a plain exchange."""
    counted = rows.groupBy(*digits).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*digits)
    return written(counted, "suffix-again")


def repeated_spans(docs: DataFrame, threshold: int, digit: int) -> DataFrame:
    """own_id, own_text, spans: the covered intervals of each text that has any, not yet merged."""
    found = written(all_runs(docs, threshold, digit), "suffix-runs")
    twice = again(found, "digit")
    left = written(found.join(twice, "digit", "left_semi"), "suffix-first-digit")
    discard(found, twice)

    one = left.groupBy("digit", "stretch").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in (*KEY, "first", "last", "anchor")])
    stretches = written(one, "suffix-second-digit")
    whole = left.join(stretches.where("n > 1").select("digit", "stretch"), ["digit", "stretch"], "left_semi")
    settled = whole.select(*KEY, F.col("first").alias("a"), (F.col("last") + threshold).alias("b"))

    several = stretches.join(again(stretches, "digit"), "digit", "left_semi")
    group = ["digit", "cell", "core"]
    every = written(cells(docs, several, threshold), "suffix-cells")
    twice = again(every, *group)
    parts = written(every.join(twice, group, "left_semi"), "suffix-third-digit")
    discard(every, twice)
    sides = [*group, "low", "high", "before", "after"]
    one = parts.groupBy(*sides).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in (*KEY, "anchor")])
    kinds = written(one, "suffix-fourth-digit")
    equal = parts.join(kinds.where("n > 1").select(*sides), sides, "left_semi")
    start = F.col("anchor") - F.col("cell") * CELL
    cell_spans = equal.select(*KEY, (start - F.col("high")).alias("a"), (start - F.col("low") + threshold).alias("b"))

    open_ = kinds.join(again(kinds, *group), group, "left_semi").withColumn("d", F.explode(F.sequence("low", "high")))
    ahead = F.substring("before", F.col("high") - F.col("d") + 1, F.col("d"))
    side = F.concat(F.when(F.col("d") > 0, ahead).otherwise(F.lit(b"")), F.substring("after", F.lit(1), F.lit(CELL - 1) - F.col("d")))
    windows = open_.withColumn("side", side)
    last = [*group, "d", "side"]
    window_spans = windows.join(again(windows, *last), last, "left_semi").select(*KEY, (start - F.col("d")).alias("a"), (start - F.col("d") + threshold).alias("b"))
    return settled.unionByName(cell_spans).unionByName(window_spans).groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("spans"))


REMOVED = "doc_id long, kept_text binary, spans array<struct<a:bigint,b:bigint>>, n_bytes long"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the bytes that are left, the maximal removed spans and the size of every document."""
    own = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("own_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own_text"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    spans = repeated_spans(own, threshold, digit)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        kept, removed, sizes = [], [], []
        found = batch.column("spans")
        for i, raw in enumerate(row_bytes(batch.column("text"))):
            sizes.append(len(raw))
            if not found[i].is_valid:
                kept.append(raw)
                removed.append([])
                continue
            flat = found[i].values
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, flat.field("a").to_numpy(), 1)
            np.add.at(cover, flat.field("b").to_numpy(), -1)
            gone = np.cumsum(cover)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            removed.append([{"a": a, "b": b} for a, b in edges.reshape(-1, 2).tolist()])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield {"doc_id": batch.column("doc_id"), "kept_text": pa.array(kept, pa.binary()), "spans": pa.array(removed, _SPANS), "n_bytes": sizes}

    return mapped(own.join(spans, list(KEY), "left").select("doc_id", "text", "spans"), run, REMOVED)


def op3_repeated_strings(spark, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_text")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )
