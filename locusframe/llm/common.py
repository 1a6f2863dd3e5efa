"""Helpers that the text operators share: tables, scratch tables, Arrow batches, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WHITESPACE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")
ARROW_BYTES = 16 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def lean(spark: SparkSession) -> None:
    """Arrow batches of 16 MB at most: rows hold whole texts, and a worker holds a few batches at once."""
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not most.isdigit() or int(most) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a folder of our own in local
    mode, as in tests; on a cluster an error, since executors do not share a machine's own folders."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder; what is written there is deleted when the driver ends, if not before."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def narrow(df: DataFrame) -> DataFrame:
    """df of narrow rows, to be written: two tasks a core at most, each of which takes its partitions one after
    the other, so that small tables do not become a file for every partition of a shuffle."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table_] = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table_ in tables:
        place = table_.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table_))
        place.getFileSystem(table_.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def numbered_columns(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1 and so on, names that no operator uses, and the new name of
    each: with these, an operator's own columns never clash with those of its input."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def text_batches(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts together hold about limit bytes, one row at least."""
    column_array = batch.column(column)
    if len(column_array) == 0:
        return
    offsets = text_bytes(column_array)[1]
    start = 0
    while start < len(column_array):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column_array))
        yield start, stop
        start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its rows; null counts as empty."""
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offset_buffer, data = array.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.empty(0, np.uint8)
    return raw, offsets - first


def row_bytes(array: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; null counts as empty."""
    raw, offsets = text_bytes(array)
    whole, ends = raw.tobytes(), offsets.tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def mapped(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, column: str = "text", limit: int = 1 << 20) -> DataFrame:
    """Apply function to runs of rows of about limit bytes of text; it yields dicts of columns."""
    from pyspark.sql.types import _parse_datatype_string

    lean(df.sparkSession)
    names = _parse_datatype_string(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_batches(batch, column, limit):
                for made in function(batch.slice(start, stop - start)):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**i and its inverse modulo 2**64, for i below n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        for key, base in (("up", MULTIPLIER), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BYTE_VALUES = mixed(_LOWER + np.uint64(1))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITESPACE)] = True


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64: the hash of [i, j) is (P[j] - P[i]) * MULTIPLIER**-i."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than ASCII white space, A-Z lower-cased)
    of each row, in order, and the row offsets into them. Words never cross rows."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_hashes(_BYTE_VALUES[raw])
    hashes = mixed((sums[stops] - sums[starts]) * powers(n + 1)[1][starts])
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)
