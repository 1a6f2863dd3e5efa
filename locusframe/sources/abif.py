"""ABIF binaries as tables: directory entries, values and dye channels, without Python code per row; channels that
are looked at whole (tops, samples) are read by numpy inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN_TYPES = "(type <= 19 or type = 1024)"
# Data tags of the five dyes and the size standard in both layouts (fixed values).
LAYOUT_9 = {9: 0, 10: 1, 11: 2, 12: 3, 206: 4, 205: 5}
LAYOUT_1 = {1: 0, 2: 1, 3: 2, 4: 3, 106: 4, 205: 5, 105: 5}


def unsigned(content: Column, at: Column | int, size: int) -> Column:
    """Big-endian number of ``size`` bytes from byte ``at`` (counted from 0)."""
    start = (at if isinstance(at, Column) else F.lit(at)) + 1
    return F.conv(F.hex(F.substring(content, start.cast("int"), F.lit(size))), 16, 10).cast("bigint")


def signed(content: Column, at: Column | int, size: int) -> Column:
    value, half = unsigned(content, at, size), 1 << (8 * size - 1)
    return F.when(value >= half, value - F.lit(2 * half)).otherwise(value)


def text(content: Column, at: Column | int, size: Column | int) -> Column:
    start = (at if isinstance(at, Column) else F.lit(at)) + 1
    return F.try_validate_utf8(F.substring(content, start.cast("int"), (size if isinstance(size, Column) else F.lit(size)).cast("int")).cast("string"))


def entry_arrays(files: DataFrame, key: str = "hid") -> DataFrame:
    """key, abif and entries of each file: all of its directory as one array, null if it has none. The entries are
    cut out of the file, so no row holds it beside them."""
    c = F.col("content")
    is_abif = F.coalesce(text(c, 0, 4) == "ABIF", F.lit(False))
    head = files.select(key, "content", is_abif.alias("abif"), signed(c, 16, 2).alias("_size"), signed(c, 18, 4).alias("_n"), signed(c, 26, 4).alias("_at"))

    def entry(i: Column) -> Column:
        at = F.col("_at") + i * F.col("_size")
        size = signed(c, at + 16, 4)
        start = F.when(size <= 4, at + 20).otherwise(signed(c, at + 20, 4))
        return F.struct(
            i.cast("int").alias("i"), text(c, at, 4).alias("name"), signed(c, at + 4, 4).alias("tag"), signed(c, at + 8, 2).alias("type"), signed(c, at + 10, 2).alias("element_size"),
            signed(c, at + 12, 4).alias("n"), size.alias("data_size"), start.alias("start"), F.substring(c, (start + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int")).alias("data"),
        )

    some = F.col("abif") & (F.col("_n") > 0)
    return head.select(key, "abif", F.when(some, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), entry)).alias("entries"))


def decode_hid_elements(files: DataFrame, key: str = "hid", every: bool = False) -> DataFrame:
    """key, i, name, tag, type, element_size, n, data_size, start and data of each directory entry of
    known type. Data of up to four bytes lie in the entry itself. Files that are not ABIF have no
    entries. The entries are cut out of the file before they become rows, so no row holds the file.
    With ``every`` a column abif tells which files are, and a file without entries has one row of nulls."""
    listed = entry_arrays(files, key)
    if not every:
        # not the bare column: Spark would infer a filter on it and copy all that makes the entries into that
        return listed.select(key, F.explode(F.filter("entries", lambda e: F.lit(True))).alias("_e")).select(key, "_e.*").where(KNOWN_TYPES)
    return listed.select(key, "abif", F.explode_outer("entries").alias("_e")).select(key, "abif", "_e.*").where(f"i is null or i = 0 or {KNOWN_TYPES}")


def numbers(data: Column, n: Column, size: int, is_signed: bool) -> Column:
    """The first n big-endian numbers of ``size`` bytes in data, or those that it holds whole: the data as one
    hex string, cut at fixed width, with signs by arithmetic."""
    cells = F.slice(F.regexp_extract_all(F.hex(data), F.lit(f"([0-9A-F]{{{2 * size}}})"), F.lit(1)), F.lit(1), F.greatest(n, F.lit(0)).cast("int"))
    read = lambda cell: F.conv(cell, 16, 10).cast("bigint")
    half = 1 << (8 * size - 1)
    return F.transform(cells, (lambda cell: (read(cell) + half) % (2 * half) - half) if is_signed else read)


def number_array(kind: Column, n: Column, data: Column) -> Column:
    """The numbers of an entry; null where its type has none."""
    return F.when(kind.isin(1, 5) & (n > 1), numbers(data, n, 4, True)).when(kind == 3, numbers(data, n, 2, False)).when(kind == 4, numbers(data, n, 2, True))


def decode_hid_values(elements: DataFrame) -> DataFrame:
    """elements with v_long, v_array, v_string, v_binary; the column of the element's type is set."""
    d, kind = F.col("data"), F.col("type")
    size = F.octet_length(d)
    whole = F.when(size == 1, signed(d, 0, 1)).when(size == 2, signed(d, 0, 2)).when(size == 4, signed(d, 0, 4))
    return elements.select(
        "*",
        F.when(kind.isin(1, 5) & (F.col("n") == 1), whole).alias("v_long"),
        number_array(kind, F.col("n"), d).alias("v_array"),
        F.when(kind.isin(2, 19), F.try_validate_utf8(d.cast("string"))).when(kind == 13, F.when(F.hex(d).rlike("[1-9A-F]"), "true").otherwise("false")).alias("v_string"),
        F.when(kind == 1024, d).alias("v_binary"),
    )


def dye_of(tag: Column, nine: Column) -> Column:
    """The dye of a data tag in the layout with DATA_9 or in the other one; null if it has none."""
    table = lambda layout: F.create_map(*[F.lit(x) for pair in layout.items() for x in pair])
    return F.when(nine, F.try_element_at(table(LAYOUT_9), tag)).otherwise(F.try_element_at(table(LAYOUT_1), tag))


def select_dye_channels(values: DataFrame, key: str = "hid") -> DataFrame:
    """key, dye, scan, rfu: tags 9-12, 206 and 205 where DATA_9 exists, else 1-4, 106 and 205 or 105.
    Files without all six channels are left out."""
    data = values.where((F.col("name") == "DATA") & F.col("v_array").isNotNull()).select(key, "tag", "v_array")
    has = data.groupBy(key).agg(F.bool_or(F.col("tag") == 9).alias("_nine"), F.bool_or(F.col("tag") == 205).alias("_standard"))
    tag = F.col("tag").cast("int")
    dye = dye_of(tag, F.col("_nine"))
    chosen = data.join(has, key).withColumn("dye", dye).where(F.col("dye").isNotNull() & ~((tag == 105) & F.col("_standard")))
    whole = chosen.groupBy(key).agg(F.countDistinct("dye").alias("_n")).where("_n = 6").select(key)
    return chosen.join(whole, key, "left_semi").select(key, "dye", F.posexplode("v_array").alias("scan", "rfu"))


def file_channels(files: DataFrame, key: str = "hid") -> DataFrame:
    """key, abif and channels of each file: dye, type, n, data of the entries that select_dye_channels takes, null
    where not all six are there. A file stays one row and no value is decoded, so who needs one channel reads
    that one (channel_numbers)."""
    kind = lambda e: e["type"].isin(3, 4) | (e["type"].isin(1, 5) & (e["n"] > 1))
    data = F.filter("entries", lambda e: (e["name"] == "DATA") & kind(e) & e["n"].isNotNull() & e["data"].isNotNull())
    has = lambda tag: F.exists("_data", lambda e: e["tag"] == tag)
    found = entry_arrays(files, key).select(key, "abif", data.alias("_data")).select("*", has(9).alias("_nine"), has(205).alias("_standard"))
    dyed = F.transform("_data", lambda e: F.struct(dye_of(e["tag"].cast("int"), F.col("_nine")).alias("dye"), e["tag"].alias("tag"), e["type"].alias("type"), e["n"].alias("n"), e["data"].alias("data")))
    chosen = F.filter("_dyed", lambda e: e["dye"].isNotNull() & ~((e["tag"] == 105) & F.col("_standard")))
    kept = found.select(key, "abif", "_standard", dyed.alias("_dyed")).select(key, "abif", chosen.alias("_chosen"))
    return kept.select(key, "abif", F.when(F.size(F.array_distinct(F.col("_chosen")["dye"])) == 6, F.col("_chosen")).alias("channels"))


def any_number(channels: Column) -> Column:
    """Whether one of the channels holds a whole number."""
    width = lambda e: F.when(e["type"].isin(1, 5), 4).otherwise(2)
    return F.coalesce(F.exists(channels, lambda e: (e["n"] > 0) & (F.octet_length(e["data"]) >= width(e))), F.lit(False))


def channel_numbers(entry: dict) -> np.ndarray:
    """The numbers of one channel (type, n, data), as number_array has them."""
    kind = np.dtype({3: ">u2", 4: ">i2"}.get(entry["type"], ">i4"))
    data = entry["data"]
    return np.frombuffer(data, kind, min(len(data) // kind.itemsize, max(entry["n"], 0))).astype(np.int64)


def lists(cells: list[np.ndarray], kind: pa.DataType, gaps: list[np.ndarray] | None = None) -> pa.ListArray:
    """One list a row; null where gaps is set."""
    ends = np.cumsum([0, *map(len, cells)])
    flat = pa.array(np.concatenate([np.empty(0, np.int64), *cells]), kind, mask=None if gaps is None else np.concatenate([np.empty(0, bool), *gaps]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def channel_tops(channels: DataFrame, low: int) -> DataFrame:
    """channels (columns, every, channel) as columns, scan, rfu: the values that reach ``low`` and those beside them, or
    all with ``every``, in order; none where there is no channel."""
    kept = [c for c in channels.columns if c not in ("every", "channel")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scans, values = [], []
            for every, channel in zip(batch.column("every").to_pylist(), batch.column("channel").to_pylist()):
                v = np.empty(0, np.int64) if channel is None else channel_numbers(channel)
                high = (v >= low) | bool(every)
                near = high.copy()
                near[1:] |= high[:-1]
                near[:-1] |= high[1:]
                scans.append(np.flatnonzero(near))
                values.append(v[near])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists(scans, pa.int32()), lists(values, pa.int64())], names=[*kept, "scan", "rfu"])

    types = ", ".join(f"{c} {channels.schema[c].dataType.simpleString()}" for c in kept)
    return channels.mapInArrow(run, f"{types}, scan array<int>, rfu array<long>")


def channel_samples(channels: DataFrame) -> DataFrame:
    """channels (columns, scans, channel) as columns, rfu: the channel's values at the scans, null beyond its end."""
    kept = [c for c in channels.columns if c not in ("scans", "channel")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, gaps = [], []
            wanted = batch.column("scans")
            for i, channel in enumerate(batch.column("channel").to_pylist()):
                v, at = channel_numbers(channel), wanted[i].values.to_numpy()
                gaps.append((at < 0) | (at >= len(v)))
                values.append(np.append(v, 0)[np.where(gaps[-1], len(v), at)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists(values, pa.int64(), gaps)], names=[*kept, "rfu"])

    types = ", ".join(f"{c} {channels.schema[c].dataType.simpleString()}" for c in kept)
    return channels.mapInArrow(run, f"{types}, rfu array<long>")
