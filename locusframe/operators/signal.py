"""Window operators on traces: peaks, runs, the size standard and the pixel grid.

A trace has one row per (hid, dye, px) with rfu; every window is on (hid, dye), so tables that are
partitioned by hid need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BP_RANGE, PIXELS, STANDARD_BPS
from ..sources.scratch import written

KEYS = ["hid", "dye"]
NEAR = 3
PEAK_BLOCK = 64


def along(order: str = "px") -> Window:
    return Window.partitionBy(*KEYS).orderBy(order)


def backwards(order: str = "px") -> Window:
    return Window.partitionBy(*KEYS).orderBy(F.desc(order))


def local_maxima(pixels: DataFrame, order: str = "px", value: str = "rfu", keys: list[str] | None = None) -> DataFrame:
    """Rows higher than one neighbour and not lower than the other; outside counts as 0."""
    return pixels.withColumn("_is", peak_flag(pixels, order, value, keys)).where("_is").drop("_is")


def peak_flag(pixels: DataFrame, order: str = "px", value: str = "rfu", keys: list[str] | None = None) -> Column:
    w = Window.partitionBy(*(keys or KEYS)).orderBy(order)
    v = F.col(value)
    zero = F.lit(0).cast(pixels.schema[value].dataType)
    left, right = F.coalesce(F.lag(v).over(w), zero), F.coalesce(F.lead(v).over(w), zero)
    return ((v >= left) & (v > right)) | ((v > left) & (v >= right))


def peaks_above(pixels: DataFrame, threshold: float, order: str = "px") -> DataFrame:
    return local_maxima(pixels, order).where(F.col("rfu") >= threshold)


def plateau_peaks(pixels: DataFrame, height: Column | float) -> DataFrame:
    """hid, dye, px, rfu of strict maxima; a flat top counts once, at its middle; edges never do."""
    w = along()
    new = F.when(F.lag("rfu").over(w).eqNullSafe(F.col("rfu")), 0).otherwise(1)
    numbered = pixels.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    runs = numbered.groupBy(*KEYS, "_run").agg(F.min("px").alias("_l"), F.max("px").alias("_r"), F.first("rfu").alias("rfu"))
    by_run = Window.partitionBy(*KEYS).orderBy("_run")
    sides = runs.withColumn("_before", F.lag("rfu").over(by_run)).withColumn("_after", F.lead("rfu").over(by_run))
    high = height if isinstance(height, Column) else F.lit(height)
    kept = sides.where((F.col("rfu") > F.col("_before")) & (F.col("rfu") > F.col("_after")) & (F.col("rfu") >= high))
    return kept.select(*KEYS, F.floor((F.col("_l") + F.col("_r")) / 2).alias("px"), "rfu")


def dye_max(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*KEYS).agg(F.max("rfu").alias("dye_max"))


def rescale_to_dye_max(pixels: DataFrame, score: str = "prob") -> DataFrame:
    """Scores scaled so that the largest one of a dye reaches the dye's maximum."""
    w = Window.partitionBy(*KEYS)
    top, most = F.max("rfu").over(w), F.greatest(F.max(score).over(w), F.lit(1.0))
    return pixels.withColumn("scaled", F.when(top != 0, F.col(score) * top / most).otherwise(F.col(score)))


def runs_of_ones(pixels: DataFrame, on: Column) -> DataFrame:
    """hid, dye, run (1, 2, ... along the dye), start, end of consecutive pixels where on holds."""
    grouped = pixels.where(on).withColumn("_g", F.col("px") - F.row_number().over(along()))
    runs = grouped.groupBy(*KEYS, "_g").agg(F.min("px").alias("start"), F.max("px").alias("end"))
    return runs.select(*KEYS, F.row_number().over(Window.partitionBy(*KEYS).orderBy("start")).alias("run"), "start", "end")


def peak_boundary(pixels: DataFrame, threshold: float) -> DataFrame:
    """For every pixel taken as a peak: left and right end of the stretch at or above threshold around it."""
    below = F.when(F.col("rfu") < threshold, F.col("px"))
    left = F.last(below, ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, -1))
    right = F.last(below, ignorenulls=True).over(backwards().rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*KEYS)
    return pixels.select("*", F.coalesce(left + 1, F.min("px").over(whole)).alias("left"), F.coalesce(right - 1, F.max("px").over(whole)).alias("right"))


def nearest_peak(pixels: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (hid, dye, px, more): with peak, the nearest maximum that is at least as high as the pixel
    itself, the first on ties.

    Queries are merged into the trace as rows, so one sorted pass gives each of them its pixel, the NEAR
    maxima up to it and the NEAR after it. Uphill from a pixel lies a maximum that will do, so almost always
    these settle the matter. A query is open where a side's maxima are all too low and a further one could
    still be nearer than what the other side has; ``far_peaks`` settles those, block by block."""
    names = queries.columns
    own = F.struct(F.col("px").alias("peak"), F.col("rfu").alias("high"))
    rows = pixels.select(*KEYS, "px", "rfu", F.lit(0).alias("_kind"), own.alias("_pixel"), F.lit(None).cast(queries.select(F.struct(*names)).schema[0].dataType).alias("_q"))
    asked = queries.select(*KEYS, "px", F.lit(None).cast(pixels.schema["rfu"].dataType).alias("rfu"), F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema["_pixel"].dataType).alias("_pixel"), F.struct(*names).alias("_q"))
    over = "OVER (PARTITION BY hid, dye ORDER BY px, _kind)"
    near = lambda f, what, k: F.expr(f"{f}({what}, {k}) IGNORE NULLS {over}")
    value, zero = F.col("rfu"), F.lit(0).cast(pixels.schema["rfu"].dataType)
    left, right = (F.coalesce(near(f, "rfu", 1), zero) for f in ("lag", "lead"))
    top = ((value >= left) & (value > right)) | ((value > left) & (value >= right))
    ends = Window.partitionBy(*KEYS)
    tops = rows.unionByName(asked).withColumn("_top", F.when(top, F.col("_pixel"))).withColumns({"_first": F.min("px").over(ends), "_last": F.max("px").over(ends)})
    found = tops.withColumns({"_own": near("lag", "_pixel", 1)} | {f"_{f}{k}": near(f, "_top", k) for f in ("lag", "lead") for k in range(1, NEAR + 1)}).where("_kind = 1 and _own.peak = px")
    high = lambda x: x["high"] >= F.col("_own.high")
    sides = {f: F.coalesce(*[F.when(high(F.col(f"_{f}{k}")), F.col(f"_{f}{k}")) for k in range(1, NEAR + 1)]) for f in ("lag", "lead")}
    sided = found.withColumns({f"_{f}": c for f, c in sides.items()}).withColumn("_d", F.least(F.col("px") - F.col("_lag.peak"), F.col("_lead.peak") - F.col("px")))
    further = {f: F.col(f"_{f}").isNull() & F.col(f"_{f}{NEAR}").isNotNull() for f in ("lag", "lead")}
    reach = F.coalesce("_d", F.greatest(F.col("px") - F.col("_first"), F.col("_last") - F.col("px")))
    open_ = (further["lag"] & (F.col("px") - F.col(f"_lag{NEAR}.peak") < reach)) | (further["lead"] & (F.col(f"_lead{NEAR}.peak") - F.col("px") + 1 < reach))
    best = F.when((F.col("px") - F.col("_lag.peak") == F.col("_d")), F.col("_lag")).otherwise(F.col("_lead"))
    settled = written(sided.select(*KEYS, "px", "_q", "_own.high", open_.alias("_open"), reach.cast("bigint").alias("_reach"), best.alias("_b")), "nearest-peaks")
    done = settled.where("not _open").select("_q", "_b")
    if not (rest := settled.where("_open")).isEmpty():
        done = done.unionByName(rest.drop("_b").join(far_peaks(pixels, rest.select(*KEYS, "px", "high", "_reach").distinct()), [*KEYS, "px"]).select("_q", "_b"))
    return done.where("_b is not null").select("_q.*", F.col("_b.peak").alias("peak"), F.col("_b.high").alias("peak_rfu"))


def far_peaks(pixels: DataFrame, queries: DataFrame) -> DataFrame:
    """hid, dye, px, _b: the nearest maximum of at least ``high`` within ``_reach`` pixels of each query, by
    the highest maxima of blocks of PEAK_BLOCK pixels; a block's own maxima (at most as many) are looked at in
    those blocks alone that have a high enough one."""
    block = lambda c: F.floor(c / PEAK_BLOCK)
    tops = local_maxima(pixels).select(*KEYS, block(F.col("px")).alias("_block"), F.struct(F.col("px").alias("peak"), F.col("rfu").alias("high")).alias("_t"))
    blocks = tops.groupBy(*KEYS, "_block").agg(F.max("_t.high").alias("_most"), F.collect_list("_t").alias("_tops"))
    places = F.sequence(block(F.col("px") - F.col("_reach")), block(F.col("px") + F.col("_reach")))
    met = queries.withColumn("_block", F.explode(places)).join(blocks, [*KEYS, "_block"]).where("_most >= high")
    good = F.filter("_tops", lambda t: t["high"] >= F.col("high"))
    nearest = F.array_min(F.transform(good, lambda t: F.struct(F.abs(t["peak"] - F.col("px")).alias("d"), t.alias("t"))))
    return met.withColumn("_n", nearest).groupBy(*KEYS, "px").agg(F.min("_n").alias("_n")).select(*KEYS, "px", F.col("_n.t").alias("_b"))


def peak_in_or_near_run(pixels: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """runs (hid, dye, run, start, end) with peak: for a strictly rising run (or one pixel) the peak
    nearest its last pixel, for a strictly falling one the peak nearest its first, else the highest
    peak inside. Runs whose peak is below threshold are left out."""
    inside = runs.withColumn("px", F.explode(F.sequence("start", "end"))).join(pixels.select(*KEYS, "px", "rfu"), [*KEYS, "px"])
    w = Window.partitionBy(*KEYS, "run").orderBy("px")
    before = F.lag("rfu").over(w)
    shapes = inside.withColumn("_up", F.coalesce(F.col("rfu") > before, F.lit(True))).withColumn("_down", F.coalesce(F.col("rfu") < before, F.lit(True)))
    shape = shapes.groupBy(*KEYS, "run", "start", "end").agg(F.bool_and("_up").alias("_rising"), F.bool_and("_down").alias("_falling"))
    sloped = shape.where("_rising or _falling").select(*KEYS, "run", "start", "end", F.when(F.col("_rising"), F.col("end")).otherwise(F.col("start")).alias("px"))
    near = nearest_peak(pixels, sloped).select(*KEYS, "run", "start", "end", "peak", "peak_rfu")
    flat = shape.where("not (_rising or _falling)").select(*KEYS, "run")
    tops = local_maxima(inside, keys=[*KEYS, "run"]).join(flat, [*KEYS, "run"], "left_semi")
    best = F.min(F.struct((-F.col("rfu")).alias("h"), F.col("px").alias("peak")))
    high = tops.groupBy(*KEYS, "run", "start", "end").agg(best.alias("_b")).select(*KEYS, "run", "start", "end", F.col("_b.peak").alias("peak"), (-F.col("_b.h")).alias("peak_rfu"))
    return near.unionByName(high).where(F.col("peak_rfu") >= threshold)


def size_standard_peaks(standard: DataFrame, high: int = 180, low: int = 120, late: int = 8200, apart: int = 15) -> DataFrame:
    """hid, scan of the size standard's peaks: those from ``high`` on; where the last one is not after
    scan ``late``, also those from ``low`` on from there. A peak close before another one is dropped."""
    keys = ["hid"]
    first = local_maxima(standard, "scan", keys=keys).where(F.col("rfu") >= high).select("hid", "scan")
    last = first.groupBy("hid").agg(F.max("scan").alias("_last"))
    weak = local_maxima(standard.where(F.col("scan") >= late), "scan", keys=keys).where(F.col("rfu") >= low)
    more = weak.join(last.where(F.col("_last") <= late), "hid", "left_semi").select("hid", "scan")
    w = Window.partitionBy("hid").orderBy("scan")
    found = first.unionByName(more).distinct().withColumn("_next", F.lead("scan").over(w))
    return found.where(F.col("_next").isNull() | (F.col("_next") - F.col("scan") > apart)).select("hid", "scan")


def select_standard_peaks(peaks: DataFrame, bps: list[int] | None = None) -> DataFrame:
    """hid, k, scan, bp of the last peaks but one, as many as the standard has; profiles with fewer are left out."""
    bps = bps or STANDARD_BPS
    n = len(bps)
    back = F.row_number().over(Window.partitionBy("hid").orderBy(F.desc("scan")))
    chosen = peaks.withColumn("_back", back).where(F.col("_back").between(2, n + 1))
    full = chosen.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("hid"))).where(F.col("_n") == n)
    k = (F.lit(n + 1) - F.col("_back")).cast("int")
    return full.select("hid", k.alias("k"), "scan", F.element_at(F.array(*map(F.lit, bps)), k + 1).cast("double").alias("bp"))


def validate_size_standard(knots: DataFrame, n: int | None = None) -> DataFrame:
    """hid, valid: the standard is complete and every step takes 7 to 13 scans per base pair."""
    w = Window.partitionBy("hid").orderBy("scan")
    step = (F.col("scan") - F.lag("scan").over(w)) / (F.col("bp") - F.lag("bp").over(w))
    ok = F.coalesce(step.between(7, 13), F.lit(True))
    return knots.withColumn("_ok", ok).groupBy("hid").agg((F.bool_and("_ok") & (F.count(F.lit(1)) == (n or len(STANDARD_BPS)))).alias("valid"))


def knot_arrays(knots: DataFrame, x: str = "scan", y: str = "bp") -> DataFrame:
    """hid and its knots as an array sorted by x (19 entries for a size standard)."""
    pairs = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return knots.groupBy("hid").agg(F.array_sort(F.collect_list(pairs)).alias("knots"))


def piecewise(x: Column, knots: Column, extrapolate: bool = False) -> Column:
    """Linear between knots; outside 0, or along the first or last segment."""
    n = F.size(knots)
    k = F.least(F.greatest(F.size(F.filter(knots, lambda p: p["x"] <= x)), F.lit(1)), n - 1)
    a, b = F.element_at(knots, k), F.element_at(knots, k + 1)
    y = a["y"] + (x - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])
    if extrapolate:
        return y
    return F.when((x < F.element_at(knots, F.lit(1))["x"]) | (x > F.element_at(knots, F.lit(-1))["x"]), F.lit(0.0)).otherwise(y)


def interpolate_bp(points: DataFrame, knots: DataFrame, x: str = "scan", extrapolate: bool = False) -> DataFrame:
    """points (hid, x, more) with bp."""
    return points.join(knot_arrays(knots), "hid").withColumn("bp", piecewise(F.col(x).cast("double"), F.col("knots"), extrapolate)).drop("knots")


TASK_ROWS = 1 << 18


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """df over all shuffle partitions by keys: the 19 rows of a standard become thousands of pixels, which Spark
    does not foresee when it merges small partitions. Where df has a known number of rows, a partition holds about
    TASK_ROWS at most, so that the memory of a task does not grow with the input."""
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(many, -(-rows // TASK_ROWS)), *keys)


def segments(knots: DataFrame, pixels: int = PIXELS, bp_range: tuple[int, int] = BP_RANGE, profiles: int = 0) -> DataFrame:
    """hid, s0, s1, b0, b1, step, p0, p1 of each stretch between two knots: scans, base pairs, base pairs a scan and the
    pixels on it. Where the number of profiles is known they are dealt by their pixels: Spark merges the partitions
    of few knots, and all that is made of them later, as scalers in hash maps, would lie in a few tasks."""
    first, last = bp_range
    w = Window.partitionBy("hid").orderBy("scan")
    place = lambda bp: F.ceil((F.col(bp) - first) * (pixels - 1) / (last - first))
    sides = spread(knots, "hid", rows=profiles * pixels).select("hid", F.col("scan").cast("double").alias("s0"), F.lead(F.col("scan").cast("double")).over(w).alias("s1"), F.col("bp").alias("b0"), F.lead("bp").over(w).alias("b1"))
    ends = sides.where("s1 is not null").withColumn("p0", place("b0")).withColumn("p1", F.when(F.col("b1") == last, pixels - 1).otherwise(place("b1") - 1))
    return ends.withColumn("step", (F.col("b1") - F.col("b0")) / (F.col("s1") - F.col("s0")))


def target_bp(px: Column, pixels: int = PIXELS, bp_range: tuple[int, int] = BP_RANGE) -> Column:
    """The evenly spaced base pair of a pixel."""
    first, last = bp_range
    return F.lit(float(first)) + px * F.lit(float(last - first)) / F.lit(float(pixels - 1))


def scan_below(t: Column, of: Callable[[str], Column] = F.col) -> Column:
    """Of a segment (its fields by ``of``): the last scan that is not after base pair t."""
    return F.least(F.floor(of("s0") + (t - of("b0")) / of("step") + 1e-9).cast("double"), of("s1"))


def nearest_scan(t: Column, lo: Column, of: Callable[[str], Column] = F.col) -> tuple[Column, Column]:
    """Of a segment: the scan nearest base pair t, lo (scan_below) on ties or the next one, and its base pair."""
    low = of("b0") + (lo - of("s0")) * of("step")
    up = (t - low > low + of("step") - t) & (lo < of("s1"))
    return lo + up.cast("int"), low + F.when(up, of("step")).otherwise(0.0)


def rescale_to_grid(knots: DataFrame, pixels: int = PIXELS, bp_range: tuple[int, int] = BP_RANGE, ranges: DataFrame | None = None, profiles: int = 0) -> DataFrame:
    """hid, px, scan, bp: for each of evenly spaced base pairs the scan with the nearest one, the lower
    on ties. Each segment between two knots makes its own pixels, so no range join is needed. With ranges (hid,
    low, high) at least the pixels of those scans, and few others. profiles: their number, where known (segments)."""
    own = segments(knots, pixels, bp_range, profiles)
    if ranges is not None:
        place = lambda scan: (F.col("b0") + (scan - F.col("s0")) * F.col("step") - bp_range[0]) * (pixels - 1) / (bp_range[1] - bp_range[0])
        low, high = F.floor(place(F.col("low") - 1)) - 1, F.ceil(place(F.col("high") + 1)) + 1
        own = own.join(ranges.hint("shuffle_hash"), "hid").withColumn("p0", F.greatest(F.col("p0"), low)).withColumn("p1", F.least(F.col("p1"), high))
    grid = own.where("p0 <= p1").select("hid", "s0", "s1", "b0", "b1", "step", F.explode(F.sequence("p0", "p1")).alias("px"))
    near = grid.withColumn("t", target_bp(F.col("px"), pixels, bp_range)).withColumn("lo", scan_below(F.col("t")))
    scan, bp = nearest_scan(F.col("t"), F.col("lo"))
    return near.select("hid", F.col("px").cast("int").alias("px"), scan.cast("int").alias("scan"), bp.alias("bp"))


def segment_arrays(knots: DataFrame, profiles: int = 0) -> DataFrame:
    """hid and _segments, its few stretches between knots that have pixels, in order."""
    fields = F.struct("p0", "p1", "s0", "s1", "b0", "b1", "step")
    return segments(knots, profiles=profiles).where("p0 <= p1").groupBy("hid").agg(F.sort_array(F.collect_list(fields)).alias("_segments"))


def grid_of(stretches: Column) -> Column:
    """The pixels of rescale_to_grid as an array of px, scan, bp, out of a profile's own row (segment_arrays)."""

    def stretch(s: Column) -> Column:
        below = lambda px: F.struct(px.cast("int").alias("px"), target_bp(px).alias("t"), scan_below(target_bp(px), lambda n: s[n]).alias("lo"))

        def placed(x: Column) -> Column:
            scan, bp = nearest_scan(x["t"], x["lo"], lambda n: s[n])
            return F.struct(x["px"].alias("px"), scan.cast("int").alias("scan"), bp.alias("bp"))

        return F.transform(F.transform(F.sequence(s["p0"], s["p1"]), below), placed)

    return F.flatten(F.transform(stretches, stretch))


def trace_rows(traces: DataFrame) -> DataFrame:
    """hid, dye, px, rfu of traces that lie in arrays (hid, dye, first, rfu); places without a value are no rows."""
    rows = traces.select("hid", "dye", "first", F.posexplode("rfu").alias("_i", "rfu")).where("rfu is not null")
    return rows.select("hid", "dye", (F.col("first") + F.col("_i")).alias("px"), "rfu")


def high_rows(traces: DataFrame, share: float = 0.6) -> DataFrame:
    """Of trace_rows those of at least ``share`` of the dye's maximum, that maximum, and the rows beside them: all that ladder_peaks looks at."""
    most = traces.select("hid", "dye", "first", F.filter("rfu", lambda x: x.isNotNull()).alias("_v"), F.transform("rfu", lambda x, i: F.struct((F.col("first") + i).alias("px"), x.alias("rfu"))).alias("_rows"))
    there = most.select("hid", "dye", "_v", F.filter("_rows", lambda x: x["rfu"].isNotNull()).alias("_rows")).withColumn("_high", F.least(share * F.array_max("_v"), F.array_max("_v").cast("double")))
    at = lambda i: F.when(i >= 0, F.get("_v", i))
    near = lambda x, i: F.greatest(x["rfu"], at(i - 1), at(i + 1)) >= F.col("_high")
    return there.select("hid", "dye", F.explode(F.filter("_rows", near)).alias("_x")).select("hid", "dye", "_x.px", "_x.rfu")


def pixel_arrays(grid: DataFrame, on: str, *columns: str) -> DataFrame:
    """on, first and _rows (px and columns, in order of px) of a grid: one row per profile, whose pixels lie side by side."""
    rows = grid.groupBy(on).agg(F.sort_array(F.collect_list(F.struct("px", *columns))).alias("_rows"))
    return rows.select(on, F.get("_rows", F.lit(0))["px"].alias("first"), "_rows")


def scaler_arrays(knots: DataFrame, profiles: int = 0) -> DataFrame:
    """hid, first, bps: the scaler of rescale_to_grid as one row per profile, its first pixel and all base pairs, made
    in that row out of its few segments. profiles: their number, where known (segments)."""
    grids = segment_arrays(knots, profiles).select("hid", grid_of(F.col("_segments")).alias("_grid"))
    return grids.select("hid", F.get("_grid", F.lit(0))["px"].alias("first"), F.col("_grid")["bp"].alias("bps"))


def scaler_rows(places: DataFrame) -> DataFrame:
    """hid, px, bp of scaler_arrays."""
    return places.select("hid", "first", F.posexplode("bps").alias("_i", "bp")).select("hid", (F.col("first") + F.col("_i")).alias("px"), "bp")


def pixel_places(knots: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """hid, at, starts, first, bps: for each scan from ``at`` on the first pixel of the grid whose scan is not
    before it, with one more at the end; and the base pairs of the pixels from ``first`` on. With ranges (hid, low,
    high) the pixels of those scans alone are made."""
    whole = pixel_arrays(rescale_to_grid(knots, ranges=ranges), "hid", "scan", "bp")
    # each pixel is the first one for its scan and those since the scan of the pixel before
    since = lambda x, i: F.when(i == 0, 1).otherwise(x["scan"] - F.get("_rows", i - 1)["scan"])
    starts = F.flatten(F.transform("_rows", lambda x, i: F.array_repeat(x["px"], since(x, i))))
    return whole.select("hid", F.get("_rows", F.lit(0))["scan"].alias("at"), F.array_append(starts, F.element_at("_rows", -1)["px"] + 1).alias("starts"), "first", F.col("_rows")["bp"].alias("bps"))


def resample_profile(raw: DataFrame, places: DataFrame, size_standard: bool = False) -> DataFrame:
    """hid, dye, px, rfu, bp: raw traces at the scans of the grid (places: pixel_places); dye 5 is the size
    standard. A profile's grid is one row, so it meets the trace by hid alone; it is never broadcast."""
    kept = raw if size_standard else raw.where("dye < 5")
    i = (F.col("scan") - F.col("at")).cast("int")
    met = kept.join(places.hint("shuffle_hash"), "hid").where(i >= 0).withColumns({"_from": F.get("starts", i), "_to": F.get("starts", i + 1)}).where("_from < _to")
    return met.withColumn("px", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))).select("hid", "dye", "px", "rfu", F.get("bps", F.col("px") - F.col("first")).alias("bp"))


def valid_knots(raw: DataFrame) -> DataFrame:
    """hid, k, scan, bp of the raw traces' size standards (dye 5) that are valid."""
    knots = select_standard_peaks(size_standard_peaks(raw.where("dye = 5")))
    return knots.join(validate_size_standard(knots).where("valid"), "hid", "left_semi")


def calibrated_profile(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels, scaler) of the raw traces (hid, dye, scan, rfu); profiles whose standard fails are left out.
    Pixels have their base pair, too."""
    valid = valid_knots(raw)
    return resample_profile(raw, pixel_places(valid)), rescale_to_grid(valid).select("hid", "px", "bp")


REACH = 3


def scaler_places(scaler: DataFrame, on: str = "hid") -> DataFrame:
    """One row per scaler: on, first, bps. scaler: on, px, bp, or already so (scaler_arrays)."""
    if "bps" in scaler.columns:
        return scaler.select(on, "first", "bps")
    rows = pixel_arrays(scaler.select(on, F.col("px").cast("int").alias("px"), F.col("bp").cast("double").alias("bp")), on, "bp")
    ends = rows.withColumn("_last", F.element_at("_rows", -1)["px"])
    # pixels that a scaler lacks are never nearest
    filled = F.transform(F.sequence("first", "_last"), lambda p: F.coalesce(F.array_min(F.transform(F.filter("_rows", lambda x: x["px"] == p), lambda x: x["bp"])), F.lit(float("inf"))))
    return ends.select(on, "first", F.when(F.size("_rows") == F.col("_last") - F.col("first") + 1, F.col("_rows")["bp"]).otherwise(filled).alias("bps"))


def with_pixels(points: DataFrame, places: DataFrame, on: str = "hid", pixels: int = PIXELS, bp_range: tuple[int, int] = BP_RANGE, **ends: Column) -> DataFrame:
    """points with the pixel (name) whose base pair is nearest each of ends, the first on ties. A validated
    standard keeps it within REACH of the evenly spaced place. Points meet the scaler's one row by ``on``; it is never
    broadcast, as Spark takes it for much smaller than it is."""
    first, last = bp_range
    places_of = {f"_at_{n}": F.least(F.greatest(F.round((bp - first) * (pixels - 1) / (last - first)), F.lit(0)), F.lit(pixels - 1)).cast("int") for n, bp in ends.items()}
    met = points.withColumns(places_of).join(places.hint("shuffle_hash"), on)
    # the few base pairs are taken out of the scaler's row first, one by one, so that it is not copied for every point
    near = F.struct(*[F.array(*[F.get("bps", F.col(f"_at_{n}") - F.col("first") + k) for k in range(-REACH, REACH + 1)]).alias(n) for n in ends])
    found = met.select(*points.columns, *places_of, F.explode(F.array(near)).alias("_near"))
    for name, bp in ends.items():
        pixel = lambda x, i: F.struct(F.abs(x - bp).alias("d"), (F.col(f"_at_{name}") - REACH + i).alias("px"))  # noqa: B023, E731
        found = found.withColumn(name, F.array_min(F.transform(F.col("_near")[name], lambda x, i: F.when(x.isNotNull(), pixel(x, i))))["px"])  # noqa: B023
    return found.dropna(subset=list(ends)).select(*points.columns, *ends)


def bp_to_pixel(points: DataFrame, scaler: DataFrame, bp: str = "bp", on: str = "hid") -> DataFrame:
    """points (hid, bp, more) with px, the pixel whose base pair is nearest; each row has its own result,
    repeated rows too. ``on`` names the scaler of a point where several profiles share one; scaler as scaler_places takes it."""
    return with_pixels(points, scaler_places(scaler, on), on, px=F.col(bp))


def ladder_peaks(pixels: DataFrame, expected: DataFrame, share: float = 0.6) -> DataFrame:
    """hid, dye, k, px of a ladder's peaks, those of at least ``share`` of the dye's maximum with one 0
    before the dye; only ladders with the expected number (dye, n) on every dye."""
    padded = pixels.unionByName(pixels.select(*KEYS).distinct().select(*KEYS, F.lit(-1).cast(pixels.schema["px"].dataType).alias("px"), F.lit(0).cast(pixels.schema["rfu"].dataType).alias("rfu")))
    tops = plateau_peaks(padded, 0).join(dye_max(pixels), KEYS).where(F.col("rfu") >= share * F.col("dye_max"))
    counts = tops.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("found"))
    wanted = pixels.select(*KEYS).distinct().join(expected, "dye")
    good = wanted.join(counts, KEYS, "left").groupBy("hid").agg(F.bool_and(F.coalesce(F.col("found") == F.col("n"), F.lit(False))).alias("ok")).where("ok")
    k = F.row_number().over(along()) - 1
    return tops.join(good, "hid", "left_semi").select(*KEYS, k.alias("k"), "px")
