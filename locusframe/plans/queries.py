"""The registered queries: name -> (Spark query, SQL of the same result or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as fn
from ..functions.constants import DYE_ROWS, LOCUS_THRESHOLDS
from ..operators import annotate, dataset, ladders, loading, metrics, panel, signal, splits
from ..sources import abif, files
from . import views as v
from .views import CALLS, DENSE, FILES, KIT, KNOTS, NAMES, PANEL, STRATA, TRACE, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


def big(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# Names and scalar functions


@query("name_functions", sql("""SELECT key, rd AS is_rd_sample, CASE WHEN rd THEN split_part(name, '_', 1) END AS prefix, CASE WHEN rd THEN substr(name, 3, 1) || 'p' END AS noc,
  regexp_matches(lower(name), 'blanco|ladder|pocon|controle') OR starts_with(name, 'A') AS is_control,
  contains(lower(name), 'ladder') AND NOT regexp_matches(lower(name), 'ppy23|minifiler|hdplex') AS is_ladder
FROM (SELECT key, name, regexp_matches(substr(name, 1, 3), '^[0-9][A-F][0-9]$') AS rd FROM names)""", NAMES))
def name_functions(spark, d):
    n = F.col("name")
    return v.names(spark, d).select("key", fn.is_rd_sample(n).alias("is_rd_sample"), fn.sample_prefix(n).alias("prefix"), fn.sample_noc(n).alias("noc"), fn.is_control_sample(n).alias("is_control"), fn.is_candidate_ladder(n).alias("is_ladder"))


for _key, _column in (("is_rd_sample", "is_rd_sample"), ("sample_prefix", "prefix"), ("sample_noc", "noc"), ("is_control_sample", "is_control"), ("is_candidate_ladder", "is_ladder")):
    query(_key, f"SELECT key, {_column} FROM ({ORACLES['name_functions']})")(lambda spark, d, c=_column: name_functions(spark, d).select("key", c))


CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, 3988292384::BIGINT * (c & 1))))"""


@query("path_hash", sql(f"SELECT key, xor({CRC}, 4294967295::BIGINT) AS hash FROM names", NAMES))
def path_hash(spark, d):
    return v.names(spark, d).select("key", fn.path_hash(F.concat(F.lit("a/b c/"), "name")).alias("hash"))


@query("strip_ob", "SELECT o_orderkey, trim(a, 'OB_') AS stripped, marker_key FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'OL' WHEN 1 THEN 'OB_' || o_custkey WHEN 2 THEN o_custkey || '.3_BO' ELSE 'X' END AS a, o_orderpriority || '_' || o_custkey AS marker_key FROM orders)")
def strip_ob(spark, d):
    o = v.table(spark, d, "orders")
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    a = F.when(k == 0, "OL").when(k == 1, F.concat(F.lit("OB_"), c)).when(k == 2, F.concat(c, F.lit(".3_BO"))).otherwise("X")
    return o.select("o_orderkey", fn.strip_ob(a).alias("stripped"), fn.locus_allele_key(F.col("o_orderpriority"), c).alias("marker_key"))


@query("scan_to_base", sql("SELECT hid, dye, px, 65e0 + px * 410e0 / 4096e0 AS base FROM trace", TRACE))
def scan_to_base(spark, d):
    return v.trace(spark, d).select("hid", "dye", "px", fn.scan_to_base(F.col("px")).alias("base"))


@query("sigmoid", sql("SELECT hid, dye, px, round(1e0 / (1e0 + exp(-(rfu / 100e0))), 6) AS p FROM dense", DENSE))
def sigmoid(spark, d):
    return v.dense(spark, d).select("hid", "dye", "px", F.round(fn.sigmoid(F.col("rfu") / 100.0), 6).alias("p"))


@query("threshold_mask", sql("SELECT hid, dye, px, (prob >= 0.5e0)::INT AS calling, (prob > 0.5e0)::INT AS iou FROM dense", DENSE))
def threshold_mask(spark, d):
    p = F.col("prob")
    return v.dense(spark, d).select("hid", "dye", "px", fn.threshold_mask(p).alias("calling"), fn.threshold_mask(p, inclusive=False).alias("iou"))


@query("prediction_label", """SELECT user_id, label, confidence FROM (SELECT user_id, event_type AS label, value AS confidence,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS r FROM (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY 1, 2)) WHERE r = 1""")
def prediction_label(spark, d):
    scores = v.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    maps = scores.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "value")))).alias("m"))
    best = fn.prediction_label(F.col("m"))
    return maps.select("user_id", best["key"].alias("label"), best["value"].alias("confidence"))


@query("annotation_label", "SELECT o_orderkey, o_orderstatus AS label FROM orders")
def annotation_label(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", fn.annotation_label(F.array("o_orderstatus", "o_orderstatus")).alias("label"))


@query("donors_of_sample", sql("""SELECT key, array_to_string(list_transform(list_slice(letters, 1, noc), lambda x: nr || x), ',') AS donors FROM (
  SELECT key, substr(name, 1, 1) AS nr, substr(name, 3, 1)::INT AS noc, CASE substr(name, 1, 1) WHEN '1' THEN ['A','B','C','D','E'] WHEN '2' THEN ['F','G','H','I','J'] WHEN '3' THEN ['K','L','M','N','O']
    WHEN '4' THEN ['P','Q','R','S','T'] WHEN '5' THEN ['U','V','W','X','Y'] WHEN '6' THEN ['Z','AA','AB','AC','AD'] END AS letters FROM names WHERE regexp_matches(substr(name, 1, 3), '^[0-9][A-F][0-9]$'))
  WHERE letters IS NOT NULL""", NAMES))
def donors_of_sample(spark, d):
    donors = F.array_join(fn.donors_of_sample(F.col("name")), ",")
    return v.names(spark, d).select("key", donors.alias("donors")).where("donors is not null")


@query("drop_non_autosomal", """SELECT p_partkey, marker FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'AMEL' WHEN p_size % 10 = 1 THEN 'DYS391' WHEN p_size % 10 = 2 THEN 'FGA' ELSE p_brand END AS marker FROM part)
  WHERE marker NOT IN ('AMEL', 'DYS391', 'DYS576', 'DYS570')""")
def drop_non_autosomal(spark, d):
    k = F.col("p_size") % 10
    marker = F.when(k == 0, "AMEL").when(k == 1, "DYS391").when(k == 2, "FGA").otherwise(F.col("p_brand"))
    return annotate.drop_non_autosomal(v.table(spark, d, "part").select("p_partkey", marker.alias("marker")))


# Signal

PEAKS = """peaks AS (SELECT hid, dye, px, rfu FROM (SELECT *, lag(rfu, 1, 0::BIGINT) OVER w AS l, lead(rfu, 1, 0::BIGINT) OVER w AS r FROM trace WINDOW w AS (PARTITION BY hid, dye ORDER BY px))
  WHERE (rfu >= l AND rfu > r) OR (rfu > l AND rfu >= r))"""
PLATEAU = """pruns AS (SELECT hid, dye, g, min(px) AS l, max(px) AS r, any_value(rfu) AS rfu FROM (SELECT *, sum(n) OVER (PARTITION BY hid, dye ORDER BY px) AS g FROM
    (SELECT *, CASE WHEN lag(rfu) OVER (PARTITION BY hid, dye ORDER BY px) = rfu THEN 0 ELSE 1 END AS n FROM trace)) GROUP BY hid, dye, g),
  plateau AS (SELECT hid, dye, ((l + r) // 2)::BIGINT AS px, rfu FROM (SELECT *, lag(rfu) OVER w AS a, lead(rfu) OVER w AS b FROM pruns WINDOW w AS (PARTITION BY hid, dye ORDER BY g)) WHERE rfu > a AND rfu > b)"""
RUNS = """mruns AS (SELECT hid, dye, row_number() OVER (PARTITION BY hid, dye ORDER BY s) AS run, s AS "start", e AS "end" FROM (SELECT hid, dye, min(px) AS s, max(px) AS e FROM
    (SELECT hid, dye, px, px - row_number() OVER (PARTITION BY hid, dye ORDER BY px) AS g FROM trace WHERE rfu >= 40) GROUP BY hid, dye, g))"""
BOUNDS = """bounds AS (SELECT hid, dye, px, coalesce((SELECT max(b.px) + 1 FROM trace b WHERE b.hid = t.hid AND b.dye = t.dye AND b.px < t.px AND b.rfu < 40), 0)::BIGINT AS l,
    coalesce((SELECT min(b.px) - 1 FROM trace b WHERE b.hid = t.hid AND b.dye = t.dye AND b.px > t.px AND b.rfu < 40), (SELECT max(b.px) FROM trace b WHERE b.hid = t.hid AND b.dye = t.dye))::BIGINT AS r FROM trace t)"""
NEAR = """near AS (SELECT hid, dye, px, peak, peak_rfu FROM (SELECT t.hid, t.dye, t.px, p.px AS peak, p.rfu AS peak_rfu, row_number() OVER (PARTITION BY t.hid, t.dye, t.px ORDER BY abs(p.px - t.px), p.px) AS k
    FROM trace t JOIN peaks p ON p.hid = t.hid AND p.dye = t.dye AND p.rfu >= t.rfu) WHERE k = 1)"""
RUNPEAK = """members AS (SELECT m.hid, m.dye, m.run, m."start", m."end", t.px, t.rfu, lag(t.rfu) OVER w AS l, lead(t.rfu) OVER w AS n FROM mruns m JOIN trace t ON t.hid = m.hid AND t.dye = m.dye AND t.px BETWEEN m."start" AND m."end"
    WINDOW w AS (PARTITION BY m.hid, m.dye, m.run ORDER BY t.px)),
  shape AS (SELECT hid, dye, run, "start", "end", bool_and(l IS NULL OR rfu > l) AS up, bool_and(l IS NULL OR rfu < l) AS down FROM members GROUP BY ALL),
  runpeak AS (SELECT s.hid, s.dye, s.run, s."start", s."end", n.peak, n.peak_rfu FROM shape s JOIN near n ON n.hid = s.hid AND n.dye = s.dye AND n.px = CASE WHEN s.up THEN s."end" ELSE s."start" END WHERE (s.up OR s.down) AND n.peak_rfu >= 40
    UNION ALL SELECT hid, dye, run, "start", "end", px, rfu FROM (SELECT m.*, row_number() OVER (PARTITION BY m.hid, m.dye, m.run ORDER BY m.rfu DESC, m.px) AS k FROM members m JOIN shape s USING (hid, dye, run)
      WHERE NOT (s.up OR s.down) AND ((m.rfu >= coalesce(l, 0) AND m.rfu > coalesce(n, 0)) OR (m.rfu > coalesce(l, 0) AND m.rfu >= coalesce(n, 0)))) WHERE k = 1 AND rfu >= 40)"""
WINS = """covered AS (SELECT hid, dye, px, max(run) AS last FROM (SELECT hid, dye, run, unnest(range(l, r + 1)) AS px FROM covers) GROUP BY ALL),
  owned AS (SELECT hid, dye, run AS own, unnest(range("start", "end" + 1)) AS px FROM mruns)"""
WON = "SELECT c.hid, c.dye, c.px::BIGINT AS px FROM covered c LEFT JOIN owned o ON o.hid = c.hid AND o.dye = c.dye AND o.px = c.px WHERE own IS NULL OR last >= own"


@query("peaks_above", sql("SELECT hid, dye, px, rfu FROM peaks WHERE rfu >= 40", TRACE, PEAKS))
def peaks_above(spark, d):
    return signal.peaks_above(v.trace(spark, d), 40)


@query("plateau_peaks", sql("SELECT * FROM plateau WHERE rfu >= 30", TRACE, PLATEAU))
def plateau_peaks(spark, d):
    return signal.plateau_peaks(v.trace(spark, d), 30)


@query("dye_max", sql("SELECT hid, dye, max(rfu) AS dye_max FROM trace GROUP BY ALL", TRACE))
def dye_max(spark, d):
    return signal.dye_max(v.trace(spark, d))


@query("rescale_to_dye_max", sql("SELECT hid, dye, px, round(CASE WHEN m <> 0 THEN prob * m / greatest(p, 1e0) ELSE prob END, 6) AS scaled FROM (SELECT *, max(rfu) OVER w AS m, max(prob) OVER w AS p FROM dense WINDOW w AS (PARTITION BY hid, dye))", DENSE))
def rescale_to_dye_max(spark, d):
    return signal.rescale_to_dye_max(v.dense(spark, d)).select("hid", "dye", "px", F.round("scaled", 6).alias("scaled"))


@query("runs_of_ones", sql('SELECT hid, dye, run, "start", "end" FROM mruns', TRACE, RUNS))
def runs_of_ones(spark, d):
    return big(signal.runs_of_ones(v.trace(spark, d), F.col("rfu") >= 40), "run")


@query("peak_boundary", sql("SELECT hid, dye, px, l, r FROM bounds", TRACE, BOUNDS))
def peak_boundary(spark, d):
    return signal.peak_boundary(v.trace(spark, d), 40).select("hid", "dye", "px", F.col("left").alias("l"), F.col("right").alias("r"))


@query("nearest_peak", sql("SELECT * FROM near", TRACE, PEAKS, NEAR))
def nearest_peak(spark, d):
    t = v.trace(spark, d)
    return signal.nearest_peak(t, t.select("hid", "dye", "px"))


@query("peak_in_or_near_run", sql("SELECT * FROM runpeak", TRACE, PEAKS, NEAR, RUNS, RUNPEAK))
def peak_in_or_near_run(spark, d):
    t = v.trace(spark, d)
    return big(signal.peak_in_or_near_run(t, signal.runs_of_ones(t, F.col("rfu") >= 40), 40), "run")


@query("size_standard_peaks", sql("""SELECT hid, px AS scan FROM (SELECT *, lead(px) OVER (PARTITION BY hid ORDER BY px) AS nx FROM (
    SELECT hid, px FROM peaks WHERE dye = 2 AND rfu >= 60 UNION SELECT w.hid, w.px FROM (SELECT hid, px FROM (SELECT *, lag(rfu, 1, 0::BIGINT) OVER w AS l, lead(rfu, 1, 0::BIGINT) OVER w AS r FROM trace WHERE dye = 2 AND px >= 6 WINDOW w AS (PARTITION BY hid ORDER BY px))
      WHERE ((rfu >= l AND rfu > r) OR (rfu > l AND rfu >= r)) AND rfu >= 30) w JOIN (SELECT hid, max(px) AS m FROM peaks WHERE dye = 2 AND rfu >= 60 GROUP BY hid) m ON m.hid = w.hid AND m.m <= 6)) WHERE nx IS NULL OR nx - px > 2""", TRACE, PEAKS))
def size_standard_peaks(spark, d):
    standard = v.trace(spark, d).where("dye = 2").select("hid", F.col("px").alias("scan"), "rfu")
    return signal.size_standard_peaks(standard, 60, 30, 6, 2)


@query("select_standard_peaks", sql("""SELECT hid, (4 - b)::BIGINT AS k, px AS scan, [65, 80, 100][(5 - b)::INT]::DOUBLE AS bp FROM (SELECT *, count(*) OVER (PARTITION BY hid) AS n FROM (SELECT hid, px, row_number() OVER (PARTITION BY hid ORDER BY px DESC) AS b FROM peaks WHERE dye = 2)
  WHERE b BETWEEN 2 AND 4) WHERE n = 3""", TRACE, PEAKS))
def select_standard_peaks(spark, d):
    peaks = signal.local_maxima(v.trace(spark, d)).where("dye = 2").select("hid", F.col("px").alias("scan"))
    return big(signal.select_standard_peaks(peaks, [65, 80, 100]), "k")


@query("validate_size_standard", sql("SELECT hid, bool_and(coalesce(s BETWEEN 7 AND 13, true)) AND count(*) = 19 AS valid FROM (SELECT hid, (scan - lag(scan) OVER w) / (bp - lag(bp) OVER w) AS s FROM knots WINDOW w AS (PARTITION BY hid ORDER BY scan)) GROUP BY hid", KNOTS))
def validate_size_standard(spark, d):
    return signal.validate_size_standard(v.knots(spark, d))


POINTS = "points AS (SELECT s_suppkey AS hid, 2500 + unnest(range(0, 60)) * 100 AS scan FROM supplier)"
SEGMENTS = """segs AS (SELECT *, lead(scan) OVER w AS s2, lead(bp) OVER w AS b2, row_number() OVER w AS k, count(*) OVER (PARTITION BY hid) AS n FROM knots WINDOW w AS (PARTITION BY hid ORDER BY scan)),
  lines AS (SELECT p.hid, p.scan, g.bp + (p.scan - g.scan) * (g.b2 - g.bp) / (g.s2 - g.scan) AS y, p.scan < min(g.scan) OVER (PARTITION BY p.hid) OR p.scan > max(g.s2) OVER (PARTITION BY p.hid) AS out, (g.k = 1 OR p.scan >= g.scan) AND (g.k = g.n - 1 OR p.scan < g.s2) AS hit
    FROM points p JOIN segs g ON g.hid = p.hid AND g.s2 IS NOT NULL)"""


def scan_points(spark, d):
    return v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("hid"), F.explode(F.sequence(F.lit(2500), F.lit(8400), F.lit(100)).cast("array<bigint>")).alias("scan"))


@query("interpolate_bp", sql("SELECT hid, scan, round(CASE WHEN out THEN 0e0 ELSE y END, 6) AS bp FROM lines WHERE hit", KNOTS, POINTS, SEGMENTS))
def interpolate_bp(spark, d):
    return signal.interpolate_bp(scan_points(spark, d), v.knots(spark, d)).withColumn("bp", F.round("bp", 6))


@query("linear_extrapolate", sql("SELECT hid, scan, round(y, 6) AS bp FROM lines WHERE hit", KNOTS, POINTS, SEGMENTS))
def linear_extrapolate(spark, d):
    return signal.interpolate_bp(scan_points(spark, d), v.knots(spark, d), extrapolate=True).withColumn("bp", F.round("bp", 6))


def good_knots(spark, d):
    k = v.knots(spark, d)
    return k.join(signal.validate_size_standard(k).where("valid"), "hid", "left_semi")


GRID = """good AS (SELECT hid FROM (SELECT hid, (scan - lag(scan) OVER w) / (bp - lag(bp) OVER w) AS s FROM knots WINDOW w AS (PARTITION BY hid ORDER BY scan)) GROUP BY hid HAVING bool_and(coalesce(s BETWEEN 7 AND 13, true)) AND count(*) = 19),
  slots AS (SELECT hid AS supplier, row_number() OVER (ORDER BY hid) - 1 AS slot, count(*) OVER () AS n FROM good),
  sides AS (SELECT hid, scan::DOUBLE AS s0, lead(scan) OVER w::DOUBLE AS s1, bp AS b0, lead(bp) OVER w AS b1 FROM knots SEMI JOIN good USING (hid) WINDOW w AS (PARTITION BY hid ORDER BY scan)),
  targets AS (SELECT px, 65e0 + px * 410e0 / 4095e0 AS t FROM (SELECT unnest(range(0, 4096)) AS px)),
  lower AS (SELECT hid, px, t, s0, s1, b0, (b1 - b0) / (s1 - s0) AS step, least(floor(s0 + (t - b0) / ((b1 - b0) / (s1 - s0)) + 1e-9), s1) AS lo FROM sides JOIN targets ON t >= b0 AND (t < b1 OR b1 = 475) WHERE s1 IS NOT NULL),
  both_sides AS (SELECT *, b0 + (lo - s0) * step AS low FROM lower),
  grid AS (SELECT hid, px, CASE WHEN up THEN lo + 1 ELSE lo END::BIGINT AS scan, CASE WHEN up THEN low + step ELSE low END AS bp FROM (SELECT *, t - low > low + step - t AND lo < s1 AS up FROM both_sides))"""


def nearest_sql(points: str, keys: str) -> str:
    """px of the pixel nearest each point (keys, supplier, bp), found among those around its even place."""
    return f"""(SELECT {keys}, px FROM (SELECT p.*, g.px, row_number() OVER (PARTITION BY {", ".join("p." + k for k in keys.split(", "))} ORDER BY abs(g.bp - p.bp), g.px) AS r
    FROM (SELECT DISTINCT q.*, greatest(0, least(4095, round((bp - 65) * 4095 / 410)::BIGINT + k)) AS c FROM {points} q, (SELECT unnest(range(-4, 5)) AS k)) p JOIN grid g ON g.hid = p.supplier AND g.px = p.c) WHERE r = 1)"""


@query("rescale_to_grid", sql("SELECT hid, px, scan, round(bp, 6) AS bp FROM grid", KNOTS, GRID))
def rescale_to_grid(spark, d):
    return big(signal.rescale_to_grid(good_knots(spark, d)), "px", "scan").withColumn("bp", F.round("bp", 6))


def scaler(spark, d):
    return signal.rescale_to_grid(good_knots(spark, d), profiles=v.table(spark, d, "supplier").count()).select("hid", "px", "bp")


def scalers(spark, d):
    """The same with one row per supplier."""
    return signal.scaler_arrays(good_knots(spark, d), v.table(spark, d, "supplier").count())


def with_supplier(spark, d, rows: DataFrame, key: str) -> DataFrame:
    """rows with supplier: the keys are dealt in turn over all suppliers with a valid standard."""
    good = good_knots(spark, d).select(F.col("hid").alias("supplier")).distinct()
    slots = splits.ranked(good, [F.col("supplier")], "_slot").withColumn("_slot", F.col("_slot") - 1)
    return rows.withColumn("_slot", F.pmod(F.col(key), F.lit(good.count()))).join(slots, "_slot").drop("_slot")


@query("resample_profile", sql("""SELECT t.hid, t.dye, g.px, t.rfu FROM (SELECT hid, dye, 3000 + hid * 37 % 4000 + px AS scan, rfu FROM trace) t JOIN slots s ON s.slot = t.hid % s.n
  JOIN grid g ON g.hid = s.supplier AND g.scan = t.scan""", TRACE, KNOTS, GRID))
def resample_profile(spark, d):
    """The trace of every user laid over the scans of a standard of its own, a copy of its supplier's."""
    trace = v.trace(spark, d)
    users = with_supplier(spark, d, v.table(spark, d, "events").select(F.col("user_id").alias("hid")).distinct(), "hid")
    knots = users.join(good_knots(spark, d).withColumnRenamed("hid", "supplier"), "supplier").select("hid", "scan", "bp")
    raw = trace.select("hid", "dye", (3000 + F.col("hid") * 37 % 4000 + F.col("px")).alias("scan"), "rfu")
    ranges = raw.groupBy("hid").agg(F.min("scan").alias("low"), F.max("scan").alias("high"))
    return big(signal.resample_profile(raw, signal.pixel_places(knots, ranges)), "px").drop("bp")


def raw_traces(spark, d):
    """Six dyes of every supplier: a size standard with a peak at each knot, one before and one after,
    and five dyes whose values follow from the scan."""
    knots = v.knots(spark, d)
    ends = signal.spread(knots, "hid").groupBy("hid").agg(F.min("scan").alias("first"), F.max("scan").alias("last"))
    tops = knots.select("hid", "scan").unionByName(ends.select("hid", F.explode(F.array(F.col("first") - 150, F.col("last") + 200)).alias("scan")))
    shape = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(x).alias("rfu")) for o, x in ((-1, 100), (0, 900), (1, 100))])
    standard = tops.select("hid", "scan", F.explode(shape).alias("s")).select("hid", F.lit(5).cast("bigint").alias("dye"), (F.col("scan") + F.col("s.o")).alias("scan"), F.col("s.rfu").cast("bigint").alias("rfu"))
    dyes = ends.select("hid", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("dye"), "first", "last").select("hid", "dye", F.explode(F.sequence("first", "last")).alias("scan"))
    return standard.unionByName(dyes.withColumn("rfu", (F.col("scan") * 7 + F.col("dye")) % 500))


@query("calibrated_profile", sql("SELECT hid, dye, px, (scan * 7 + dye) % 500 AS rfu, round(bp, 6) AS bp FROM grid, (SELECT unnest(range(0, 5)) AS dye)", KNOTS, GRID))
def calibrated_profile(spark, d):
    pixels = signal.calibrated_profile(raw_traces(spark, d))[0]
    return big(pixels, "px").select("hid", "dye", "px", "rfu", F.round("bp", 6).alias("bp"))


@query("bp_to_pixel", sql(f"SELECT supplier AS hid, key, px FROM {nearest_sql('points', 'supplier, key')}", KNOTS, GRID, "points AS (SELECT o_orderkey AS key, supplier, 50e0 + o_totalprice % 450 AS bp FROM orders JOIN slots ON slot = o_orderkey % n)"))
def bp_to_pixel(spark, d):
    points = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.lit(50.0) + F.col("o_totalprice") % 450).alias("bp"))
    return big(signal.bp_to_pixel(with_supplier(spark, d, points, "key").withColumnRenamed("supplier", "hid"), scalers(spark, d)), "px").select("hid", "key", "px")


@query("ladder_peaks", sql("""SELECT p.hid, p.dye, row_number() OVER (PARTITION BY p.hid, p.dye ORDER BY p.px) - 1 AS k, p.px FROM ltops p JOIN (SELECT hid FROM (SELECT a.hid, a.dye, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT hid, dye FROM trace) a
    LEFT JOIN (SELECT hid, dye, count(*) AS n FROM ltops GROUP BY ALL) c ON c.hid = a.hid AND c.dye = a.dye) GROUP BY hid HAVING bool_and(n = 1)) g ON g.hid = p.hid""", TRACE,
  """lz AS (SELECT * FROM trace UNION ALL SELECT DISTINCT hid, dye, -1, 0 FROM trace)""", PLATEAU.replace("FROM trace", "FROM lz"), """ltops AS (SELECT p.* FROM plateau p JOIN (SELECT hid, dye, max(rfu) AS m FROM trace GROUP BY ALL) m ON m.hid = p.hid AND m.dye = p.dye WHERE p.rfu >= 0.6e0 * m.m)"""))
def ladder_peaks(spark, d):
    expected = spark.createDataFrame([(i, 1) for i in range(5)], "dye bigint, n bigint")
    return big(signal.ladder_peaks(v.trace(spark, d), expected), "k")


# Panel lookups

ASKED = """asked AS (SELECT l_orderkey, l_linenumber, p_brand AS marker, CASE l_linenumber % 4 WHEN 0 THEN l_partkey::VARCHAR || '.2' WHEN 1 THEN (l_partkey + 1)::VARCHAR WHEN 2 THEN 'x.y.z' ELSE l_partkey::VARCHAR END AS allele
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def asked(spark, d):
    j = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(v.table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_linenumber") % 4
    allele = F.when(k == 0, F.concat(F.col("l_partkey").cast("string"), F.lit(".2"))).when(k == 1, (F.col("l_partkey") + 1).cast("string")).when(k == 2, "x.y.z").otherwise(F.col("l_partkey").cast("string"))
    return j.select("l_orderkey", "l_linenumber", F.col("p_brand").alias("marker"), allele.alias("allele"))


@query("allele_info", sql("""SELECT q.l_orderkey, q.l_linenumber, q.marker, q.allele, round(coalesce(e.base_pair, b.base_pair + 2, 10 + x), 6) AS bp, round(coalesce(e.base_pair - e.left_off, b.base_pair - b.left_off + 2, 9 + x), 6) AS bp_left,
  round(coalesce(e.base_pair + e.right_off, b.base_pair + b.right_off + 2, 11 + x), 6) AS bp_right, e.base_pair IS NOT NULL OR b.base_pair IS NOT NULL AS in_panel
  FROM (SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 0 END AS x FROM asked) q LEFT JOIN panel e ON e.marker = q.marker AND e.allele = q.allele LEFT JOIN panel b ON q.x = 2 AND e.allele IS NULL AND b.marker = q.marker AND b.allele = split_part(q.allele, '.', 1)""", PANEL, ASKED))
def allele_info(spark, d):
    info = panel.allele_info(asked(spark, d), v.panel(spark, d))
    return info.withColumns({c: F.round(c, 6) for c in ("bp", "bp_left", "bp_right")})


@query("dye_row_of_marker", sql("SELECT c.key, c.marker, p.dye FROM (SELECT c_custkey AS key, 'Brand#' || (c_custkey % 30)::VARCHAR AS marker FROM customer) c LEFT JOIN (SELECT DISTINCT marker, dye FROM panel) p ON p.marker = c.marker", PANEL))
def dye_row_of_marker(spark, d):
    k = F.col("c_custkey")
    return panel.dye_row_of_marker(v.table(spark, d, "customer").select(k.alias("key"), F.concat(F.lit("Brand#"), (k % 30).cast("string")).alias("marker")), v.panel(spark, d))


BYBP = """bybp AS (SELECT dye, base_pair, marker, allele, f AS ord FROM (SELECT *, min(ord) OVER (PARTITION BY dye, base_pair) AS f, row_number() OVER (PARTITION BY dye, base_pair ORDER BY ord DESC) AS k FROM panel) WHERE k = 1)"""


@query("allele_at_dye_bp", sql("SELECT q.dye, q.base_pair, q.ord AS key, b.marker, b.allele FROM panel q JOIN bybp b ON b.dye = q.dye AND b.base_pair = q.base_pair", PANEL, BYBP))
def allele_at_dye_bp(spark, d):
    p = v.panel(spark, d)
    return panel.allele_at_dye_bp(p.select("dye", "base_pair", F.col("ord").alias("key")), p)


NEARBP = """nearest AS (SELECT hid, dye, px, marker, allele FROM (SELECT t.hid, t.dye, t.px, b.marker, b.allele, row_number() OVER (PARTITION BY t.hid, t.dye, t.px ORDER BY round(abs(b.base_pair - (65e0 + t.px * 20e0)), 6), b.ord) AS k
  FROM peaks t JOIN bybp b ON b.dye = t.dye WHERE t.rfu >= 40) WHERE k = 1)"""


@query("nearest_allele", sql("SELECT * FROM nearest", TRACE, PEAKS, PANEL, BYBP, NEARBP))
def nearest_allele(spark, d):
    points = signal.peaks_above(v.trace(spark, d), 40).withColumn("bp", 65.0 + F.col("px") * 20.0)
    return panel.nearest_allele(points, v.panel(spark, d), digits=6).select("hid", "dye", "px", "marker", "allele")


@query("marker_bins", sql("SELECT marker, round(min(base_pair - left_off) - 1, 6) AS bin_left, round(max(base_pair + right_off) + 1, 6) AS bin_right FROM panel GROUP BY marker", PANEL))
def marker_bins(spark, d):
    return panel.marker_bins(v.panel(spark, d)).withColumns({c: F.round(c, 6) for c in ("bin_left", "bin_right")})


KITBINS = """kitbins AS (SELECT p_partkey % 5 AS panel_id, p_brand AS marker, any_value(regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT % 5) AS dye, min(100e0 + p_partkey % 40 - 0.5e0) - 1 AS low, max(100e0 + p_partkey % 40 + 0.75e0) + 1 AS high FROM part GROUP BY ALL),
  ends AS (SELECT g.hid AS supplier, b.marker, b.dye, e.side, CASE e.side WHEN 'l' THEN b.low ELSE b.high END AS bp FROM good g JOIN kitbins b ON b.panel_id = g.hid % 5, (SELECT unnest(['l', 'r']) AS side) e)"""


@query("marker_windows", sql(f"""SELECT hid, marker, dye, px, px % 97 AS rfu FROM (SELECT hid, marker, dye, unnest(range(greatest(l - 5, 0), least(r + 5, 4096))) AS px FROM (SELECT supplier AS hid, marker, dye, max(px) FILTER (WHERE side = 'l') AS l, max(px) FILTER (WHERE side = 'r') AS r
  FROM {nearest_sql('ends', 'supplier, marker, dye, side')} GROUP BY ALL))""", KNOTS, GRID, KITBINS))
def marker_windows(spark, d):
    """Five kits, each with its own parts; a supplier's profile uses one of them."""
    kit = v.panel(spark, d).withColumn("base_pair", F.lit(100.0) + F.col("ord") % 40).withColumn("panel_id", F.col("ord") % 5)
    pixels = scaler(spark, d).withColumn("dye", F.explode(F.array(*map(F.lit, range(5))).cast("array<bigint>"))).withColumn("rfu", F.col("px") % 97)
    profiles = good_knots(spark, d).select("hid", (F.col("hid") % 5).alias("panel_id")).distinct()
    return big(panel.marker_windows(pixels, kit, scalers(spark, d), profiles), "px", "rfu")


LADDERS = """ladders AS (SELECT s_suppkey AS hid, s_suppkey % (SELECT max(p_partkey) // 400 + 1 FROM part) AS kit FROM supplier),
  located AS (SELECT l.hid, p.marker, p.allele, p.base_pair + 0.1e0 * l.hid AS known FROM ladders l JOIN panel p ON p.ord // 400 = l.kit WHERE p.ord % 3 = 0),
  everyp AS (SELECT l.hid, p.*, k.known, count(k.known) OVER (PARTITION BY l.hid, p.marker ORDER BY p.ord) AS seen, count(k.known) OVER (PARTITION BY l.hid, p.marker) AS n FROM ladders l JOIN panel p ON p.ord // 400 = l.kit LEFT JOIN located k ON k.hid = l.hid AND k.marker = p.marker AND k.allele = p.allele),
  anchors AS (SELECT hid, marker, base_pair AS x, known AS y, row_number() OVER (PARTITION BY hid, marker ORDER BY ord) AS k FROM everyp WHERE known IS NOT NULL)"""


@query("adjust_panel", sql("""SELECT e.hid AS panel_id, e.dye, e.marker, e.allele, round(coalesce(e.known, a.y + (e.base_pair - a.x) * (b.y - a.y) / (b.x - a.x), e.base_pair), 4) AS base_pair FROM everyp e
  LEFT JOIN anchors a ON a.hid = e.hid AND a.marker = e.marker AND a.k = least(greatest(e.seen, 1), greatest(e.n - 1, 1)) LEFT JOIN anchors b ON b.hid = e.hid AND b.marker = e.marker AND b.k = a.k + 1""",
  PANEL.replace("p_retailprice - 900e0", "p_partkey").replace("* 4.1e0", "* 0.2e0"), LADDERS))
def adjust_panel(spark, d):
    """Every supplier is a ladder; kits hold 400 parts each."""
    p = v.panel(spark, d).withColumn("base_pair", F.round(65.0 + F.col("ord") * 0.2, 6)).withColumn("panel_id", F.floor(F.col("ord") / 400))
    kits = p.agg(F.max("panel_id") + 1).first()[0]
    ladders = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("hid"), (F.col("s_suppkey") % kits).alias("panel_id"))
    k = F.row_number().over(Window.partitionBy("panel_id", "dye").orderBy("ord")) - 1
    alleles = p.where("ord % 3 = 0").select("panel_id", "dye", k.alias("k"), "marker", "allele", "base_pair")
    peaks = ladders.join(alleles, "panel_id").select("hid", "dye", "k", (F.col("dye") * 1_000_000 + F.col("k")).alias("px"), (F.col("base_pair") + 0.1 * F.col("hid")).alias("bp"))
    moved = panel.adjust_panel(p, alleles.drop("base_pair"), peaks.drop("bp"), peaks.select("hid", "px", "bp"), ladders)
    return moved.select("panel_id", "dye", "marker", "allele", F.round("base_pair", 4).alias("base_pair"))


@query("resolve_panel", "SELECT c_custkey AS hid, 'L' || (c_custkey % 50)::VARCHAR AS ladder_id, CASE WHEN c_custkey % 50 < 25 THEN 'L' || (c_custkey % 50)::VARCHAR ELSE 'default' END AS panel_id FROM customer")
def resolve_panel(spark, d):
    k = F.col("c_custkey")
    profiles = v.table(spark, d, "customer").select(k.alias("hid"), F.concat(F.lit("L"), (k % 50).cast("string")).alias("ladder_id"))
    return panel.resolve_panel(profiles, profiles.where(F.substring("ladder_id", 2, 9).cast("int") < 25), "default")


BINS = """bins AS (SELECT s.ladder_id, t.hid, t.dye, m.px AS l, m.px + 5 AS r FROM (SELECT DISTINCT hid, dye FROM trace) t, (SELECT unnest([0, 3, 6]) AS px) m, (SELECT unnest(['a', 'b', 'c']) AS ladder_id) s WHERE (t.hid + m.px + ascii(s.ladder_id)) % 2 = 0),
  inside AS (SELECT b.ladder_id, b.hid, b.dye, b.l, b.r, t.px, t.rfu, max(t.rfu) OVER (PARTITION BY b.ladder_id, b.hid, b.dye, b.l) AS most FROM bins b JOIN trace t ON t.hid = b.hid AND t.dye = b.dye AND t.px BETWEEN b.l AND b.r - 1),
  iruns AS (SELECT ladder_id, hid, dye, l, g, any_value(rfu) AS rfu, any_value(most) AS most FROM (SELECT *, sum(n) OVER (PARTITION BY ladder_id, hid, dye, l ORDER BY px) AS g FROM (SELECT *, CASE WHEN lag(rfu) OVER (PARTITION BY ladder_id, hid, dye, l ORDER BY px) = rfu THEN 0 ELSE 1 END AS n FROM inside)) GROUP BY ladder_id, hid, dye, l, g),
  good AS (SELECT DISTINCT ladder_id, hid, dye, l FROM (SELECT *, lag(rfu) OVER w AS a, lead(rfu) OVER w AS b FROM iruns WINDOW w AS (PARTITION BY ladder_id, hid, dye, l ORDER BY g)) WHERE rfu > a AND rfu > b AND rfu >= 0.8e0 * most),
  haspeak AS (SELECT b.*, g.l IS NOT NULL AS has_peak FROM bins b LEFT JOIN good g ON g.ladder_id = b.ladder_id AND g.hid = b.hid AND g.dye = b.dye AND g.l = b.l)"""


def bins(spark, d):
    t = v.trace(spark, d)
    some = t.select("hid", "dye").distinct().withColumn("l", F.explode(F.array(*map(F.lit, (0, 3, 6))).cast("array<bigint>"))).withColumn("ladder_id", F.explode(F.array(*map(F.lit, "abc"))))
    spans = some.where((F.col("hid") + F.col("l") + F.ascii("ladder_id")) % 2 == 0).withColumn("r", F.col("l") + 5)
    return panel.bin_has_peak(spans.select("ladder_id", "hid", "dye", "l", "r"), t)


@query("bin_has_peak", sql("SELECT ladder_id, hid, dye, l, r, has_peak FROM haspeak", TRACE, BINS))
def bin_has_peak(spark, d):
    return bins(spark, d)


@query("best_ladder", sql("SELECT hid, ladder_id, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY hid ORDER BY n DESC, ladder_id) AS k FROM (SELECT hid, ladder_id, count(*) FILTER (WHERE has_peak) AS n FROM haspeak GROUP BY ALL) WHERE n > 0) WHERE k = 1", TRACE, BINS))
def best_ladder(spark, d):
    return panel.best_ladder(bins(spark, d))


def loaded(spark, d):
    """The suppliers' raw files, listed and loaded; annotations are named after them."""
    listed = v.files(spark, d)
    samples = listed.where("not ladder")
    stems = samples.where("hid % 13 <> 1").select("hid", "stem")
    annotations = stems.select("stem", F.concat(F.lit("S"), "stem").alias("annotation"), F.lit("report").alias("report"))
    kit = v.kit(spark, d)
    pairs = stems.where("hid % 13 <> 4").withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(24)).cast("array<bigint>"))).where("(hid + ord) % 3 <> 0")
    reported = pairs.join(kit.select("ord", "marker", "allele"), "ord").select(F.concat(F.lit("S"), "stem").alias("sample"), "marker", "allele", (100.0 + F.col("ord")).alias("height"))
    return listed, samples, dataset.load_profiles(samples.select("stem", "content"), annotations, reported, kit)


@query("load_outcomes", sql("SELECT hid::VARCHAR AS hid, status FROM files", FILES))
def load_outcomes(spark, d):
    return loaded(spark, d)[2].outcomes


@query("load_report_of_files", sql("SELECT status, count(*) AS n FROM files GROUP BY status", FILES))
def load_report_of_files(spark, d):
    return metrics.load_report(loaded(spark, d)[2].outcomes)


SELECTED = """centres AS (SELECT f.hid, f.ladder, a.dye, a.k, a.ord, floor(3000 + (a.base_pair + 0.4e0 * (f.hid % 3) - 65) * (8 + f.hid % 4) + 3)::BIGINT AS c
    FROM (SELECT hid, false AS ladder FROM files WHERE status = 'kept' UNION ALL SELECT s_suppkey, true FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 4 <> 0) f, kit a
    WHERE CASE WHEN f.ladder THEN a.k <> 2 ELSE (2 * f.hid + a.ord) % 5 <> 0 END),
  shaped AS (SELECT c.hid, c.ladder, c.dye, c.k, g.px, g.bp, 1000 - 60 * abs(g.scan - c.c) AS rfu FROM centres c JOIN grid g ON g.hid = c.hid AND g.scan BETWEEN c.c - 15 AND c.c + 15),
  tops AS (SELECT hid, dye, k, (min(px) + max(px)) // 2 AS px FROM (SELECT *, max(rfu) OVER (PARTITION BY hid, dye, k) AS most FROM shaped WHERE ladder) WHERE rfu = most GROUP BY ALL),
  known AS (SELECT t.hid, t.dye, t.k, g.bp FROM tops t JOIN grid g ON g.hid = t.hid AND g.px = t.px),
  moved AS (SELECT l.hid, a.dye, a.k, a.marker, a.allele, a.ord, coalesce(o.bp, b.bp + (a.base_pair - pb.base_pair) * (n.bp - b.bp) / (pn.base_pair - pb.base_pair)) AS bp FROM (SELECT DISTINCT hid FROM known) l CROSS JOIN kit a
    LEFT JOIN known o ON o.hid = l.hid AND o.dye = a.dye AND o.k = a.k LEFT JOIN known b ON b.hid = l.hid AND b.dye = a.dye AND b.k = 1 LEFT JOIN known n ON n.hid = l.hid AND n.dye = a.dye AND n.k = 3
    LEFT JOIN kit pb ON pb.dye = a.dye AND pb.k = 1 LEFT JOIN kit pn ON pn.dye = a.dye AND pn.k = 3),
  lends AS (SELECT f.hid AS supplier, m.hid AS ladder, m.dye, m.k AS step, e.side, m.bp + CASE e.side WHEN 'l' THEN -0.6e0 ELSE 0.6e0 END AS bp FROM files f JOIN moved m ON m.hid % 4 = f.hid % 4 AND (f.hid + m.ord) % 3 <> 0, (SELECT unnest(['l', 'r']) AS side) e WHERE f.status = 'kept')"""
FITTED = f"""placed AS (SELECT supplier AS hid, ladder, dye, step AS k, max(px) FILTER (WHERE side = 'l') AS l, max(px) FILTER (WHERE side = 'r') AS r FROM {nearest_sql("lends", "supplier, ladder, dye, step, side")} GROUP BY ALL),
  within AS (SELECT u.hid, u.ladder, u.dye, u.k, u.px, coalesce(s.rfu, 5) AS rfu FROM (SELECT *, unnest(range(l, r)) AS px FROM placed) u LEFT JOIN shaped s ON s.hid = u.hid AND NOT s.ladder AND s.dye = u.dye AND s.px = u.px),
  wruns AS (SELECT hid, ladder, dye, k, g, any_value(rfu) AS rfu FROM (SELECT *, sum(n) OVER (PARTITION BY hid, ladder, dye, k ORDER BY px) AS g FROM (SELECT *, CASE WHEN lag(rfu) OVER (PARTITION BY hid, ladder, dye, k ORDER BY px) = rfu THEN 0 ELSE 1 END AS n FROM within)) GROUP BY ALL),
  fits AS (SELECT DISTINCT hid, ladder, dye, k FROM (SELECT *, lag(rfu) OVER w AS a, lead(rfu) OVER w AS b, max(rfu) OVER (PARTITION BY hid, ladder, dye, k) AS most FROM wruns WINDOW w AS (PARTITION BY hid, ladder, dye, k ORDER BY g)) WHERE rfu > a AND rfu > b AND rfu >= 0.8e0 * most),
  ranked AS (SELECT hid, 'runs/' || (ladder % 4)::VARCHAR || '/Ladder_' || ladder::VARCHAR || '.hid' AS path, count(*) AS n FROM fits GROUP BY ALL)"""


@query("select_ladders", sql("SELECT f.hid::VARCHAR AS image_path, b.path AS ladder_path FROM files f LEFT JOIN (SELECT hid, path FROM (SELECT *, row_number() OVER (PARTITION BY hid ORDER BY n DESC, path) AS i FROM ranked) WHERE i = 1) b ON b.hid = f.hid WHERE f.status = 'kept'", KNOTS, GRID, KIT, FILES, SELECTED, FITTED))
def select_ladders(spark, d):
    """From the raw files of profiles and ladders to the ladder of each profile."""
    listed, samples, profiles = loaded(spark, d)
    kit = v.kit(spark, d)
    alleles = kit.where("floor(ord / 5) <> 2").select("dye", (F.row_number().over(Window.partitionBy("dye").orderBy("ord")) - 1).alias("k"), "marker", "allele")
    return ladders.select_ladders(samples.select("stem", "path"), profiles, listed.where("ladder").select("path", "name", "content"), kit, alleles)


# Annotation and calling


@query("adjust_top", sql(WON, TRACE, PEAKS, NEAR, RUNS, RUNPEAK, "covers AS (SELECT hid, dye, run, peak AS l, peak AS r FROM runpeak)", WINS))
def adjust_top(spark, d):
    return annotate.adjust_top(v.trace(spark, d).withColumn("mask", F.col("rfu") >= 40))


@query("adjust_complete", sql(WON, TRACE, PEAKS, NEAR, RUNS, RUNPEAK, BOUNDS, "covers AS (SELECT p.hid, p.dye, p.run, b.l, b.r FROM runpeak p JOIN bounds b ON b.hid = p.hid AND b.dye = p.dye AND b.px = p.peak)", WINS))
def adjust_complete(spark, d):
    return annotate.adjust_complete(v.trace(spark, d).withColumn("mask", F.col("rfu") >= 40))


CALLED = """called AS (SELECT hid, dye, marker, allele, max(height) AS height FROM (SELECT r.*, b.marker, b.allele, row_number() OVER (PARTITION BY r.hid, r.dye, r.g ORDER BY round(abs(b.base_pair - r.bp), 6), b.ord) AS k FROM
    (SELECT hid, dye, g, avg(65e0 + 20e0 * px) AS bp, max(rfu) AS height FROM (SELECT *, px - row_number() OVER (PARTITION BY hid, dye ORDER BY px) AS g FROM trace WHERE rfu >= 40) GROUP BY hid, dye, g) r JOIN bybp b ON b.dye = r.dye) WHERE k = 1 GROUP BY ALL)"""


def flagship(spark, d):
    pixels = v.trace(spark, d).withColumn("bp", 65.0 + 20.0 * F.col("px")).withColumn("prob", F.when(F.col("rfu") >= 40, 1.0).otherwise(0.0))
    return annotate.call_alleles(pixels, v.panel(spark, d), digits=6)


@query("call_alleles", sql("SELECT * FROM called", TRACE, PANEL, BYBP, CALLED))
def call_alleles(spark, d):
    return flagship(spark, d)


ENDS = """info AS (SELECT DISTINCT q.l_orderkey AS hid, m.dye, coalesce(e.base_pair - e.left_off, b.base_pair - b.left_off + 2, 9 + x) AS low, coalesce(e.base_pair + e.right_off, b.base_pair + b.right_off + 2, 11 + x) AS high
    FROM (SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 0 END AS x FROM asked) q JOIN (SELECT DISTINCT marker, dye FROM panel) m ON m.marker = q.marker LEFT JOIN panel e ON e.marker = q.marker AND e.allele = q.allele
    LEFT JOIN panel b ON q.x = 2 AND e.allele IS NULL AND b.marker = q.marker AND b.allele = split_part(q.allele, '.', 1)),
  ends AS (SELECT hid, dye, low, high, supplier, s.side, CASE s.side WHEN 'l' THEN low ELSE high END AS bp FROM info JOIN slots ON slot = hid % n, (SELECT unnest(['l', 'r']) AS side) s)"""


@query("segmentation_mask", sql(f"""SELECT DISTINCT hid, dye, unnest(range(l, r)) AS px FROM (SELECT hid, dye, low, high, max(px) FILTER (WHERE side = 'l') AS l, max(px) FILTER (WHERE side = 'r') AS r
  FROM {nearest_sql('ends', 'hid, dye, low, high, side')} GROUP BY ALL)""", KNOTS, GRID, PANEL, ASKED, ENDS))
def segmentation_mask(spark, d):
    """Every order is a profile; the orders of a supplier share its scaler."""
    called = panel.dye_row_of_marker(asked(spark, d).select(F.col("l_orderkey").alias("hid"), "marker", "allele"), v.panel(spark, d))
    return big(annotate.segmentation_mask(with_supplier(spark, d, called, "hid"), v.panel(spark, d), scalers(spark, d).withColumnRenamed("hid", "supplier"), "supplier"), "px")


@query("human_baseline", sql("SELECT hid, marker, allele, height, 'predicted' AS source FROM calls WHERE truth AND marker NOT IN ('AMEL', 'DYS391', 'DYS576', 'DYS570')", CALLS))
def human_baseline(spark, d):
    c = v.calls(spark, d).where("truth").select("hid", "marker", "allele", "height", F.lit("analyst").alias("source"))
    return annotate.human_baseline(c)


LETTERS = [k + letter for k, ls in fn.DONORS.items() for letter in ls]
DONATED = f"""wanted AS (SELECT key AS hid, unnest(list_transform(list_slice(list_filter({LETTERS}, lambda x: x[1] = substr(name, 1, 1)), 1, substr(name, 3, 1)::INT), lambda x: x)) AS donor FROM names WHERE regexp_matches(substr(name, 1, 3), '^[0-9][A-F][0-9]$')),
  donors AS (SELECT ({LETTERS})[p_partkey % 30 + 1] AS donor, p_brand AS marker, p_size::VARCHAR AS allele FROM part UNION ALL SELECT ({LETTERS})[p_partkey % 30 + 1], p_brand, (p_size + 1)::VARCHAR FROM part)"""


@query("donor_alleles", sql("""SELECT w.hid, m.dye, d.marker, string_agg(DISTINCT d.allele, ',' ORDER BY d.allele) AS alleles FROM wanted w JOIN donors d ON d.donor = w.donor JOIN (SELECT DISTINCT marker, dye FROM panel) m ON m.marker = d.marker
  GROUP BY w.hid, m.dye, d.marker""", NAMES, PANEL, DONATED))
def donor_alleles(spark, d):
    parts = v.table(spark, d, "part")
    donors = parts.select(F.element_at(F.array(*map(F.lit, LETTERS)), (F.col("p_partkey") % 30 + 1).cast("int")).alias("donor"), F.col("p_brand").alias("marker"), F.col("p_size").cast("string").alias("allele1"), (F.col("p_size") + 1).cast("string").alias("allele2"))
    found = annotate.donor_alleles(v.names(spark, d).select(F.col("key").alias("hid"), "name"), donors, v.panel(spark, d))
    return found.select("hid", "dye", "marker", F.array_join("alleles", ",").alias("alleles"))


@query("attach_ground_truth", sql("SELECT hid, marker, allele, height, 'analyst' AS source FROM calls WHERE truth UNION ALL SELECT DISTINCT hid, marker, allele, NULL::DOUBLE, 'donor' FROM calls WHERE predicted", CALLS))
def attach_ground_truth(spark, d):
    c = v.calls(spark, d)
    donors = c.where("predicted").groupBy("hid", "marker").agg(F.collect_set("allele").alias("alleles"))
    return annotate.attach_ground_truth(c.where("truth"), donors)


def by_source(calls: DataFrame, **sources) -> DataFrame:
    """calls (hid, marker, allele, more) once for each source (its condition and height) that has them; they are made once for all sources."""
    each = F.array(*[F.when(F.expr(where), F.struct(height.cast("double").alias("height"), F.lit(name).alias("source"))) for name, (where, height) in sources.items()])
    return calls.select("hid", "marker", "allele", F.explode(F.filter(each, lambda s: s.isNotNull())).alias("_s")).select("hid", "marker", "allele", "_s.*")


@query("allele_comparison", sql("""SELECT c.hid, c.marker, c.allele, CASE WHEN c.predicted THEN c.height END AS height, CASE WHEN truth AND predicted THEN 'TP' WHEN predicted THEN 'FP' ELSE 'FN' END AS kind, round(p.base_pair, 6) AS bp, round(p.base_pair - 0.5e0, 6) AS bp_left,
  round(p.base_pair + 0.75e0, 6) AS bp_right, true AS in_panel FROM calls c JOIN panel p ON p.marker = c.marker AND p.allele = c.allele WHERE truth OR predicted""", CALLS, PANEL))
def allele_comparison(spark, d):
    c = v.calls(spark, d)
    both = by_source(c, predicted=("predicted", F.col("height")), donor=("truth", F.col("height")))
    compared = annotate.allele_comparison(both, v.panel(spark, d)).select("hid", "marker", "allele", "height", "kind", "bp", "bp_left", "bp_right", "in_panel")
    return compared.withColumns({x: F.round(x, 6) for x in ("bp", "bp_left", "bp_right")})


# Metrics

PIXELS = """pix AS (SELECT sum(CASE WHEN mask AND prob >= 0.5e0 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN NOT mask AND prob >= 0.5e0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN mask AND prob < 0.5e0 THEN 1 ELSE 0 END)::BIGINT AS fn FROM dense)"""
ALLELES = """al AS (SELECT sum(CASE WHEN truth AND predicted THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN predicted AND NOT truth THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN truth AND NOT predicted THEN 1 ELSE 0 END)::BIGINT AS fn FROM calls)"""
RATES = "SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2e0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM "


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def sets(spark, d):
    c = v.calls(spark, d)
    return metrics.locus_allele_set(c.where("predicted")), metrics.locus_allele_set(c.where("truth"))


@query("pixel_confusion", sql("SELECT * FROM pix", DENSE, PIXELS))
def pixel_confusion(spark, d):
    return metrics.pixel_confusion(v.dense(spark, d))


for _name in ("precision", "recall", "f1"):
    query(f"pixel_{_name}", sql(f"SELECT {_name} FROM ({RATES} pix)", DENSE, PIXELS))(lambda spark, d, c=_name: rounded(metrics.pixel_scores(v.dense(spark, d)).select(c), c))
    query(f"allele_{_name}", sql(f"SELECT {_name} FROM ({RATES} al)", CALLS, ALLELES))(lambda spark, d, c=_name: rounded(metrics.allele_scores(*sets(spark, d)).select(c), c))


@query("average_binary_iou", sql("SELECT round(avg(coalesce(i / nullif(u, 0), 0e0)), 6) AS iou FROM (SELECT hid, sum(CASE WHEN mask AND prob > 0.5e0 THEN 1 ELSE 0 END) AS i, sum(CASE WHEN mask OR prob > 0.5e0 THEN 1 ELSE 0 END) AS u FROM dense GROUP BY hid)", DENSE))
def average_binary_iou(spark, d):
    return rounded(metrics.average_binary_iou(v.dense(spark, d)), "iou")


LOCI = f"""loci AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {low}, {high})" for m, (low, high) in LOCUS_THRESHOLDS.items())}) t(marker, low, high)),
  items AS (SELECT l_orderkey, l_linenumber, l_quantity * 3 AS height, ({list(LOCUS_THRESHOLDS)})[l_partkey % 27 + 1] AS marker FROM lineitem)"""


@query("locus_thresholds", sql("""SELECT mode, i.marker, count(*) AS n FROM items i JOIN loci t ON t.marker = i.marker, (SELECT unnest(['low', 'high', 'between', 'min_rfu', 'one locus', 'none']) AS mode) m
  WHERE CASE mode WHEN 'low' THEN height >= low WHEN 'high' THEN height >= high WHEN 'between' THEN height > low AND height < high WHEN 'min_rfu' THEN height >= 100 WHEN 'one locus' THEN i.marker = 'FGA' AND height >= high ELSE true END GROUP BY ALL""", LOCI))
def locus_thresholds(spark, d):
    """How many line items, as calls of the 27 loci, pass the thresholds of every mode."""
    names = F.array(*map(F.lit, LOCUS_THRESHOLDS))
    calls = v.table(spark, d, "lineitem").select((F.col("l_quantity") * 3).alias("height"), F.element_at(names, (F.col("l_partkey") % 27 + 1).cast("int")).alias("marker"), F.lit("x").alias("allele"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("hid"))
    modes = {"low": {"low_or_high": "low"}, "high": {"low_or_high": "high"}, "between": {"low_or_high": "between"}, "min_rfu": {"min_rfu": 100}, "one locus": {"locus": "FGA", "low_or_high": "high", "min_rfu": 5}, "none": {"min_rfu": 0}}
    limits = v.stacked(*[metrics.locus_thresholds(spark, **how).withColumn("mode", F.lit(mode)) for mode, how in modes.items()])
    kept = metrics.passing(calls.join(limits, "marker"))
    return kept.groupBy("mode", "marker").agg(F.count(F.lit(1)).alias("n"))


@query("locus_allele_set", sql("SELECT hid, marker || '_' || allele AS key FROM calls WHERE predicted AND height >= 20", CALLS))
def locus_allele_set(spark, d):
    return metrics.locus_allele_set(v.calls(spark, d).where("predicted"), min_rfu=20)


@query("allele_comparison_of_three", sql("""SELECT c.hid, c.marker, c.allele, predicted AS in_predicted, c.height >= 20 AS in_analyst, truth AS in_donor, CASE WHEN c.predicted THEN c.height END AS height, CASE WHEN c.height >= 20 THEN c.height + 1 END AS analyst_height,
  CASE WHEN truth AND predicted THEN 'TP' WHEN predicted THEN 'FP' WHEN truth THEN 'FN' END AS kind, round(p.base_pair, 6) AS bp FROM calls c JOIN panel p ON p.marker = c.marker AND p.allele = c.allele WHERE truth OR predicted OR c.height >= 20""", CALLS, PANEL))
def allele_comparison_of_three(spark, d):
    c = v.calls(spark, d)
    every = by_source(c, predicted=("predicted", F.col("height")), analyst=("height >= 20", F.col("height") + 1), donor=("truth", F.lit(None)))
    return annotate.allele_comparison(every, v.panel(spark, d)).select("hid", "marker", "allele", "in_predicted", "in_analyst", "in_donor", "height", "analyst_height", "kind", F.round("bp", 6).alias("bp"))


SOURCE_ENDS = ENDS.replace("SELECT DISTINCT q.l_orderkey AS hid", "SELECT DISTINCT ['predicted', 'analyst', 'donor'][q.l_linenumber % 3 + 1] AS source, q.l_orderkey AS hid").replace("ends AS (SELECT hid", "ends AS (SELECT source, hid")


@query("comparison_masks", sql(f"""SELECT DISTINCT source, hid, dye, unnest(range(l, r)) AS px FROM (SELECT source, hid, dye, low, high, max(px) FILTER (WHERE side = 'l') AS l, max(px) FILTER (WHERE side = 'r') AS r
  FROM {nearest_sql('ends', 'source, hid, dye, low, high, side')} GROUP BY ALL)""", KNOTS, GRID, PANEL, ASKED, SOURCE_ENDS))
def comparison_masks(spark, d):
    """The line items of an order are dealt to the three sources."""
    source = F.element_at(F.array(*map(F.lit, annotate.SOURCES)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    called = panel.dye_row_of_marker(asked(spark, d).select(source.alias("source"), F.col("l_orderkey").alias("hid"), "marker", "allele"), v.panel(spark, d))
    return big(annotate.comparison_masks(with_supplier(spark, d, called, "hid"), v.panel(spark, d), scalers(spark, d).withColumnRenamed("hid", "supplier"), "supplier"), "px")


@query("allele_confusion", sql("SELECT * FROM al", CALLS, ALLELES))
def allele_confusion(spark, d):
    return metrics.allele_confusion(*sets(spark, d))


@query("evaluation_suite", sql("""SELECT metric, variant, round(value, 6) AS value FROM (
  SELECT 'pixel_precision' AS metric, 'none' AS variant, tp / (tp + fp) AS value FROM pix UNION ALL SELECT 'pixel_recall', 'none', tp / (tp + fn) FROM pix UNION ALL SELECT 'pixel_f1', 'none', 2e0 * tp / (2e0 * tp + fp + fn) FROM pix
  UNION ALL SELECT 'average_binary_iou', 'none', avg(coalesce(i / nullif(u, 0), 0e0)) FROM (SELECT hid, sum(CASE WHEN mask AND prob > 0.5e0 THEN 1 ELSE 0 END) AS i, sum(CASE WHEN mask OR prob > 0.5e0 THEN 1 ELSE 0 END) AS u FROM dense GROUP BY hid)
  UNION ALL SELECT 'allele_precision', variant, coalesce(tp / nullif(tp + fp, 0), 0) FROM var UNION ALL SELECT 'allele_recall', variant, coalesce(tp / nullif(tp + fn, 0), 0) FROM var UNION ALL SELECT 'allele_f1', variant, 2e0 * tp / (2e0 * tp + fp + fn) FROM var WHERE variant = 'none')""",
  DENSE, PIXELS, CALLS.replace("p_brand AS marker", "CASE WHEN p_partkey % 2 = 0 THEN 'FGA' ELSE 'TH01' END AS marker").replace("max(l_quantity)", "max(l_quantity * 3)"), """var AS (SELECT variant, sum(CASE WHEN p AND t THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND NOT t THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN t AND NOT p THEN 1 ELSE 0 END) AS fn FROM (
    SELECT variant, predicted AND CASE variant WHEN 'none' THEN true WHEN 'low' THEN height >= lo WHEN 'high' THEN height >= hi ELSE height > lo AND height < hi END AS p, truth AND CASE variant WHEN 'none' THEN true WHEN 'low' THEN height >= lo WHEN 'high' THEN height >= hi ELSE height > lo AND height < hi END AS t
    FROM (SELECT *, CASE WHEN marker = 'FGA' THEN 40 ELSE 45 END AS lo, CASE WHEN marker = 'FGA' THEN 95 ELSE 85 END AS hi FROM calls), (SELECT unnest(['none', 'low', 'high', 'between']) AS variant)) GROUP BY variant)"""))
def evaluation_suite(spark, d):
    c = v.calls(spark, d).withColumn("marker", F.when(F.col("allele").cast("bigint") % 2 == 0, "FGA").otherwise("TH01")).withColumn("height", F.col("height") * 3)
    return rounded(metrics.evaluation_suite(v.dense(spark, d), c.where("predicted"), c.where("truth")), "value")


@query("dice_loss", sql("SELECT round(1 - (2 * sum(CASE WHEN mask THEN prob ELSE 0 END) + 1) / (sum(prob) + sum(CASE WHEN mask THEN 1 ELSE 0 END) + 1), 6) AS loss FROM dense", DENSE))
def dice_loss(spark, d):
    return rounded(metrics.dice_loss(v.dense(spark, d)), "loss")


@query("binary_accuracy", sql("SELECT round(avg(CASE WHEN (prob >= 0.5e0) = mask THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM dense", DENSE))
def binary_accuracy(spark, d):
    return rounded(metrics.binary_accuracy(v.dense(spark, d)), "accuracy")


@query("running_mean_loss", "SELECT l_returnflag AS epoch, round(avg(l_discount), 6) AS loss FROM lineitem GROUP BY 1")
def running_mean_loss(spark, d):
    batches = v.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("epoch"), F.col("l_discount").alias("loss"))
    return rounded(metrics.running_mean_loss(batches, ["epoch"]), "loss")


@query("fold_means", "SELECT l_linestatus AS metric, round(avg(m), 6) AS mean_value FROM (SELECT l_linestatus, l_linenumber, avg(l_tax) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def fold_means(spark, d):
    folds = v.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("metric"), "l_linenumber").agg(F.avg("l_tax").alias("value"))
    return rounded(metrics.fold_means(folds), "mean_value")


@query("load_report", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def load_report(spark, d):
    return metrics.load_report(v.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


@query("profiles_per_noc", sql("SELECT substr(name, 3, 1) || 'p' AS noc, split_part(name, '_', 1) AS prefix, name, count(*) OVER (PARTITION BY split_part(name, '_', 1)) AS n FROM names WHERE regexp_matches(substr(name, 1, 3), '^[0-9][A-F][0-9]$')", NAMES))
def profiles_per_noc(spark, d):
    n = F.col("name")
    return metrics.profiles_per_noc(v.names(spark, d).where(fn.is_rd_sample(n)).select(fn.sample_noc(n).alias("noc"), fn.sample_prefix(n).alias("prefix"), "name"))


# Loading

@query("profiles_with_annotation", sql("SELECT key, name AS stem, 'a' || key::VARCHAR AS annotation FROM names WHERE key % 3 = 0", NAMES))
def profiles_with_annotation(spark, d):
    f = v.names(spark, d).select("key", F.col("name").alias("stem"))
    return loading.profiles_with_annotation(f, f.where("key % 3 = 0").select("stem", F.concat(F.lit("a"), F.col("key").cast("string")).alias("annotation")))


@query("profiles_with_ladder", sql("SELECT key, name AS stem, CASE WHEN key % 3 = 0 AND key % 2 = 1 THEN 'l' || key::VARCHAR END AS ladder_path FROM names", NAMES))
def profiles_with_ladder(spark, d):
    f = v.names(spark, d).select("key", F.col("name").alias("stem"))
    paths = f.where("key % 3 = 0").select("stem", F.when(F.col("key") % 2 == 1, F.concat(F.lit("l"), F.col("key").cast("string"))).alias("ladder_path"))
    return loading.profiles_with_ladder(f, paths).select("key", "stem", "ladder_path")


@query("skip_missing_ladder", sql("SELECT key, 'l' || key::VARCHAR AS ladder_path FROM names WHERE key % 2 = 1", NAMES))
def skip_missing_ladder(spark, d):
    f = v.names(spark, d).select("key", F.when(F.col("key") % 2 == 1, F.concat(F.lit("l"), F.col("key").cast("string"))).alias("ladder_path"))
    return loading.skip_missing_ladder(f)


@query("drop_incomplete_profiles", "SELECT c_custkey AS hid FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT user_id FROM events)")
def drop_incomplete_profiles(spark, d):
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("hid"))
    return loading.drop_incomplete_profiles(c, v.table(spark, d, "events").select(F.col("user_id").alias("hid")), v.table(spark, d, "orders").select(F.col("o_custkey").alias("hid")))


@query("profile_by_name", sql("SELECT key, name AS stem FROM names WHERE name = (SELECT max(name) FROM names)", NAMES))
def profile_by_name(spark, d):
    f = v.names(spark, d).select("key", F.col("name").alias("stem"))
    return loading.profile_by_name(f, f.agg(F.max("stem")).first()[0])


@query("align_predictions", "SELECT d.doc_id AS hid, d.n_chars, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def align_predictions(spark, d):
    return loading.align_predictions(v.table(spark, d, "documents").select(F.col("doc_id").alias("hid"), "n_chars"), v.table(spark, d, "labels").select(F.col("doc_id").alias("hid"), "quality"))


@query("profile_dimensions", sql("SELECT hid, count(DISTINCT dye) AS height, (max(px) + 1)::BIGINT AS width FROM trace GROUP BY hid", TRACE))
def profile_dimensions(spark, d):
    return loading.profile_dimensions(v.trace(spark, d))


@query("validate_image_format", sql("SELECT hid, dye, count(px) = 13 AND count(DISTINCT px) = 13 AND min(px) = 0 AND max(px) = 12 AS ok FROM trace GROUP BY hid, dye", TRACE))
def validate_image_format(spark, d):
    return loading.validate_image_format(v.trace(spark, d), 13)


# Sources

WIDE = "SELECT o_custkey::VARCHAR AS sample, o_orderpriority AS marker, trim(CASE o_orderkey % 3 WHEN 0 THEN 'OL' ELSE o_orderkey::VARCHAR END, 'OB_') AS a0, o_totalprice AS h0, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR || '.3' ELSE '' END AS a1, o_totalprice / 2 AS h1 FROM orders"


@query("read_allele_report", f"SELECT sample, marker, 0 AS k, a0 AS allele, round(h0, 4) AS height FROM ({WIDE}) UNION ALL SELECT sample, marker, 1, a1, round(h1, 4) FROM ({WIDE}) WHERE a1 <> ''")
def read_allele_report(spark, d):
    return files.wide_to_long(wide_report(spark, d)).withColumn("height", F.round("height", 4))


def wide_report(spark, d):
    o = v.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("Sample Name"), F.col("o_orderpriority").alias("Marker"), F.when(k % 3 == 0, "OL").otherwise(k.cast("string")).alias("Allele#1"), F.col("o_totalprice").alias("Height#1"),
        F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".3"))).otherwise("").alias("Allele#2"), (F.col("o_totalprice") / 2).alias("Height#2"),
    )


@query("select_sample_annotation", f"SELECT sample, marker, a1 AS allele FROM ({WIDE}) WHERE a1 <> '' AND sample = '7' UNION ALL SELECT sample, marker, a0 FROM ({WIDE}) WHERE sample = '7'")
def select_sample_annotation(spark, d):
    return files.select_sample_annotation(read_allele_report(spark, d), "7").select("sample", "marker", "allele")


@query("read_annotation_map", sql("SELECT stem, annotation, 'Dataset ' || substr(annotation, 1, 1) || ' DTH_AlleleReport.txt' AS report FROM (SELECT split_part(name, '_', 1) AS stem, name AS annotation, row_number() OVER (PARTITION BY split_part(name, '_', 1) ORDER BY key DESC) AS r FROM names) WHERE r = 1", NAMES))
def read_annotation_map(spark, d):
    rows = v.names(spark, d).select(F.concat(F.split_part("name", F.lit("_"), F.lit(1)), F.lit(".hid")).alias("raw"), F.col("name").alias("annotation"), F.col("key").alias("_i"))
    return files.annotation_map(rows, "DTH")


def packed(spark, d):
    """Every vector as an ABIF file with one entry of 64 signed 16-bit numbers and one inline number."""
    e = v.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int")).alias("n"))
    hex4 = lambda x, n: F.lpad(F.right(F.hex(x.cast("bigint")), F.lit(n)), n, "0")
    lit = lambda x, n: hex4(F.lit(x), n)
    entry = lambda name, tag, kind, size, many, total, place: F.concat(F.hex(F.lit(name)), lit(tag, 8), lit(kind, 4), lit(size, 4), lit(many, 8), lit(total, 8), place, lit(0, 8))
    head = F.concat(F.hex(F.lit("ABIF")), lit(101, 4), F.hex(F.lit("tdir")), lit(1, 8), lit(1023, 4), lit(28, 4), lit(2, 8), lit(56, 8), lit(256, 8), lit(0, 8))
    values = F.array_join(F.transform("n", lambda x: hex4(x, 4)), "")
    body = F.concat(F.rpad(head, 256, "0"), values, entry("DATA", 1, 4, 2, 64, 128, lit(128, 8)), entry("Numb", 7, 5, 4, 1, 4, hex4(F.col("vec_id"), 8)))
    return e.select(F.col("vec_id").alias("hid"), F.unhex(body).alias("content"))


@query("decode_hid_elements", "SELECT vec_id AS hid, i::INT AS i, name, tag::BIGINT AS tag, type::BIGINT AS type, element_size::BIGINT AS element_size, n::BIGINT AS n, data_size::BIGINT AS data_size FROM embeddings, (VALUES (0, 'DATA', 1, 4, 2, 64, 128), (1, 'Numb', 7, 5, 4, 1, 4)) t(i, name, tag, type, element_size, n, data_size)")
def decode_hid_elements(spark, d):
    return abif.decode_hid_elements(packed(spark, d)).select("hid", "i", "name", "tag", "type", "element_size", "n", "data_size")


@query("decode_hid_values", "SELECT vec_id AS hid, (i - 1)::INT AS scan, round(embedding[i]::DOUBLE * 1000)::BIGINT AS value, vec_id AS number FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def decode_hid_values(spark, d):
    values = abif.decode_hid_values(abif.decode_hid_elements(packed(spark, d)))
    return values.groupBy("hid").agg(F.max(F.when(F.col("name") == "Numb", F.col("v_long"))).alias("number"), F.first(F.when(F.col("name") == "DATA", F.col("v_array")), ignorenulls=True).alias("a")).select("hid", "number", F.posexplode("a").alias("scan", "value"))


@query("select_dye_channels", "SELECT (vec_id // 6)::BIGINT AS hid, (vec_id % 6)::INT AS dye, (i - 1)::INT AS scan, round(embedding[i]::DOUBLE * 1000)::BIGINT AS rfu FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id // 6 * 6 + 5 <= (SELECT max(vec_id) FROM embeddings)")
def select_dye_channels(spark, d):
    tags = [1, 2, 3, 4, 106, 205], [9, 10, 11, 12, 206, 205]
    values = abif.decode_hid_values(abif.decode_hid_elements(packed(spark, d))).where("name = 'DATA'")
    file = F.floor(F.col("hid") / 6)
    at = (F.col("hid") % 6 + 1).cast("int")
    tag = F.when(file % 2 == 0, F.element_at(F.array(*map(F.lit, tags[0])), at)).otherwise(F.element_at(F.array(*map(F.lit, tags[1])), at))
    return abif.select_dye_channels(values.select(file.alias("hid"), "name", tag.alias("tag"), "v_array"))


@query("profile_cache", sql("SELECT hid::VARCHAR AS hid, dye, px, rfu FROM trace", TRACE))
def profile_cache(spark, d):
    """Traces written to the cache and read back."""
    t = v.trace(spark, d).withColumn("hid", F.col("hid").cast("string"))
    scale = t.groupBy("hid", "px").agg((F.lit(65.0) + F.col("px")).alias("bp")).select("hid", "px", "bp")
    calls = t.where("rfu > 200").select("hid", F.lit("analyst").alias("source"), F.lit("M").alias("marker"), F.col("px").cast("string").alias("allele"), F.col("rfu").cast("double").alias("height"))
    path = v.scratch(spark, "cache")
    files.write_profile_cache(files.profile_rows(t, scale, t.where("rfu >= 40").select("hid", "dye", "px"), calls), path)
    return big(files.cached_pixels(files.read_profile_cache(spark, path)), "dye", "px", "rfu")


@query("predictions_round_trip", "SELECT user_id::VARCHAR AS hid, event_type AS label, max(value) AS score FROM events GROUP BY 1, 2")
def predictions_round_trip(spark, d):
    scores = v.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    maps = scores.groupBy(F.col("user_id").cast("string").alias("hid")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("classification"))
    path = v.scratch(spark, "predictions")
    files.write_predictions(maps, path)
    return files.read_predictions(spark, path).select("hid", F.explode("classification").alias("label", "score"))


@query("report_round_trip", ORACLES["read_allele_report"])
def report_round_trip(spark, d):
    """The wide report written as files and read again with the sniffed delimiter."""
    path = v.scratch(spark, "report")
    wide_report(spark, d).write.option("header", True).option("sep", "\t").csv(path)
    return files.read_allele_report(spark, path).withColumn("height", F.round("height", 4))


@query("pixel_cache", ORACLES["call_alleles"])
def pixel_cache(spark, d):
    """Alleles called from traces that were written in buckets."""
    t, path = v.trace(spark, d), v.scratch(spark, "pixel-cache")
    scale = t.select("hid", "px").distinct().withColumn("bp", 65.0 + 20.0 * F.col("px"))
    files.write_pixel_cache(t, scale, t.where("rfu >= 40").select("hid", "dye", "px"), path, buckets=8)
    pixels = files.read_pixel_cache(spark, path).withColumn("prob", F.col("mask").cast("double"))
    return annotate.call_alleles(pixels, v.panel(spark, d), digits=6)


MIXED = """wide AS (SELECT o_orderkey AS key, o_custkey::VARCHAR AS sample, o_orderpriority AS marker, o_totalprice AS price, 1 + o_orderkey % 3 AS many FROM orders)"""


@query("read_allele_reports", sql("""SELECT sample, marker, i::INT AS k, key::VARCHAR || '.' || (i + 1)::VARCHAR AS allele, round(price / (i + 1), 4) AS height FROM (SELECT *, unnest(range(0, many)) AS i FROM wide) WHERE (key + i) % 4 <> 0""", MIXED))
def read_allele_reports(spark, d):
    """Reports of one, two and three alleles a row, with commas, semicolons and tabs, in one folder."""
    path, o = v.scratch(spark, "reports"), v.table(spark, d, "orders")
    for many, sep in ((1, ","), (2, ";"), (3, "\t")):
        of = o.where(F.col("o_orderkey") % 3 == many - 1)
        allele = lambda i: F.when((F.col("o_orderkey") + i) % 4 != 0, F.concat(F.lit("OB_"), F.col("o_orderkey").cast("string"), F.lit(f".{i + 1}"))).otherwise("").alias(f"Allele#{i + 1}")
        high = lambda i: (F.col("o_totalprice") / (i + 1)).alias(f"Height#{i + 1}")
        columns = [x for i in range(many) for x in (allele(i), high(i))] if many != 2 else [*map(allele, range(many)), *map(high, range(many))]
        lead = [F.col("o_custkey").cast("string").alias("Sample Name"), F.col("o_orderpriority").alias("Marker")]
        of.select(*lead, *columns).write.option("header", True).option("sep", sep).csv(f"{path}/{many}")
    return files.read_allele_report(spark, path).withColumn("height", F.round("height", 4))


@query("best_ladders_round_trip", sql("SELECT name AS image_path, CASE WHEN key % 3 = 0 THEN 'ladder ' || key::VARCHAR END AS ladder_path FROM names", NAMES))
def best_ladders_round_trip(spark, d):
    path = v.scratch(spark, "ladders")
    files.write_best_ladders(v.names(spark, d).select(F.col("name").alias("image_path"), F.when(F.col("key") % 3 == 0, F.concat(F.lit("ladder "), F.col("key").cast("string"))).alias("ladder_path")), path)
    return files.read_best_ladders(spark, path)


@query("metrics_round_trip", ORACLES["load_report"].replace("AS status", "AS metric").replace("count(*) AS n", "count(*)::DOUBLE AS value"))
def metrics_round_trip(spark, d):
    path = v.scratch(spark, "metrics")
    files.write_metrics(load_report(spark, d).select(F.col("status").alias("metric"), F.col("n").cast("double").alias("value")), path)
    return spark.read.schema("metric string, value double").json(path)


@query("markers_json_round_trip", sql("SELECT marker, count(*)::BIGINT AS alleles, round(sum(base_pair), 3) AS total FROM panel GROUP BY marker", PANEL))
def markers_json_round_trip(spark, d):
    p = v.panel(spark, d)
    allele = F.struct(F.col("allele").alias("name"), "base_pair", F.col("left_off").alias("left_bin"), F.col("right_off").alias("right_bin"), F.lit(None).cast("double").alias("height"))
    marker = p.groupBy(F.col("dye").cast("int").alias("dye"), F.col("marker").alias("name")).agg(F.array_sort(F.collect_list(allele)).alias("alleles"))
    rows = marker.select(F.array(F.struct("dye", "name", "alleles")).alias("markers"))
    back = files.json_to_markers(files.markers_to_json(rows)).select(F.explode("markers").alias("m"))
    return back.select(F.col("m.name").alias("marker"), F.size("m.alleles").cast("bigint").alias("alleles"), F.round(F.aggregate("m.alleles", F.lit(0.0), lambda a, x: a + x["base_pair"]), 3).alias("total"))


FOLDERS = "paths AS (SELECT key, 'file:/data/run%20' || (key % 7)::VARCHAR || '/' || name || '.hid' AS path FROM names)"


@query("scan_profiles", sql("SELECT 'run ' || (key % 7)::VARCHAR AS folder, name || '.hid' AS name, name AS stem FROM names WHERE regexp_matches(substr(name, 1, 3), '^[0-9][A-F][0-9]$')", NAMES))
def scan_profiles(spark, d):
    """The listing of a folder tree with a file for every customer."""
    n = v.names(spark, d)
    listing = n.select(F.concat(F.lit("file:/data/run%20"), (F.col("key") % 7).cast("string"), F.lit("/"), "name", F.lit(".hid")).alias("path"), F.lit(b"ABIF").alias("content"))
    return files.sample_files(listing).select("folder", "name", "stem")


@query("panel_from_contents", sql("SELECT dye, marker, allele, base_pair, left_off, right_off, ord FROM panel", PANEL))
def panel_from_contents(spark, d):
    return big(files.panel_from_contents(spark, v.panel(spark, d)), "dye")


@query("read_panel", sql("SELECT dye, marker, allele, base_pair, left_off, right_off, row_number() OVER (PARTITION BY marker ORDER BY ord) - 1 AS place FROM panel", PANEL))
def read_panel(spark, d):
    """The panel written as XML, a locus for every brand, and read again."""
    kit = {row: index for index, row in DYE_ROWS.items()}
    index = F.element_at(F.create_map(*[F.lit(x) for pair in kit.items() for x in pair]), F.col("dye").cast("int"))
    entry = F.struct("ord", F.col("allele").alias("_Label"), F.col("base_pair").alias("_Size"), F.col("left_off").alias("_Left_Binning"), F.col("right_off").alias("_Right_Binning"))
    loci = v.panel(spark, d).groupBy(index.alias("DyeIndex"), F.col("marker").alias("MarkerTitle")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("ord")).alias("Allele"))  # one kit
    path = v.scratch(spark, "panel")
    loci.write.format("xml").option("rootTag", "Panel").option("rowTag", "Locus").save(path)
    back = files.read_panel(spark, path)
    place = F.row_number().over(Window.partitionBy("marker").orderBy("ord")) - 1
    return big(back.select("dye", "marker", "allele", "base_pair", "left_off", "right_off", place.alias("place")), "dye", "place")


@query("read_ladder_alleles", sql("SELECT dye, row_number() OVER (PARTITION BY dye ORDER BY ord) - 1 AS k, marker, allele FROM panel", PANEL))
def read_ladder_alleles(spark, d):
    """The panel's alleles written as a ladder file, which is one file in order, and read again."""
    path = v.scratch(spark, "ladder-alleles")
    rows = v.panel(spark, d).orderBy("ord").select(F.col("marker").alias("Marker"), F.col("allele").alias("Allele"), F.col("dye").cast("int").alias("Dye"))
    rows.coalesce(1).write.option("header", True).csv(path)
    return big(files.read_ladder_alleles(spark, path), "dye", "k")


@query("read_donor_profiles", f"SELECT ({LETTERS})[p_partkey % 30 + 1] AS donor, p_brand AS marker, p_size::VARCHAR AS allele1, (p_size + 0.3)::VARCHAR AS allele2 FROM part")
def read_donor_profiles(spark, d):
    """The parts written as donor rows and read again; a row's file is named after its donor."""
    size = F.col("p_size").cast("string")
    donor = F.element_at(F.array(*map(F.lit, LETTERS)), (F.col("p_partkey") % 30 + 1).cast("int"))
    path = v.scratch(spark, "donors")
    rows = v.table(spark, d, "part").select(donor.alias("donor"), donor.alias("SampleName"), F.col("p_brand").alias("Marker"), size.alias("Allele1"), F.concat(size, F.lit(".3")).alias("Allele2"))
    rows.write.partitionBy("donor").option("header", True).option("sep", ";").csv(path)
    return files.read_donor_profiles(spark, path)


# Splits


@query("holdout_split", sql("SELECT key, CASE WHEN row_number() OVER (ORDER BY md5('7|' || key), key) <= floor((SELECT count(*) FROM strata) * 0.8e0) THEN 1 ELSE 2 END AS part FROM strata", STRATA))
def holdout_split(spark, d):
    return splits.holdout_split(v.strata(spark, d).select("key"), 0.8, 7, "key")


@query("grouped_holdout_split", sql("SELECT s.key, g.part FROM strata s JOIN (SELECT noc, prefix, CASE WHEN row_number() OVER (PARTITION BY noc ORDER BY md5('7|' || prefix), prefix) <= floor(count(*) OVER (PARTITION BY noc) * 0.8e0) THEN 1 ELSE 2 END AS part FROM (SELECT DISTINCT noc, prefix FROM strata)) g ON g.noc = s.noc AND g.prefix = s.prefix", STRATA))
def grouped_holdout_split(spark, d):
    return splits.grouped_holdout_split(v.strata(spark, d), 0.8, 7).select("key", "part")


@query("kfold_split", sql("SELECT key, (ntile(4) OVER (ORDER BY md5('7|' || key), key) - 1)::BIGINT AS fold FROM strata", STRATA))
def kfold_split(spark, d):
    return splits.kfold_split(v.strata(spark, d).select("key"), 4, 7, "key")


GROUPED = "folds AS (SELECT s.key, g.fold FROM strata s JOIN (SELECT noc, prefix, (ntile(4) OVER (PARTITION BY noc ORDER BY md5('7|' || prefix), prefix) - 1)::BIGINT AS fold FROM (SELECT DISTINCT noc, prefix FROM strata)) g ON g.noc = s.noc AND g.prefix = s.prefix)"


@query("grouped_kfold_split", sql("SELECT * FROM folds", STRATA, GROUPED))
def grouped_kfold_split(spark, d):
    return splits.grouped_kfold_split(v.strata(spark, d), 4, 7).select("key", "fold")


@query("train_test_folds", sql("SELECT key, fold, turn, CASE WHEN turn = fold THEN 'test' ELSE 'train' END AS role FROM folds, (SELECT unnest(range(0, 4)) AS turn)", STRATA, GROUPED))
def train_test_folds(spark, d):
    return splits.train_test_folds(grouped_kfold_split(spark, d), 4)


@query("limit_profiles", sql("SELECT key FROM strata ORDER BY md5('3|' || key), key LIMIT 100", STRATA))
def limit_profiles(spark, d):
    return splits.limit_profiles(v.strata(spark, d).select("key"), 100, "key", seed=3)


@query("fixed_batches", sql("SELECT key, batch FROM (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM (SELECT key, ((row_number() OVER (ORDER BY key) - 1) // 7)::BIGINT AS batch FROM strata)) WHERE n = 7", STRATA))
def fixed_batches(spark, d):
    return splits.fixed_batches(v.strata(spark, d).select("key"), 7, "key", drop_last=True)


SHUFFLED = f"""SELECT noc, prefix, key, list_reduce(list_prepend(struct_pack(x := rank - 1, n := n, a := 0::BIGINT, b := 0::BIGINT), list_transform({[list(k) for k in splits.round_keys(5)]}, lambda k: struct_pack(x := 0::BIGINT, n := 0::BIGINT, a := k[1]::BIGINT, b := k[2]::BIGINT))),
  lambda s, k: struct_pack(x := CASE WHEN (xor({{mixed}}, {{mixed}} >> 15) * 1779033703 % 2147483648 >> 17) % 2 = 1 THEN {{other}} ELSE s.x END, n := s.n, a := 0::BIGINT, b := 0::BIGINT)).x AS place
  FROM (SELECT *, row_number() OVER (ORDER BY key) AS rank, count(*) OVER () AS n FROM strata)"""
_OTHER = "((k.a % s.n - s.x + s.n) % s.n)"
_MIXED = f"(xor(greatest(s.x, {_OTHER}) % 2147483647 + greatest(s.x, {_OTHER}) // 2147483647, k.b) * 1640531527 % 2147483648)"


@query("shuffle_rows", sql(SHUFFLED.replace("{mixed}", _MIXED).replace("{other}", _OTHER), STRATA))
def shuffle_rows(spark, d):
    return splits.shuffle_rows(v.strata(spark, d), "key", 5)


# Model


def measured(spark, d):
    """Pixels with base pairs, a kit whose markers have thresholds, and the calls of the true mask."""
    pixels = v.dense(spark, d).select("hid", "dye", "px", "rfu", "mask").withColumn("bp", 65.0 + F.col("px") * 6.4)
    kit = v.panel(spark, d).withColumn("marker", F.when(F.col("ord") % 2 == 0, "FGA").otherwise("TH01"))
    return pixels, kit, annotate.call_alleles(pixels.withColumn("prob", F.col("mask").cast("double")), kit)


def replicas(pixels: DataFrame) -> DataFrame:
    """hid, noc, prefix: four profiles in a row are replicas."""
    return pixels.select("hid").distinct().select("hid", (F.col("hid") % 3).alias("noc"), (F.col("hid") / 4).cast("bigint").alias("prefix"))


@query("cross_validate")
def cross_validate(spark, d):
    from ..operators import model

    pixels, kit, truth = measured(spark, d)
    folds = splits.grouped_kfold_split(replicas(pixels), 3, 42).select("hid", "fold")
    return model.cross_validate(pixels.join(folds, "hid"), 3, kit, truth)


@query("evaluate")
def evaluate(spark, d):
    from ..operators import model

    pixels, kit, truth = measured(spark, d)
    return model.evaluate(model.fit_pixel_model(pixels), pixels, 0.8, 7, replicas(pixels), kit, truth)


@query("fit_pixel_model")
def fit_pixel_model(spark, d):
    """The weight of each feature."""
    from ..operators import model

    return model.weights(model.fit_pixel_model(v.dense(spark, d).select("hid", "dye", "px", "rfu", "mask")), spark)


@query("model_round_trip")
def model_round_trip(spark, d):
    """The scores of a model that was saved and loaded again."""
    from ..operators import model

    pixels, path = v.dense(spark, d).select("hid", "dye", "px", "rfu", "mask"), v.scratch(spark, "model")
    model.save_model(model.fit_pixel_model(pixels), path)
    return model.predict_pixels(model.load_model(path), pixels)


@query("predict_pixels")
def predict_pixels(spark, d):
    from ..operators import model

    pixels = v.dense(spark, d).select("hid", "dye", "px", "rfu", "mask")
    return model.predict_pixels(model.fit_pixel_model(pixels), pixels)


@query("predict_boosted")
def predict_boosted(spark, d):
    """Scores of boosted trees, fitted on one part of a hold-out by replicas, for the pixels of the other."""
    from ..operators import model

    pixels, kit, _ = measured(spark, d)
    parts = splits.grouped_holdout_split(replicas(pixels), 0.7, 7).select("hid", "part")
    parted = pixels.join(parts, "hid")
    fitted = model.fit_boosted_model(parted.where("part = 1").drop("part"), kit, rounds=10, depth=4)
    return model.predict_boosted(fitted, parted.where("part = 2").drop("part"), kit)
