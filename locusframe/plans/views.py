"""The profile tables, made from the driver's tables; and the same tables as SQL.

trace: hid = user, dye = event type, px = place in time, rfu = whole part of the value.
dense: hid = five vectors, dye = vector within them, px = position, rfu, prob and mask from the entry.
panel: one allele per part. calls: line items as truth (not returned 'N') and prediction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import STANDARD_BPS
from ..functions.names import sigmoid
from ..operators.signal import spread
from ..sources.scratch import scratch_path as scratch  # noqa: F401

TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    px = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("bigint") - 1
    dye = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    return events.select(F.col("user_id").alias("hid"), dye.cast("bigint").alias("dye"), px.alias("px"), F.floor("value").alias("rfu"))


TRACE = """trace AS (SELECT user_id AS hid, (list_position(['click','error','purchase','signup','view'], event_type) - 1)::BIGINT AS dye,
  (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1)::BIGINT AS px, floor(value)::BIGINT AS rfu FROM events)"""


def dense(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    # a profile's vectors lie together before they become pixels, and stay so for all windows, joins and groups by profile
    placed = spread(vectors.select(F.floor(F.col("vec_id") / 5).alias("hid"), (F.col("vec_id") % 5).alias("dye"), "embedding"), "hid", rows=64 * vectors.count())
    long = placed.select("hid", "dye", F.posexplode("embedding").alias("px", "e"))
    wide = long.select("hid", "dye", F.col("px").cast("bigint").alias("px"), F.col("e").cast("double").alias("e"))
    w = Window.partitionBy("hid", "dye").orderBy("px")
    mean = (F.coalesce(F.lag("e").over(w), F.lit(0.0)) + F.col("e") + F.coalesce(F.lead("e").over(w), F.lit(0.0))) / 3
    return wide.select("hid", "dye", "px", F.round(F.col("e") * 1000).cast("bigint").alias("rfu"), F.round(sigmoid(mean * 10), 6).alias("prob"), (F.col("e") > 0.1).alias("mask"))


DENSE = """flat AS (SELECT (vec_id // 5)::BIGINT AS hid, (vec_id % 5)::BIGINT AS dye, (u.i - 1)::BIGINT AS px, embedding[u.i]::DOUBLE AS e
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u),
  dense AS (SELECT hid, dye, px, round(e * 1000)::BIGINT AS rfu, round(1e0 / (1e0 + exp(-((coalesce(lag(e) OVER w, 0e0) + e + coalesce(lead(e) OVER w, 0e0)) / 3e0 * 10e0))), 6) AS prob,
    e > 0.1e0 AS mask FROM flat WINDOW w AS (PARTITION BY hid, dye ORDER BY px))"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    dye = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint") % 5
    bp = F.round(F.lit(65.0) + (F.col("p_retailprice") - 900.0) * 4.1, 6)
    return part.select(dye.alias("dye"), F.col("p_brand").alias("marker"), F.col("p_partkey").cast("string").alias("allele"), bp.alias("base_pair"), F.lit(0.5).alias("left_off"), F.lit(0.75).alias("right_off"), F.col("p_partkey").alias("ord"))


PANEL = """panel AS (SELECT (regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT % 5) AS dye, p_brand AS marker, p_partkey::VARCHAR AS allele,
  round(65e0 + (p_retailprice - 900e0) * 4.1e0, 6) AS base_pair, 0.5e0 AS left_off, 0.75e0 AS right_off, p_partkey AS ord FROM part)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """hid, marker, allele, height, truth, predicted: one row per distinct hid, marker and allele."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
    parts = table(spark, d, "part").select("p_partkey", "p_brand").hint("shuffle_hash")
    named = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("hid"), F.col("p_brand").alias("marker"), F.col("l_partkey").cast("string").alias("allele"),
        F.col("l_quantity").alias("height"), (F.col("l_returnflag") != "N").alias("truth"), (F.col("l_discount") >= 0.05).alias("predicted"),
    )
    # nothing is aggregated before the rows of an order are together: hardly any are equal, and a task's map of them grows with the input
    return spread(named, "hid", rows=items.count()).groupBy("hid", "marker", "allele").agg(F.max("height").alias("height"), F.bool_or("truth").alias("truth"), F.bool_or("predicted").alias("predicted"))


CALLS = """calls AS (SELECT l_orderkey AS hid, p_brand AS marker, l_partkey::VARCHAR AS allele, max(l_quantity) AS height, bool_or(l_returnflag <> 'N') AS truth,
  bool_or(l_discount >= 0.05e0) AS predicted FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def names(spark: SparkSession, d: str) -> DataFrame:
    """key, name of every customer: some of them R&D names, some not, some controls."""
    k = F.col("c_custkey")
    made = F.concat((k % 7 + 1).cast("string"), F.chr(65 + k % 8), (k % 4 + 2).cast("string"), F.lit("_A01_"), k.cast("string"))
    name = F.when(k % 11 == 0, F.concat(F.lit("Ladder_"), made)).when(k % 13 == 0, F.concat(F.lit("blanco_"), made)).when(k % 17 == 0, F.concat(F.lit("A_ladder_ppy23_"), made)).otherwise(made)
    return table(spark, d, "customer").select(k.alias("key"), name.alias("name"))


NAMES = """names AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 11 = 0 THEN 'Ladder_' || made WHEN c_custkey % 13 = 0 THEN 'blanco_' || made WHEN c_custkey % 17 = 0 THEN 'A_ladder_ppy23_' || made ELSE made END AS name
  FROM (SELECT c_custkey, (c_custkey % 7 + 1)::VARCHAR || chr((65 + c_custkey % 8)::INT) || (c_custkey % 4 + 2)::VARCHAR || '_A01_' || c_custkey::VARCHAR AS made FROM customer))"""


def knots(spark: SparkSession, d: str) -> DataFrame:
    """hid, scan, bp: a size standard per supplier, 9 to 11 scans a base pair, some of them out of range."""
    k = F.col("s_suppkey")
    pace = F.when(k % 10 == 7, 14).otherwise(8 + k % 4)
    rows = table(spark, d, "supplier").select(k.alias("hid"), pace.alias("pace"), F.explode(F.array(*map(F.lit, STANDARD_BPS))).alias("b"))
    return rows.select("hid", (3000 + (F.col("b") - 65) * F.col("pace") + (F.col("hid") * F.col("b")) % 7).cast("bigint").alias("scan"), F.col("b").cast("double").alias("bp"))


KNOTS = f"""knots AS (SELECT hid, (3000 + (b - 65) * pace + (hid * b) % 7)::BIGINT AS scan, b::DOUBLE AS bp FROM (SELECT s_suppkey AS hid, CASE WHEN s_suppkey % 10 = 7 THEN 14 ELSE 8 + s_suppkey % 4 END AS pace,
  unnest({STANDARD_BPS}) AS b FROM supplier))"""


def strata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("noc"), F.concat_ws("-", "source", "lang").alias("prefix"), F.col("doc_id").alias("key"))


STRATA = "strata AS (SELECT lang AS noc, concat_ws('-', source, lang) AS prefix, doc_id AS key FROM documents)"


def sql(select: str, *views: str) -> str:
    """A query over the given views; views: TRACE and the like, or further WITH entries."""
    return "WITH " + ",\n".join(views) + "\n" + select


def stacked(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Raw files of suppliers


def kit(spark: SparkSession, d: str) -> DataFrame:
    """A kit of one allele per nation, five on each dye."""
    n = F.col("n_nationkey").cast("bigint")
    dye, k = n % 5, F.floor(n / 5)
    return table(spark, d, "nation").select(
        dye.alias("dye"), F.concat(F.lit("M"), dye.cast("string")).alias("marker"), (k + 10).cast("string").alias("allele"), (100.0 + 60 * k + 7 * dye).cast("double").alias("base_pair"),
        F.lit(0.6).alias("left_off"), F.lit(0.6).alias("right_off"), n.alias("ord"),
    )


KIT = """kit AS (SELECT n % 5 AS dye, n // 5 AS k, 'M' || (n % 5)::VARCHAR AS marker, (n // 5 + 10)::VARCHAR AS allele, 100e0 + 60 * (n // 5) + 7 * (n % 5) AS base_pair, n AS ord FROM (SELECT n_nationkey::BIGINT AS n FROM nation))"""

#: A peak of a dye, 31 scans wide, and of the size standard, three scans wide.
PEAK = [1000 - 60 * abs(i - 15) for i in range(31)]
SPIKE = [100, 900, 100]


def channel(centres, shape: list[int], base: int, length):
    """Hex digits of big-endian 16-bit values: ``shape`` around each of the sorted centres, ``base`` elsewhere."""
    digits = "".join(f"{x:04X}" for x in shape)
    reach, gap = len(shape) // 2, lambda n: F.repeat(F.lit(f"{base:04X}"), n.cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("made"))
    whole = F.aggregate(centres, start, lambda acc, c: F.struct((c + reach + 1).cast("bigint").alias("at"), F.concat(acc["made"], gap(c - reach - acc["at"]), F.lit(digits)).alias("made")))
    return F.concat(whole["made"], gap(length - whole["at"]))


def files(spark: SparkSession, d: str) -> DataFrame:
    """hid, ladder, path, name, stem, content: the raw file of every supplier, and the ladder of every fifth.

    A file has its supplier's size standard and a peak for alleles of the kit, moved by 0.4 base pairs for
    each of hid % 3: a profile for those with (2 hid + ord) % 5 <> 0, a ladder for those that ladders have (k
    <> 2), but one on dye 0 is missing where hid % 4 = 0. Profiles of hid % 13 = 2 are no ABIF files, those of
    hid % 13 = 3 lack a channel."""
    s = spread(knots(spark, d), "hid").groupBy("hid").agg(F.sort_array(F.collect_list("scan")).alias("scans"), (F.max("scan") + 250).alias("length"), F.min("scan").alias("first"))
    pace = F.when(F.col("hid") % 10 == 7, 14).otherwise(8 + F.col("hid") % 4)
    both = s.withColumn("pace", pace).withColumn("ladder", F.explode(F.when(F.col("hid") % 5 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    alleles = kit(spark, d).agg(F.collect_list(F.struct("dye", "ord", "base_pair")).alias("alleles"))
    one = both.withColumn("_one", F.lit(0)).join(F.broadcast(alleles.withColumn("_one", F.lit(0))), "_one")  # one row of 25 alleles
    centre = lambda a: F.floor(3000 + (a["base_pair"] + 0.4 * (F.col("hid") % 3) - 65) * F.col("pace") + 3)
    k = lambda a: F.floor(a["ord"] / 5)
    missing = lambda a: (F.col("hid") % 4 == 0) & (a["ord"] == 0)
    there = lambda a: F.when(F.col("ladder"), (k(a) != 2) & ~missing(a)).otherwise((2 * F.col("hid") + a["ord"]) % 5 != 0)
    centres = lambda dye: F.array_sort(F.transform(F.filter("alleles", lambda a: (a["dye"] == dye) & there(a)), centre))
    tops = F.concat(F.array(F.col("first") - 150), "scans", F.array(F.element_at("scans", -1) + 200))
    data = [*[channel(centres(i), PEAK, 5, F.col("length")) for i in range(5)], channel(tops, SPIKE, 0, F.col("length"))]
    hex_of = lambda x, n: F.lpad(F.hex(x.cast("bigint")), n, "0")
    lit = lambda x, n: F.lit(f"{x:0{2 * n}X}")
    size = 2 * F.col("length")
    entry = lambda i, tag: F.concat(F.hex(F.lit("DATA")), lit(tag, 4), lit(4, 2), lit(2, 2), hex_of(F.col("length"), 8), hex_of(size, 8), hex_of(128 + i * size, 8), lit(0, 4))
    lacks = ~F.col("ladder") & (F.col("hid") % 13 == 3)
    tags = [F.when(lacks, entry(i, 7)).otherwise(entry(i, tag)) if tag == 4 else entry(i, tag) for i, tag in enumerate((1, 2, 3, 4, 106, 205))]
    head = F.concat(F.hex(F.lit("ABIF")), lit(101, 2), F.hex(F.lit("tdir")), lit(1, 4), lit(1023, 2), lit(28, 2), lit(6, 4), lit(168, 4), hex_of(128 + 6 * size, 8), lit(0, 4))
    content = F.when(~F.col("ladder") & (F.col("hid") % 13 == 2), F.lit("00")).otherwise(F.concat(F.rpad(head, 256, "0"), *data, *tags))
    name = F.concat(F.when(F.col("ladder"), "Ladder_").otherwise(""), F.col("hid").cast("string"), F.lit(".hid"))
    path = F.concat(F.lit("runs/"), (F.col("hid") % 4).cast("string"), F.lit("/"), name)
    return one.select("hid", "ladder", path.alias("path"), name.alias("name"), F.col("hid").cast("string").alias("stem"), F.unhex(content).alias("content"))


#: What becomes of each profile's file; its calls are those of the kit with (hid + ord) % 3 <> 0.
FILES = """files AS (SELECT s_suppkey AS hid, CASE WHEN s_suppkey % 13 = 1 THEN 'no annotation' WHEN s_suppkey % 13 = 2 THEN 'not ABIF' WHEN s_suppkey % 13 = 3 THEN 'channels missing'
  WHEN s_suppkey % 10 = 7 THEN 'standard invalid' WHEN s_suppkey % 13 = 4 THEN 'no calls' ELSE 'kept' END AS status FROM supplier)"""
