"""File readers and writers: folders, reports, panels, maps, caches, predictions, metrics."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DYE_ROWS
from ..functions.names import is_rd_sample, sample_noc, sample_prefix, strip_ob

PANEL = "dye int, marker string, allele string, base_pair double, left_off double, right_off double, ord bigint"
MARKERS = "array<struct<dye:int,name:string,alleles:array<struct<name:string,base_pair:double,left_bin:double,right_bin:double,height:double>>>>"
PREDICTION = "hid string, classification map<string,double>, image array<array<float>>, meta map<string,string>"


def scan_profiles(spark: SparkSession, root: str, ladders: bool = False) -> DataFrame:
    """path, folder, name, stem and content of the sample files (or ladders) under root. Reading only
    the names reads no bytes."""
    glob = "*[lL][aA][dD][dD][eE][rR]*.hid" if ladders else "[0-9][A-F][0-9]*.hid"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return named_files(files) if ladders else sample_files(files)


def named_files(files: DataFrame) -> DataFrame:
    """path, folder, name, stem and content of listed files (path, content)."""
    # listed paths are escaped as in URLs, where a plus is no blank; a path that is none stays as it is
    path = F.coalesce(F.try_url_decode(F.regexp_replace("path", r"\+", "%2B")), F.col("path"))
    name = F.regexp_extract(path, "([^/]+)$", 1)
    return files.select(path.alias("path"), F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("folder"), name.alias("name"), F.regexp_replace(name, r"\.hid$", "").alias("stem"), "content")


def sample_files(files: DataFrame) -> DataFrame:
    """Those of them that are R&D samples."""
    named = named_files(files)
    return named.where(F.col("name").endswith(".hid") & is_rd_sample(F.col("name")))


def panel_from_contents(spark: SparkSession, rows: list[tuple] | DataFrame | None) -> DataFrame:
    """A panel from rows or from a table with its columns."""
    if rows is None:
        raise ValueError("a panel needs a file or its contents")
    if isinstance(rows, DataFrame):
        return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in (x.split() for x in PANEL.split(", "))])
    return spark.createDataFrame(rows, PANEL)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Loci of a panel file, one row per allele; dye indices outside the kit give a null dye."""
    schema = "DyeIndex int, MarkerTitle string, Allele array<struct<_Label:string,_Size:double,_Left_Binning:double,_Right_Binning:double>>"
    loci = spark.read.format("xml").option("rowTag", "Locus").schema(schema).load(path).withColumn("_l", F.monotonically_increasing_id())
    rows = loci.select("_l", "DyeIndex", F.col("MarkerTitle").alias("marker"), F.posexplode("Allele").alias("_p", "_a"))
    dyes = F.create_map(*[F.lit(x) for pair in DYE_ROWS.items() for x in pair])
    return rows.select(
        F.try_element_at(dyes, F.col("DyeIndex")).alias("dye"), "marker", F.col("_a._Label").alias("allele"), F.col("_a._Size").alias("base_pair"),
        F.col("_a._Left_Binning").alias("left_off"), F.col("_a._Right_Binning").alias("right_off"), (F.col("_l") * 10_000 + F.col("_p")).alias("ord"),
    )


def wide_to_long(report: DataFrame, sample: str = "Sample Name", marker: str = "Marker") -> DataFrame:
    """sample, marker, k, allele, height: Allele* and Height* columns paired in order, empty alleles left out."""
    alleles = [c for c in report.columns if c.strip().startswith("Allele")]
    heights = [c for c in report.columns if c.strip().startswith("Height")]
    pairs = F.array(*[F.struct(F.col(f"`{a}`").cast("string").alias("allele"), F.col(f"`{h}`").try_cast("double").alias("height")) for a, h in zip(alleles, heights)])
    return called(report.select(F.col(f"`{sample}`").alias("sample"), F.col(f"`{marker}`").alias("marker"), F.posexplode(pairs).alias("k", "_p")))


def called(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.trim("_p.allele") != "").select("sample", "marker", "k", strip_ob(F.col("_p.allele")).alias("allele"), F.col("_p.height").alias("height"))


DELIMITERS = ",;\t"


def cells(line: Column, delimiter: str) -> Column:
    """The fields of a line; quoted ones may hold the delimiter and doubled quotes."""
    outside = F.split(line, f'{delimiter}(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r'^\s*"(.*)"\s*$', "$1"), '""', '"')
    return F.when(F.contains(line, F.lit('"')), F.transform(outside, bare)).otherwise(F.split(line, delimiter, -1))


def starting(header: Column, what: str) -> Column:
    """The places (from 0) of the columns whose name starts so, in order."""
    return F.filter(F.transform(header, lambda x, i: F.when(F.trim(x).startswith(what), i)), lambda i: i.isNotNull())


def report_headers(lines: DataFrame) -> DataFrame:
    """Per file (lines: file, block, line, in the order of the file within a block) its first line, the
    delimiter, and where its samples, markers, alleles and heights stand; files without a delimiter under
    which a column after the first starts with Allele are left out."""
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("line", "at").alias("header"))
    bare = F.regexp_replace("header", "^\ufeff", "")
    kinds = [F.struct(F.lit(d).alias("delimiter"), cells(bare, d).alias("names")) for d in DELIMITERS]
    sniffed = first.withColumn("_k", F.get(F.filter(F.array(*kinds), lambda k: F.exists(F.slice(k["names"], 2, 1 << 20), lambda x: F.trim(x).startswith("Allele"))), F.lit(0))).where("_k is not null")
    names = F.col("_k.names")
    named = lambda what, place: F.coalesce(F.get(F.filter(F.transform(names, lambda x, i: F.when(F.trim(x) == what, i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(place))
    return sniffed.select(
        "file", "header", F.col("_k.delimiter").alias("delimiter"), named("Sample Name", 0).alias("_sample"), named("Marker", 1).alias("_marker"),
        F.arrays_zip(starting(names, "Allele").alias("a"), starting(names, "Height").alias("h")).alias("_pairs"),
    )


def read_allele_report(spark: SparkSession, path: str) -> DataFrame | None:
    """sample, marker, k, allele, height of the reports in a file or folder. Every file has its own header:
    delimiter (the first of comma, semicolon and tab that fits), number and order of its columns. Files
    that are empty or no reports are left out; none if no file is left."""
    read = spark.read.option("recursiveFileLookup", True).text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    headers = report_headers(lines)
    if headers.isEmpty():
        return None
    rows = lines.drop("block", "at").join(headers, "file").where("line <> header and trim(line) <> ''")
    split = reduce(lambda made, d: made.when(F.col("delimiter") == d, cells(F.col("line"), d)), DELIMITERS[1:], F.when(F.col("delimiter") == DELIMITERS[0], cells(F.col("line"), DELIMITERS[0])))
    cut = rows.withColumn("_c", split)
    pairs = F.transform(F.filter("_pairs", lambda p: p["a"].isNotNull() & p["h"].isNotNull()), lambda p: F.struct(F.get("_c", p["a"]).alias("allele"), F.get("_c", p["h"]).try_cast("double").alias("height")))
    return called(cut.select(F.get("_c", F.col("_sample")).alias("sample"), F.get("_c", F.col("_marker")).alias("marker"), F.posexplode(pairs).alias("k", "_p")))


def select_sample_annotation(calls: DataFrame, sample: str) -> DataFrame:
    return calls.where(F.col("sample") == sample)


def read_annotation_map(spark: SparkSession, path: str, kind: str = "DTH") -> DataFrame:
    """stem, annotation, report of each raw file; of repeated names the last one counts."""
    if kind not in ("DTH", "DTL"):
        raise ValueError("the type must be DTH or DTL")
    schema = "`Ruwe data naam` string, `2024 naam DTH` string, `2024 naam DTL` string"
    rows = spark.read.schema(schema).option("header", True).csv(path).withColumn("_i", F.monotonically_increasing_id())
    return annotation_map(rows.withColumnRenamed("Ruwe data naam", "raw").withColumnRenamed(f"2024 naam {kind}", "annotation"), kind)


def annotation_map(rows: DataFrame, kind: str) -> DataFrame:
    """rows: raw, annotation, _i (order)."""
    stem = F.regexp_replace("raw", r"\.hid$", "")
    named = rows.where("raw is not null and trim(raw) <> ''").select(stem.alias("stem"), "annotation", F.concat(F.lit("Dataset "), F.substring("annotation", 1, 1), F.lit(f" {kind}_AlleleReport.txt")).alias("report"), "_i")
    return named.groupBy("stem").agg(F.max_by(F.struct("annotation", "report"), "_i").alias("_m")).select("stem", "_m.annotation", "_m.report")


def read_best_ladders(spark: SparkSession, path: str | None) -> DataFrame:
    schema = "image_path string, ladder_path string"
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path).select("image_path", F.nullif("ladder_path", F.lit("")).alias("ladder_path"))


def write_best_ladders(best: DataFrame, path: str) -> None:
    best.select("image_path", F.coalesce("ladder_path", F.lit("")).alias("ladder_path")).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_ladder_alleles(spark: SparkSession, path: str) -> DataFrame:
    """dye, k (place on the dye), marker, allele in file order."""
    from pyspark.sql import Window

    rows = spark.read.schema("Marker string, Allele string, Dye int").option("header", True).csv(path).withColumn("_i", F.monotonically_increasing_id())
    k = F.row_number().over(Window.partitionBy("Dye").orderBy("_i")) - 1
    return rows.select(F.col("Dye").alias("dye"), k.alias("k"), F.col("Marker").alias("marker"), F.col("Allele").alias("allele"))


def read_donor_profiles(spark: SparkSession, path: str) -> DataFrame:
    """donor, marker, allele1, allele2 of all donor files: <donor>.csv, or any files in donor=<donor>."""
    rows = spark.read.schema("SampleName string, Marker string, Allele1 string, Allele2 string").option("header", True).option("sep", ";").option("recursiveFileLookup", True).csv(path)
    donor = F.regexp_extract(F.col("_metadata.file_path"), r"(?:donor=([^/]+)/[^/]+|([^/]+)\.csv)$", 1)
    donor = F.when(donor != "", donor).otherwise(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    return rows.select(donor.alias("donor"), F.col("Marker").alias("marker"), F.col("Allele1").alias("allele1"), F.col("Allele2").alias("allele2"))


def profile_rows(pixels: DataFrame, scaler: DataFrame, mask: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per profile for storage: per dye the values, the mask's pixels, the scaler and the calls."""
    dye = pixels.groupBy("hid", "dye").agg(F.transform(F.array_sort(F.collect_list(F.struct("px", "rfu"))), lambda x: x["rfu"].cast("smallint")).alias("values"))
    set_px = mask.groupBy("hid", "dye").agg(F.array_sort(F.collect_list(F.col("px").cast("int"))).alias("mask"))
    dyes = dye.join(set_px, ["hid", "dye"], "left").groupBy("hid").agg(F.array_sort(F.collect_list(F.struct("dye", "values", F.coalesce("mask", F.array().cast("array<int>")).alias("mask")))).alias("dyes"))
    scale = scaler.groupBy("hid").agg(F.transform(F.array_sort(F.collect_list(F.struct("px", "bp"))), lambda x: x["bp"]).alias("scaler"))
    called = calls.groupBy("hid").agg(F.array_sort(F.collect_list(F.struct("source", "marker", "allele", "height"))).alias("called_alleles"))
    return dyes.join(scale, "hid").join(called, "hid", "left")


def write_profile_cache(profiles: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    profiles.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def read_profile_cache(spark: SparkSession, *paths: str, limit: int | None = None, name: str = "hid") -> DataFrame:
    """The union of caches, with noc and prefix from the name."""
    rows = spark.read.parquet(*paths)
    rows = rows.withColumn("noc", sample_noc(F.col(name))).withColumn("prefix", sample_prefix(F.col(name)))
    return rows.limit(limit) if limit is not None else rows


def cached_pixels(profiles: DataFrame) -> DataFrame:
    dyes = profiles.select("hid", F.explode("dyes").alias("d"))
    return dyes.select("hid", "d.dye", F.posexplode("d.values").alias("px", "rfu"))


TRACE = ["hid", "dye"]


def write_pixel_cache(pixels: DataFrame, scaler: DataFrame, mask: DataFrame, path: str, buckets: int = 64) -> None:
    """hid, dye, px, rfu, bp and mask of every pixel, in buckets by (hid, dye), one sorted file each: windows
    along traces and joins on (hid, dye) read it without a shuffle. The layout is kept beside the data."""
    spark = pixels.sparkSession
    rows = pixels.join(scaler, ["hid", "px"]).join(mask.withColumn("mask", F.lit(True)), [*TRACE, "px"], "left").select(*TRACE, "px", "rfu", "bp", F.coalesce("mask", F.lit(False)).alias("mask"))
    name = f"pixel_cache_{uuid.uuid4().hex}"
    rows.repartition(buckets, *TRACE).write.format("parquet").mode("overwrite").bucketBy(buckets, *TRACE).sortBy(*TRACE, "px").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: readers register them for themselves
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    spark.createDataFrame([(buckets, columns)], "buckets int, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")


def read_pixel_cache(spark: SparkSession, path: str) -> DataFrame:
    """What write_pixel_cache wrote, with its buckets."""
    layout = spark.read.schema("buckets int, columns string").json(f"{path}/_layout").first()
    name = f"pixel_cache_{hashlib.md5(path.encode()).hexdigest()}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({layout['columns']}) USING parquet CLUSTERED BY ({', '.join(TRACE)}) SORTED BY ({', '.join(TRACE)}, px) INTO {layout['buckets']} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """metric, value rows as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def markers_to_json(markers: DataFrame, column: str = "markers") -> DataFrame:
    return markers.withColumn(column, F.to_json(column))


def json_to_markers(rows: DataFrame, column: str = "markers") -> DataFrame:
    return rows.withColumn(column, F.from_json(column, MARKERS))
