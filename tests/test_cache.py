"""The bucketed cache of pixels."""

from pyspark.sql import functions as F

from locusframe.operators import annotate
from locusframe.plans import views as v
from locusframe.sources import files


def test_windows_read_the_cache_without_a_shuffle(spark, sf, tmp_path):
    trace = v.trace(spark, sf)
    scale = trace.select("hid", "px").distinct().withColumn("bp", 65.0 + F.col("px"))
    mask = trace.where("rfu >= 40").select("hid", "dye", "px")
    path = str(tmp_path / "it's a cache")
    files.write_pixel_cache(trace, scale, mask, path, buckets=4)
    cached = files.read_pixel_cache(spark, path)
    got = sorted(map(tuple, cached.collect()))
    assert got == sorted((r["hid"], r["dye"], r["px"], r["rfu"], 65.0 + r["px"], r["rfu"] >= 40) for r in trace.collect())
    called = annotate.call_alleles(cached.withColumn("prob", F.col("mask").cast("double")), v.panel(spark, sf))
    plan = called._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window [row_number()") :]  # the one over pixels
    assert "Exchange" not in below[: below.index("FileScan")] and "Bucketed: true" in below
    files.write_pixel_cache(trace.where("hid < 20"), scale, mask, path, buckets=3)  # overwritten, with other buckets
    assert files.read_pixel_cache(spark.newSession(), path).count() == trace.where("hid < 20").count()
