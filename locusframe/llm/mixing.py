"""Mix sources to target weights by Poisson replication.

A source's target rate is (target weight x size of the corpus) / (size of the source), a size being
characters plus one end mark per document. Each document is repeated Poisson(rate) times: the count
is the inverse Poisson distribution at a number that a hash of seed and doc_id gives, so a run can
be repeated exactly and each document's count needs no other document. The copies are dealt out by
another hash, which shuffles them over all partitions and in each of them.

Only DataFrame functions are used. The one join is with the table of sources; it is broadcast when
its counted size is at most ``broadcast_sources`` rows and salted otherwise, so a hot source never
lands in one task.

Defined cases: a null source is the source ''. Null text has no characters. A null doc_id draws as
the doc_id ''. Repeated rows draw the same count. An empty table gives an empty table. A source
without a target weight (or with weight 0) gets no copies. Very long texts and ties need nothing of
their own: a document's count depends on its source and doc_id alone. Other columns pass through,
whatever they are called; columns of the input named copy_no, repetition_rate or shuffle_key are
replaced in the result of ``mix`` and kept in that of ``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered_columns, table, written

SEED = "mix-1"
BROADCAST_SOURCES = 10_000
SALTS = 32
RESULTS = ("copy_no", "repetition_rate", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: mix_source, docs, size. Partial sums come before the shuffle."""
    return docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("mix_source")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce(F.length(text), F.lit(0)).cast("bigint") + 1).alias("size")
    )


def poisson_table(rate: Column) -> Column:
    """Cumulative Poisson probabilities 0..K as an array; beyond K there is less than 2**-52."""
    most = F.ceil(rate + 12.0 * F.sqrt(rate) + 30.0).cast("int")
    logs = F.transform(F.sequence(F.lit(1), most), lambda k: F.ln(rate) - F.ln(k.cast("double")))
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("seen"))

    def step(state: Column, ratio: Column) -> Column:
        log_p = state["log_p"] + ratio
        total = state["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(state["seen"], F.array(total)).alias("seen"))

    return F.when(rate > 0, F.aggregate(logs, start, step)["seen"]).otherwise(F.array(F.lit(2.0)))


def target_rates(sizes: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """mix_source, repetition_rate, thresholds. weights: source -> weight, summing to anything;
    without them a source weighs its size to the power ``temperature``."""
    if weights is not None:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("mix_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    else:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    weighed = sizes.withColumn("weight", weight)
    all_size, all_weight = weighed.agg(F.sum("size").cast("double"), F.sum("weight")).first()  # two numbers
    rate = F.coalesce(F.try_divide(F.col("weight") * F.lit(all_size or 0.0), F.lit(all_weight or 0.0) * F.col("size")), F.lit(0.0))
    return weighed.select("mix_source", rate.alias("repetition_rate")).withColumn("thresholds", poisson_table(F.col("repetition_rate")))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    seed: str = SEED,
    broadcast_sources: int = BROADCAST_SOURCES,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The rows of docs, each repeated by its Poisson count, in shuffled order, with copy_no (from 1),
    repetition_rate (the mean of its source) and shuffle_key (the order of the mixture)."""
    plain, name = numbered_columns(docs)
    copies = replicated(plain, weights, temperature, seed, broadcast_sources, name[doc_id], name[source], name[text])
    kept = [F.col(name[c]).alias(c) for c in docs.columns if c.lower() not in RESULTS]
    return copies.select(*kept, *RESULTS)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The copies with the columns of docs alone."""
    plain, name = numbered_columns(docs)
    return replicated(plain, doc_id=name["doc_id"], source=name["source"], text=name["text"]).select(*plain.columns).toDF(*docs.columns)


def replicated(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    seed: str = SEED,
    broadcast_sources: int = BROADCAST_SOURCES,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """mix() of a table with numbered columns."""
    rates = target_rates(written(source_sizes(docs, source, text), "source-sizes"), weights, temperature)
    keyed = docs.withColumn("mix_source", F.coalesce(F.col(source), F.lit("")))
    if rates.select("mix_source").limit(broadcast_sources + 1).count() <= broadcast_sources:
        joined = keyed.join(F.broadcast(rates), "mix_source")
    else:
        salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(SALTS)).cast("int")
        joined = keyed.withColumn("mix_salt", salt).join(salted, ["mix_source", "mix_salt"]).drop("mix_salt")
    draw = uniform(F.lit(seed), F.col(doc_id))
    count = F.size(F.filter("thresholds", lambda edge: edge <= draw))
    copies = joined.withColumn("copy_no", count).where("copy_no > 0").drop("mix_source", "thresholds")
    copies = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copy_no"))))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("bigint")
    copies = copies.withColumn("shuffle_key", key)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(partitions, "shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0) AS n FROM documents),
s AS (SELECT source, sum(n + 1)::DOUBLE AS size FROM d GROUP BY source),
w AS (SELECT source, size, sqrt(size) AS weight FROM s),
r AS (SELECT source, weight * (SELECT sum(size) FROM s) / ((SELECT sum(weight) FROM w) * size) AS rate FROM w),
p AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS mass
      FROM r, range(0, 400) t(k) WHERE k <= rate + 12 * sqrt(rate) + 30),
c AS (SELECT source, rate, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS edge FROM p),
u AS (SELECT doc_id, source, ('0x' || substr(md5('mix-1|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS x FROM d),
n AS (SELECT u.doc_id, u.source, c.rate, count(*) AS copies FROM u JOIN c ON u.source = c.source AND c.edge <= u.x
      GROUP BY u.doc_id, u.source, c.rate),
e AS (SELECT doc_id, source, rate, unnest(range(1, copies + 1)) AS copy_no FROM n)
SELECT e.doc_id, e.source, e.copy_no::INT AS copy_no, round(e.rate, 6) AS repetition_rate,
       ('0x' || substr(md5('mix-1-order|' || e.doc_id || '|' || e.copy_no), 1, 15))::BIGINT AS shuffle_key,
       md5(documents.text) AS text_md5
FROM e JOIN documents ON documents.doc_id = e.doc_id
"""


def op10_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    """Whole documents mixed with the weights of ``temperature`` 0.5; the digest stands for each copy's text."""
    docs = table(spark, sf_dir, "documents")
    mixture = mix(docs)
    return mixture.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "copy_no", F.round("repetition_rate", 6).alias("repetition_rate"), "shuffle_key", F.md5("text").alias("text_md5"))
