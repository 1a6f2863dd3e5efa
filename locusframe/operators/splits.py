"""Seeded splits and batches. Order comes from md5(seed|id), so membership is the same anywhere.

Global ranks are taken over profiles or prefixes, never over pixels, by a distributed sort (range
partitions and their sizes), which no stratum and no single task has to hold.
"""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def seeded(seed: int | str, *ids: str) -> list[Column]:
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids])), *map(F.col, ids)]


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in a global order, without one task sorting all of them: a range
    partitioned sort, the partitions' sizes, and the place within the partition. The rows are written
    with their partition, so both reads see the same one."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(rows.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = ordered.withColumn("_within", within)
    sizes = placed.groupBy("_part").agg(F.max("_within").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return placed.join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_within")).cast("bigint")).drop("_part", "_within", "_start")


def check_fraction(fraction: float) -> None:
    if not 0 < fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")


def holdout_split(rows: DataFrame, fraction: float, seed: int | str, key: str) -> DataFrame:
    """rows with part: 1 for the first floor(n * fraction) in seeded order, else 2."""
    check_fraction(fraction)
    n = rows.count()
    return ranked(rows, seeded(seed, key), "_rank").withColumn("part", F.when(F.col("_rank") <= int(n * fraction), 1).otherwise(2)).drop("_rank")


def grouped_holdout_split(rows: DataFrame, fraction: float, seed: int | str, stratum: str = "noc", group: str = "prefix") -> DataFrame:
    """Groups (replicas) stay together; each stratum gives the first floor(m * fraction) of its groups to part 1."""
    check_fraction(fraction)
    rank, many = F.col("_rank"), F.col("_many")
    parts = ranked_groups(rows, seed, stratum, group).select(stratum, group, F.when(rank <= F.floor(many * fraction), 1).otherwise(2).alias("part"))
    return rows.join(parts, [stratum, group])


def ranked_groups(rows: DataFrame, seed: int | str, stratum: str, group: str) -> DataFrame:
    """The distinct groups of each stratum with _rank (from 1, in seeded order) and _many, their number there."""
    placed = ranked(rows.select(stratum, group).distinct(), [F.col(stratum), *seeded(seed, group)], "_place")
    strata = placed.groupBy(stratum).agg(F.count(F.lit(1)).alias("_many"), (F.min("_place") - 1).alias("_before"))
    return placed.join(strata, stratum).select(stratum, group, (F.col("_place") - F.col("_before")).alias("_rank"), "_many")


def fold_of(at: Column, many: Column, k: int) -> Column:
    """The fold of place at (from 0) when ``many`` places are dealt to k folds, larger ones first."""
    small, rest = F.floor(many / k), many % k
    edge = rest * (small + 1)
    return F.when(at < edge, F.floor(at / (small + 1))).otherwise(rest + F.floor((at - edge) / F.greatest(small, F.lit(1)))).cast("bigint")


def kfold_split(rows: DataFrame, k: int, seed: int | str, key: str) -> DataFrame:
    """rows with fold 0 .. k-1 of floor(n / k) rows each, the remainder one each to the first folds."""
    n = rows.count()
    if n < k:
        raise ValueError("fewer rows than folds")
    return ranked(rows, seeded(seed, key), "_rank").withColumn("fold", fold_of(F.col("_rank") - 1, F.lit(n), k)).drop("_rank")


def grouped_kfold_split(rows: DataFrame, k: int, seed: int | str, stratum: str = "noc", group: str = "prefix") -> DataFrame:
    folds = ranked_groups(rows, seed, stratum, group).select(stratum, group, fold_of(F.col("_rank") - 1, F.col("_many"), k).alias("fold"))
    return rows.join(folds, [stratum, group])


def train_test_folds(folded: DataFrame, k: int) -> DataFrame:
    """Each row once per fold with its role in it."""
    turns = folded.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")))
    return turns.withColumn("role", F.when(F.col("turn") == F.col("fold"), "test").otherwise("train"))


ROUNDS = 64
_WORD = (1 << 31) - 1


def round_keys(seed: int | str, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two numbers for each round of a shuffle, below 2**61 and 2**31."""
    digests = [hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i in range(rounds)]
    return [(int(d[:15], 16), int(d[16:24], 16) & _WORD) for d in digests]


def permuted(place: Column, n: Column, keys: list[tuple[int, int]]) -> Column:
    """A seeded bijection of 0 .. n - 1, for any n: a round pairs each place with another one (which pairs it
    with the first in turn) and swaps the two or not, by a bit of a hash of the larger. With the keys in
    reverse order it is undone."""
    rounds = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in keys])

    def swap(x: Column, key: Column) -> Column:
        other = F.pmod(F.pmod(key["a"], n) - x, n)
        top = F.greatest(x, other)
        mixed = ((top % _WORD + F.floor(top / _WORD)).bitwiseXOR(key["b"]) * F.lit(1_640_531_527)) % (1 << 31)
        mixed = (mixed.bitwiseXOR(F.shiftright(mixed, 15)) * F.lit(1_779_033_703)) % (1 << 31)
        return F.when(F.shiftright(mixed, 17) % 2 == 1, other).otherwise(x)

    return F.aggregate(rounds, place.cast("bigint"), swap)


def shuffle_rows(rows: DataFrame, key: str | list[str], seed: int | str | None = None) -> DataFrame:
    """rows with place, 0 .. n - 1 in random order: a bijection of the ranks by key, so the order depends on
    the keys and the seed alone, never on partitions. Order by place, or take a page of it by a filter; rows
    with equal keys share their places in any order. Without a seed one is drawn."""
    keys = round_keys(random.SystemRandom().getrandbits(60) if seed is None else seed)
    placed = ranked(rows, [F.col(c) for c in ([key] if isinstance(key, str) else key)], "_rank")
    n = rows.agg(F.count(F.lit(1))).first()[0]
    return placed.withColumn("place", permuted(F.col("_rank") - 1, F.lit(n).cast("bigint"), keys)).drop("_rank")


def rank_of_place(place: Column, n: int, seed: int | str) -> Column:
    """The rank by key (from 0) of the row that shuffle_rows put at place."""
    return permuted(place, F.lit(n).cast("bigint"), round_keys(seed)[::-1])


def limit_profiles(rows: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """The first n by key, or n in seeded order."""
    return rows.orderBy(*([F.col(key)] if seed is None else seeded(seed, key))).limit(n)


def fixed_batches(rows: DataFrame, size: int, key: str, drop_last: bool = False) -> DataFrame:
    """rows with batch 0, 1, ...; a last batch that is short can be dropped."""
    batched = ranked(rows, [F.col(key)], "_rank").withColumn("batch", F.floor((F.col("_rank") - 1) / size))
    if drop_last:
        whole = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).select("batch")
        batched = batched.join(whole, "batch", "left_semi")
    return batched.drop("_rank")
