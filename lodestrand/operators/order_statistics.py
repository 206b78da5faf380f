"""Exact order statistics of groups of any size, without gathering a group in one task.

Equal values are counted together first. A histogram over monotone buckets, at most a few
thousand per group, tells in which bucket a wanted rank lies; that bucket is parted evenly, and
only the values of the part that holds the rank are then put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut_lineage

#: Even parts of the bucket that holds a rank.
PARTS = 4096

Rank = Callable[[Column], Column]


def nearest_rank(percent: float) -> Rank:
    """Rounded half up: the 10th of 11 values at 95."""
    return lambda n: F.greatest(F.floor(F.lit(percent) / 100 * n + 0.5), F.lit(1))


def floor_rank(share: float) -> Rank:
    """The value behind floor(share * n) others."""
    return lambda n: F.floor(n * share) + 1


def even_rank(percent: float) -> Rank:
    """Rounded half to even, kept between the first and the last value."""
    return lambda n: F.greatest(F.least(F.bround(F.lit(percent) / 100 * n), n), F.lit(1))


#: The two values whose mean is the interpolated median.
MEDIAN_LOW: Rank = lambda n: F.floor((n + 1) / 2)
MEDIAN_HIGH: Rank = lambda n: F.floor(n / 2) + 1


def values_at(df: DataFrame, keys: tuple[str, ...], value: str, ranks: dict[str, Rank]) -> DataFrame:
    """(*keys, n, *ranks): the value at each rank among a group's values; NULL and NaN don't count."""
    v = F.col(value).cast("double")
    rows = df.select(F.struct(*keys).alias("k"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    sign = F.when(F.col("v") < 0, -1).otherwise(1)
    # Read by each of the steps below, so it is worked out once.
    counted = cut_lineage(rows.groupBy("k", "v").agg(F.count("*").alias("c")).withColumn("b", sign * F.floor(F.log1p(F.abs("v")) * 64)))
    by_key = Window.partitionBy("k")
    buckets = counted.groupBy("k", "b").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    buckets = buckets.withColumns({"upto": F.sum("c").over(by_key.orderBy("b")), "n": F.sum("c").over(by_key)})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("r")) for name, rank in ranks.items()]))
    hit = buckets.select("k", "b", "lo", "hi", "n", "c", "upto", wanted.alias("w")).where("w.r > upto - c and w.r <= upto").select("k", "b", "lo", "hi", "n", "w.name", (F.col("w.r") - F.col("upto") + F.col("c")).alias("r"))
    # The bucket that is hit is parted once more, evenly, and only one of its parts is put in order.
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))).otherwise(0)
    inside = counted.join(hit, ["k", "b"]).withColumn("part", part)
    parts = inside.groupBy("k", "name", "r", "part").agg(F.sum("c").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("k", "name").orderBy("part")))
    narrow = parts.where("r > upto - c and r <= upto").select("k", "name", "part", (F.col("r") - F.col("upto") + F.col("c")).alias("r"))
    last = inside.drop("r").join(narrow, ["k", "name", "part"]).withColumn("upto", F.sum("c").over(Window.partitionBy("k", "name").orderBy("v")))
    found = last.where("upto >= r").groupBy("k", "n", "name").agg(F.min("v").alias("v"))
    wide = found.groupBy("k", "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return wide.select(*[F.col("k").getField(c).alias(c) for c in keys], "n", *ranks)
