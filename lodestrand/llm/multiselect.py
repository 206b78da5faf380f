"""Exact percentiles of each group by distributed multi-select, and mergeable summaries.

Every target, one percentile of one group, keeps a range of values that may still hold it. In a
round each partition counts its values in the range below, at and above the target's pivot and
proposes the medians of both sides; the weighted median of the proposals for the side that holds
the target is the next pivot, and the other side is ruled out. Values no target can hold any more
are left out of the table that the next round reads, so all rounds together read about twice the
data. Only one row per partition and target is ever shuffled. A target whose range holds at most
`finish` values is finished by sorting those; with `finish` 0 it is counted to the end.

Percentile p of n values is the value at rank ceil(p * n), with a rank error of 0.

Defined results: NULL, NaN and negative values are no measurements (`measurements`), groups
without any give no row; ties are counted, so they need no order; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut_lineage, drop_cut

PERCENTILES = (0.5, 0.9, 0.95, 0.99)
#: Relative error of the values of a combined summary.
ERROR = 0.01
#: Values a target's range may still hold when they are sorted instead of counted; with 0 all targets are counted to the end.
FINISH = 1000
#: Sets of partitions whose medians are merged before all are.
FAN = 64


def last_writes(metrics: DataFrame, key: tuple[str, ...] = ("request_id", "source"), order: str = "ingest_seq", keep: tuple[str, ...] = ("provider", "pipeline", "latency_s", "ts")) -> DataFrame:
    """One row per key: its last write. Rows that share key and order are settled by their values."""
    last = metrics.groupBy(*key).agg(F.max(F.struct(order, *keep)).alias("last"))
    return last.select(*key, *[F.col("last").getField(c).alias(c) for c in keep])


def measurements(metrics: DataFrame) -> DataFrame:
    """(provider, pipeline, day, value) of each key's last write, cleaned as TESTDATA.md states."""
    value = F.col("latency_s")
    return last_writes(metrics).select(
        F.lower(F.trim("provider")).alias("provider"),
        F.coalesce("pipeline", F.lit("vanilla")).alias("pipeline"),
        F.to_date("ts").alias("day"),
        value.alias("value"),
    ).where(value.isNotNull() & ~F.isnan(value) & (value >= 0))


def _rank(p: Column, n: Column) -> Column:
    """ceil(p * n), without the rounding error of a product that is a whole number."""
    return F.greatest(F.ceil(F.round(p * n, 6)), F.lit(1)).cast("long")


def _weighted_median(proposals: str) -> Column:
    """Of an array of (v, w): the least v with half of all weight at or below it. NULL if empty."""
    # The total is worked out once, outside the walk along the sorted proposals.
    half = f"array(aggregate({proposals}, cast(0 as bigint), (a, x) -> a + x.w) / 2.0)"
    step = "(a, x) -> struct(a.w + x.w as w, if(a.v is null and a.w + x.w >= half, x.v, a.v) as v)"
    return F.expr(f"transform({half}, half -> aggregate(array_sort({proposals}), struct(cast(0 as bigint) as w, cast(null as double) as v), {step}).v)[0]")


def _proposals(median: str, count: str) -> Column:
    """Medians with their weights."""
    return F.collect_list(F.when(F.col(count) > 0, F.struct(F.col(median).alias("v"), F.col(count).alias("w"))))


def _merged(local: DataFrame, keys: tuple[str, ...], counts: tuple[str, ...], medians: dict[str, str]) -> DataFrame:
    """The partitions' counts added up, and the weighted median of their medians by `medians` (median: its count).

    In two steps, by `FAN` sets of partitions first, so that no array grows with all partitions.
    """
    local = local.withColumn("part", F.pmod("part", F.lit(FAN)))
    for by in ((*keys, "part"), keys):
        sums = local.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts], *[_proposals(m, c).alias(m) for m, c in medians.items()])
        local = sums.select(*by, *counts, *[_weighted_median(m).alias(m) for m in medians])
    return local


def _start(rows: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """The targets: rank k among the `left` values between lo and hi, both outside; pivot; found."""
    local = rows.groupBy(F.spark_partition_id().alias("part"), "g").agg(F.count("*").alias("n"), F.percentile_approx("v", 0.5, 500).alias("m"))
    groups = _merged(local, ("g",), ("n",), {"m": "n"}).withColumnRenamed("m", "pivot")
    targets = groups.select("g", "n", "pivot", F.explode(F.array(*[F.lit(float(p)) for p in sorted(set(at))])).alias("p"))
    return targets.select("g", "p", "n", F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"), _rank(F.col("p"), F.col("n")).alias("k"), F.col("n").alias("left"), "pivot", F.lit(None).cast("double").alias("found"))


def _turn(live: DataFrame, state: DataFrame, finish: int) -> DataFrame:
    """The state after one three-way count of the ranges that are still too large to sort."""
    ranges = state.where(F.col("found").isNull() & (F.col("left") > finish)).select("g", "lo", "hi", "pivot").distinct()
    v, pivot = F.col("v"), F.col("pivot")
    inside = live.withColumn("part", F.spark_partition_id()).join(ranges, "g").where((v > F.col("lo")) & (v < F.col("hi")))
    local = inside.groupBy("part", "g", "lo", "hi").agg(
        F.count_if(v < pivot).alias("lt"),
        F.count_if(v == pivot).alias("eq"),
        F.count_if(v > pivot).alias("gt"),
        F.percentile_approx(F.when(v < pivot, v), 0.5, 500).alias("lt_m"),
        F.percentile_approx(F.when(v > pivot, v), 0.5, 500).alias("gt_m"),
    )
    counted = _merged(local, ("g", "lo", "hi"), ("lt", "eq", "gt"), {"lt_m": "lt", "gt_m": "gt"}).withColumnsRenamed({"lt_m": "lt_pivot", "gt_m": "gt_pivot"})
    k = F.col("k")
    side = F.when(F.col("lt").isNull() | F.col("found").isNotNull(), "stay").when(k <= F.col("lt"), "lt").when(k <= F.col("lt") + F.col("eq"), "eq").otherwise("gt")
    on = lambda name, new, old: F.when(F.col("side") == name, new).otherwise(old)
    return state.join(counted, ["g", "lo", "hi"], "left").withColumn("side", side).select(
        "g", "p", "n",
        on("gt", pivot, F.col("lo")).alias("lo"),
        on("lt", pivot, F.col("hi")).alias("hi"),
        on("gt", k - F.col("lt") - F.col("eq"), k).alias("k"),
        on("lt", F.col("lt"), on("gt", F.col("gt"), F.col("left"))).alias("left"),
        on("lt", F.col("lt_pivot"), on("gt", F.col("gt_pivot"), pivot)).alias("pivot"),
        on("eq", pivot, F.col("found")).alias("found"),
    )


def _survivors(live: DataFrame, state: DataFrame) -> DataFrame:
    """The values that lie in the range of any target of their group that is still open."""
    ranges = state.where("found is null").groupBy("g").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    return live.join(ranges, "g").where(F.expr("exists(ranges, r -> v > r.lo and v < r.hi)")).select("g", "v")


def _sorted_out(live: DataFrame, state: DataFrame) -> DataFrame:
    """(g, p, late): the targets whose few remaining values are sorted."""
    small = live.join(state.where("found is null").select("g", "p", "lo", "hi", "k"), "g").where("v > lo and v < hi")
    values = small.groupBy("g", "p", "k", "v").agg(F.count("*").alias("c")).groupBy("g", "p", "k").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("vs"))
    step = "(a, x) -> struct(a.c + x.c as c, if(a.v is null and a.c + x.c >= k, x.v, a.v) as v)"
    return values.select("g", "p", F.expr(f"aggregate(vs, struct(cast(0 as bigint) as c, cast(null as double) as v), {step}).v").alias("late"))


def percentiles(df: DataFrame, groups: tuple[str, ...], value: str = "value", at: tuple[float, ...] = PERCENTILES, finish: int = FINISH) -> DataFrame:
    """(*groups, percentile, value, values): exact; `values` is the group's number of values.

    Infinite values and NaN are left out with NULL. `finish` bounds what one task sorts.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.struct(*groups).alias("g"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    live = cut_lineage(rows)
    state = cut_lineage(_start(live, at))
    held = math.inf
    while True:
        open_ = state.where("found is null").agg(F.count_if(F.col("left") > finish).alias("large"), F.sum("left").alias("left")).first()
        if not open_.large:
            break
        if open_.left < held / 2:  # values that no target can hold any more are left out whenever half are
            if held < math.inf:
                before, live = live, cut_lineage(_survivors(live, state))
                drop_cut(before)
            held = open_.left
        old, state = state, cut_lineage(_turn(live, state, finish))
        drop_cut(old)
    done = state.join(_sorted_out(live, state), ["g", "p"], "left")
    return done.select(*[F.col("g").getField(c).alias(c) for c in groups], F.col("p").alias("percentile"), F.coalesce("found", "late").alias("value"), F.col("n").alias("values"))


def summaries(df: DataFrame, groups: tuple[str, ...], value: str = "value", error: float = ERROR) -> DataFrame:
    """(*groups, bucket, values): counts of values by logarithmic bucket, a mergeable summary.

    Bucket b holds the values in (g^(b-1), g^b], g = (1 + error) / (1 - error); NULL bucket holds
    the values of 0. Adding up the counts of two days or files is the summary of both, exactly.
    """
    base = math.log((1 + error) / (1 - error))
    v = F.col(value)
    return df.where(v >= 0).groupBy(*groups, F.when(v > 0, F.ceil(F.round(F.log(v) / base, 9))).cast("int").alias("bucket")).agg(F.count("*").alias("values"))


def combined(summary: DataFrame, groups: tuple[str, ...], at: tuple[float, ...] = PERCENTILES, error: float = ERROR) -> DataFrame:
    """(*groups, percentile, estimate, values) of added summaries: within `error` of the exact value.

    A group has as many buckets as its values have orders of magnitude times 115 at an error of
    1 %, however many values there are, so one group's buckets are sorted in one array.
    """
    gamma = (1 + error) / (1 - error)
    merged = summary.groupBy(*groups, "bucket").agg(F.sum("values").alias("c"))
    arrays = merged.groupBy(*groups).agg(F.sum("c").alias("values"), F.array_sort(F.collect_list(F.struct(F.coalesce("bucket", F.lit(-(2**31))).alias("b"), "c"))).alias("bs"))
    targets = arrays.select(*groups, "values", "bs", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("percentile")).withColumn("k", _rank(F.col("percentile"), F.col("values")))
    step = "(a, x) -> struct(a.c + x.c as c, if(a.b is null and a.c + x.c >= k, x.b, a.b) as b)"
    bucket = F.expr(f"aggregate(bs, struct(cast(0 as bigint) as c, cast(null as int) as b), {step}).b")
    estimate = F.when(bucket == -(2**31), 0.0).otherwise(2 * F.pow(F.lit(gamma), bucket) / (gamma + 1))
    return targets.select(*groups, "percentile", estimate.alias("estimate"), "values")
