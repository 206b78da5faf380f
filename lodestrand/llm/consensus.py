"""Consensus of several annotators: iteratively reweighted voting with leave-one-out accuracy.

Votes are grouped once: a row of the working table has the raters and scores of one item, and an
item that very many raters scored has several rows of a bounded number of votes. A round reads
that table, takes every vote's own weight out of its item's totals to get the consensus of the
others, and adds up each rater's accuracy against it within each batch, so that only a few
numbers for each rater are shuffled. The accuracy over chance is the rater's next weight. Rounds
go on until no weight moves; steps get shorter where weights swing, so that this comes about.

A rater's accuracy in a dimension is graded: 1 less the squared distance of a score from the
others' consensus as a share of the largest possible, after taking out how much stricter or more
lenient the rater is on all other items (leave-one-out), and smoothed towards chance, which is
the same for scores drawn at random from the rater's own and the others' consensus from its own.

Defined results: labelers are trimmed and lower-cased, an empty or NULL labeler or item is left
out; a score that is NULL or outside 1..5 is no vote; exact repeats count once and of several
scores by one rater for one item the most frequent holds, ties going to the lowest; an item with
one rater gets that rater's score and says nothing about the rater; a consensus tie goes to the
lowest score; an empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import cut_lineage, drop_cut, gathered

DIMENSIONS = ("faithfulness", "relevance", "citation_accuracy")
SCORES = (1, 2, 3, 4, 5)
#: Pseudo-votes by which an accuracy is drawn to chance.
SMOOTHING = 4.0
FLOOR = 0.01
#: Votes of one item in one row of the working table.
ROW = 64
#: Raters whose weights are sent to the tasks; beyond it they are joined to the votes.
MOST_RATERS = 1_000_000

Names = tuple[str, ...]


def ballots(labels: DataFrame, item: str = "example_id", rater: str = "labeler", dimensions: Names = DIMENSIONS) -> DataFrame:
    """(item, rater, s): a rater's scores of an item by dimension, 0 where there is none."""
    raw = F.array(*[F.col(d).cast("int") for d in dimensions])
    rows = labels.select(F.col(item).alias("item"), F.lower(F.trim(rater)).alias("rater"), raw.alias("raw")).where("item is not null and rater <> ''").distinct()
    counts = [F.array(*[F.count_if(F.col("raw")[i] == s).alias(f"c{i}{s}") for s in SCORES]).alias(f"n{i}") for i in range(len(dimensions))]

    def usual(counted: str) -> Column:
        return F.when(F.array_max(counted) > 0, F.array_position(counted, F.array_max(counted)).cast("int")).otherwise(0)

    return rows.groupBy("item", "rater").agg(*counts).select("item", "rater", F.array(*[usual(f"n{i}") for i in range(len(dimensions))]).alias("s"))


def votes(labels: DataFrame, item: str = "example_id", rater: str = "labeler", dimensions: Names = DIMENSIONS) -> DataFrame:
    """(item, rater, dimension, score): one valid score each."""
    names = F.array(*map(F.lit, dimensions))
    long = ballots(labels, item, rater, dimensions).select("item", "rater", F.posexplode("s").alias("at", "score")).where("score > 0")
    return long.select("item", "rater", F.element_at(names, F.col("at") + 1).alias("dimension"), "score")


def grouped(cast: DataFrame, row: int = ROW) -> DataFrame:
    """(item, part, many, r, s): the raters, by a hash of their names, and scores of an item, about `row` in a row at most."""
    keyed = cast.withColumn("r", F.xxhash64("rater"))
    many = keyed.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") > row)
    placed = keyed.join(many, "item", "left").withColumn("part", F.when(F.col("n").isNull(), 0).otherwise(F.pmod("r", F.ceil(F.col("n") / row))))
    rows = placed.groupBy("item", "part").agg(F.collect_list(F.struct("r", "s")).alias("v"), F.first("n").isNotNull().alias("many"))
    return rows.select("item", "part", "many", F.col("v.r").alias("r"), F.flatten("v.s").alias("s"))


def _with_weights(rows: DataFrame, weights: DataFrame, most: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None]:
    """The rows, and the weights by rater if they are few; else the rows have them in `w`."""
    few = gathered(weights.select("r", "w"), most)
    if few is not None:
        few.sort(key=lambda x: x.r)
        return rows.withColumn("w", F.lit(None).cast("array<double>")), (np.array([x.r for x in few], np.int64), np.array([x.w for x in few], float))
    long = rows.select("item", "part", "many", F.explode(F.arrays_zip("r", F.sequence(F.lit(0), F.size("r") - 1).alias("i"))).alias("v"), F.col("s"))
    wide = F.size("s") / F.count("*").over(Window.partitionBy("item", "part"))
    long = long.withColumn("d", wide.cast("int")).select("item", "part", "many", F.col("v.r").alias("r"), F.expr("slice(s, v.i * d + 1, d)").alias("s"))
    again = long.join(weights.select("r", "w"), "r").groupBy("item", "part", "many").agg(F.collect_list(F.struct("r", "s", "w")).alias("v"))
    return again.select("item", "part", "many", F.col("v.r").alias("r"), F.flatten("v.s").alias("s"), F.flatten("v.w").alias("w")), None


def _flat(batch: pd.DataFrame, weights: tuple[np.ndarray, np.ndarray] | None, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all votes of a batch: row, rater, scores and weights, which are 0 where there is no score."""
    at = np.repeat(np.arange(len(batch)), batch["r"].map(len).to_numpy())
    r = np.concatenate(batch["r"].to_list()).astype(np.int64)
    s = np.concatenate(batch["s"].to_list()).astype(np.int64).reshape(-1, d)
    w = np.concatenate(batch["w"].to_list()).reshape(-1, d) if weights is None else weights[1][np.searchsorted(weights[0], r)]
    return at, r, s, np.where(s > 0, w, 0.0)


def _totals(at: np.ndarray, s: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """(row, dimension, score): the weight of each score of each row, and behind the scores the number of votes."""
    d, k = s.shape[1], len(SCORES) + 1
    flat = (at[:, None] * d + np.arange(d)) * k
    scored = s > 0
    sums = np.bincount((flat + s - 1)[scored], w[scored], rows * d * k) + np.bincount((flat + k - 1)[scored], minlength=rows * d * k)
    return sums.reshape(rows, d, k)


def _item_totals(weights: tuple | None, d: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, _, s, w = _flat(batch, weights, d)
                yield pd.DataFrame({"item": batch["item"], "totals": list(_totals(at, s, w, len(batch)).reshape(len(batch), -1))})

    return run


#: What is added up for each rater and dimension: votes with others, scores, their squares, the others' mean, its square, the product, hits.
SUMS = ("n", "s", "ss", "c", "cc", "sc", "hits")


def _against_others(weights: tuple | None, d: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            at, r, s, w = _flat(batch, weights, d)
            totals = _totals(at, s, w, len(batch))
            given = batch["whole"].notna().to_numpy()
            if given.any():
                totals[given] = np.stack(batch.loc[given, "whole"].to_list()).reshape(-1, d, len(SCORES) + 1)
            raters, code = np.unique(r, return_inverse=True)
            out = {"r": raters}
            for j in range(d):
                scored = (s[:, j] > 0) & (totals[at, j, -1] > 1)
                rest = totals[at[scored], j, :-1].copy()
                own, weight = s[scored, j], w[scored, j]
                rest[np.arange(len(own)), own - 1] -= weight
                rest = np.maximum(rest, 0.0)
                whole = rest.sum(axis=1)
                mean = rest @ np.array(SCORES, float) / np.where(whole > 0, whole, 1.0)
                hit = np.round(rest, 9).argmax(axis=1) + 1 == own
                own = own.astype(float)
                values = (np.ones(len(own)), own, own * own, mean, mean * mean, own * mean, hit.astype(float))
                for name, value in zip(SUMS, values, strict=True):
                    out[f"{name}{j}"] = np.bincount(code[scored], value, len(raters))
            yield pd.DataFrame(out)

    return run


def _sums(rows: DataFrame, weights: DataFrame, d: int, most: int, many: bool) -> DataFrame:
    """(r, *sums by dimension) of each rater against the weighted consensus of the others.

    `many` tells whether the votes of some item stand in several rows.
    """
    ready, sent = _with_weights(rows, weights, most)
    if not many:
        ready = ready.withColumn("whole", F.lit(None).cast("array<double>"))
    else:
        parts = ready.where("many").mapInPandas(_item_totals(sent, d), "item string, totals array<double>")
        size = d * (len(SCORES) + 1)
        sums = parts.groupBy("item").agg(F.array(*[F.sum(F.col("totals")[i]).alias(str(i)) for i in range(size)]).alias("whole"))
        ready = ready.join(sums, "item", "left")
    columns = [f"{n}{j}" for j in range(d) for n in SUMS]
    found = ready.mapInPandas(_against_others(sent, d), "r long, " + ", ".join(f"{c} double" for c in columns))
    return found.groupBy("r").agg(*[F.sum(c).alias(c) for c in columns])


def graded(sums: pd.DataFrame, j: int) -> pd.DataFrame:
    """From the sums of dimension j: accuracy, chance, the excess over chance and its error under chance, follow and hits."""
    n, s, ss, c, cc, sc, hits = (sums[f"{x}{j}"].to_numpy(float) for x in SUMS)
    votes_ = np.maximum(n, 1.0)
    vs, vc, cov = np.maximum(ss / votes_ - (s / votes_) ** 2, 0), np.maximum(cc / votes_ - (c / votes_) ** 2, 0), sc / votes_ - s * c / votes_**2
    # Leaving a vote out of its rater's offset stretches its distance by n / (n - 1), by chance or not.
    stretch = (n / np.maximum(n - 1, 1)) ** 2 / (SCORES[-1] - SCORES[0]) ** 2
    chance, plain = 1 - (vs + vc) * stretch, 1 - (vs + vc - 2 * cov) * stretch
    accuracy = (n * plain + SMOOTHING * chance) / (n + SMOOTHING)
    # A rater whose scores never change follows nobody.
    told = (vs > 1e-12) & (vc > 1e-12)
    excess = np.where(told, (accuracy - chance) / np.where(told, (vs + vc) * stretch, 1), 0.0)
    error = np.where(told, n / (n + SMOOTHING) * 2 * np.sqrt(vs * vc) / np.where(told, vs + vc, 1), 1.0) / np.sqrt(votes_)
    follow = np.where(told, cov / np.sqrt(np.where(told, vs * vc, 1)), 0.0)
    return pd.DataFrame({"votes": n.astype(np.int64), "accuracy": accuracy, "chance": chance, "excess": excess, "error": error, "hits": hits / votes_, "follow": follow})


def _moved(d: int, step: float):
    """From (r, w, sums) to (r, w, moved): each weight gone `step` of the way to the accuracy over chance."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        old = np.array(frame["w"].to_list(), float).reshape(-1, d)
        sums = frame.fillna({c: 0.0 for c in frame.columns if c not in ("r", "w")})
        aim = np.stack([np.maximum(graded(sums, j)["excess"], FLOOR) for j in range(d)], axis=1)
        new = old + step * (aim - old)
        return pd.DataFrame({"r": frame["r"].to_numpy(), "w": list(new), "moved": np.abs(new - old).max(axis=1, initial=0.0)})

    return run


def converged(rows: DataFrame, raters: DataFrame, d: int, many: bool, tolerance: float = 1e-3, rounds: int | None = None, most: int = MOST_RATERS) -> DataFrame:
    """(r, w): each rater's weights by dimension, alternating consensus and accuracy until none moves by `tolerance`.

    Whenever the moves don't shrink by a tenth, steps are halved, so that weights that swing come
    to rest too. `rounds` stops early; it is for tests.
    """
    spark = rows.sparkSession
    weights = cut_lineage(raters.select("r", F.array_repeat(F.lit(1.0), d).alias("w")))
    few = gathered(weights.select("r"), most) is not None
    step, before, turn = 1.0, math.inf, 0
    while rounds is None or turn < rounds:
        state = weights.join(_sums(rows, weights, d, most, many), "r", "left")
        if few:  # a few numbers for each of at most `most` raters
            new = _moved(d, step)(state.toPandas())
            moved = new["moved"].max() if len(new) else None
            after = spark.createDataFrame(list(zip(new["r"].tolist(), [w.tolist() for w in new["w"]], strict=True)), "r long, w array<double>")
        else:
            run = _moved(d, step)
            after = cut_lineage(state.mapInPandas(lambda batches, run=run: map(run, batches), "r long, w array<double>, moved double"))
            moved = after.agg(F.max("moved")).first()[0]
            drop_cut(weights)
            after = after.drop("moved")
        weights, turn = after, turn + 1
        if moved is None or moved < tolerance:
            break
        step, before = (step / 2 if moved > 0.9 * before else step), moved
    return weights


def _prepared(labels: DataFrame, item: str, rater: str, dimensions: Names, row: int) -> tuple[DataFrame, DataFrame, bool]:
    """The working table, the raters (r, rater, items), and whether an item has several rows."""
    cast = cut_lineage(ballots(labels, item, rater, dimensions).where("exists(s, x -> x > 0)"))
    raters = cut_lineage(cast.groupBy("rater").agg(F.count("*").alias("items")).withColumn("r", F.xxhash64("rater")))
    rows = cut_lineage(grouped(cast, row))
    drop_cut(cast)
    return rows, raters, not rows.where("many").isEmpty()


MEASURES = "dimension string, votes long, accuracy double, chance double, excess double, error double, hits double, follow double, weight double"


def _reports(dimensions: Names):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for j, name in enumerate(dimensions):
                out = pd.concat([batch[["rater", "items"]].reset_index(drop=True), graded(batch, j)], axis=1)
                out.insert(2, "dimension", name)
                out["weight"] = [w[j] for w in batch["w"]]
                yield out[out["votes"] > 0]

    return run


def reliability(labels: DataFrame, item: str = "example_id", rater: str = "labeler", dimensions: Names = DIMENSIONS, row: int = ROW, most: int = MOST_RATERS, **options) -> DataFrame:
    """(rater, items, dimension, votes, accuracy, chance, excess, error, hits, follow, weight).

    votes are those on items that others scored too; excess is accuracy over chance as a share of
    what is possible; error is its standard error if there is nothing but chance; hits the share
    of scores equal to the others' consensus; follow the correlation with the others' mean.
    """
    rows, raters, many = _prepared(labels, item, rater, dimensions, row)
    weights = converged(rows, raters, len(dimensions), many, most=most, **options)
    sums = _sums(rows, weights, len(dimensions), most, many)
    return raters.join(weights, "r").join(sums, "r").mapInPandas(_reports(dimensions), "rater string, items long, " + MEASURES)


#: Unreliable: accuracy over chance below so many of its errors, or this share of what is possible, in each dimension and on the mean of all.
ERRORS, LEAST, MEAN_ERRORS, MEAN_LEAST = 2.2, 0.25, 2.1, 0.15


def unreliable(labels: DataFrame, least_items: int = 15, dimensions: Names = DIMENSIONS, **options) -> DataFrame:
    """(rater, items, most, mean): raters of at least `least_items` items who follow the others in no dimension.

    A rater is reported if the leave-one-out accuracy is not above chance: in each dimension by
    less than `ERRORS` of its standard errors (or `LEAST`), and on the mean of the dimensions,
    which is steadier, by less than `MEAN_ERRORS` (or `MEAN_LEAST`). A dimension without votes
    counts as chance.
    """
    measures = reliability(labels, dimensions=dimensions, **options)
    d = len(dimensions)
    low = F.col("excess") < F.greatest(F.lit(LEAST), ERRORS * F.col("error"))
    by = measures.where(F.col("items") >= least_items).groupBy("rater", "items").agg(
        F.max("excess").alias("most"), (F.sum("excess") / d).alias("mean"), F.bool_and(low).alias("low"), (F.sqrt(F.sum(F.col("error") * F.col("error"))) / d).alias("error")
    )
    return by.where(F.col("low") & (F.col("mean") < F.greatest(F.lit(MEAN_LEAST), MEAN_ERRORS * F.col("error")))).select("rater", "items", "most", "mean")


def consensus(labels: DataFrame, item: str = "example_id", rater: str = "labeler", dimensions: Names = DIMENSIONS, row: int = ROW, most: int = MOST_RATERS, **options) -> DataFrame:
    """(item, dimension, consensus, confidence, raters): confidence is the winner's share of the weight."""
    rows, raters, many = _prepared(labels, item, rater, dimensions, row)
    d, k = len(dimensions), len(SCORES) + 1
    ready, sent = _with_weights(rows, converged(rows, raters, d, many, most=most, **options), most)
    parts = ready.mapInPandas(_item_totals(sent, d), "item string, totals array<double>")
    sums = parts.groupBy("item").agg(F.array(*[F.sum(F.col("totals")[i]).alias(str(i)) for i in range(d * k)]).alias("t"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("dimension"), F.slice("t", j * k + 1, k - 1).alias("w"), F.col("t")[j * k + k - 1].cast("long").alias("raters")) for j, name in enumerate(dimensions)]))
    long = sums.select("item", each.alias("x")).select("item", "x.*").where("raters > 0").withColumn("w", F.transform("w", lambda x: F.round(x, 9)))
    best = F.array_max("w")
    return long.select("item", "dimension", F.array_position("w", best).cast("int").alias("consensus"), (best / F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("confidence"), "raters")


def agreement(labels: DataFrame, **names) -> DataFrame:
    """Krippendorff's alpha, the chance-corrected agreement that allows for missing ratings.

    (dimension, items, ratings, alpha_interval, alpha_nominal) over the items with two or more
    ratings; an alpha is NULL where all those ratings are the same.
    """
    per = [F.sum((F.col("score") == s).cast("long")).alias(f"c{s}") for s in SCORES]
    items = votes(labels, **names).groupBy("item", "dimension").agg(*per).withColumn("m", sum((F.col(f"c{s}") for s in SCORES), F.lit(0))).where("m > 1")
    s1 = sum((s * F.col(f"c{s}") for s in SCORES), F.lit(0))
    s2 = sum((s * s * F.col(f"c{s}") for s in SCORES), F.lit(0))
    same = sum((F.col(f"c{s}") * (F.col(f"c{s}") - 1) for s in SCORES), F.lit(0))
    sums = items.withColumns({"s1": s1, "s2": s2, "d": (F.col("m") * s2 - s1 * s1) / (F.col("m") - 1), "a": same / (F.col("m") - 1)})
    total = sums.groupBy("dimension").agg(F.count("*").alias("items"), F.sum("m").alias("ratings"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("d").alias("d"), F.sum("a").alias("a"), *[F.sum(f"c{s}").alias(f"c{s}") for s in SCORES])
    n = F.col("ratings").cast("double")
    expected = (n * F.col("s2") - F.col("s1").cast("double") * F.col("s1")) / (n - 1)
    chance = sum((F.col(f"c{s}").cast("double") * (F.col(f"c{s}") - 1) for s in SCORES), F.lit(0.0)) / (n - 1)
    return total.select(
        "dimension", "items", "ratings",
        F.when(expected > 0, 1 - F.col("d") / expected).alias("alpha_interval"),
        F.when(n - chance > 1e-9, (F.col("a") - chance) / (n - chance)).alias("alpha_nominal"),
    )
