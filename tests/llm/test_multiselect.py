import math
import random

import pytest

from lodestrand.llm import multiselect as M


def exact(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(round(p * len(values), 6))) - 1]


@pytest.mark.parametrize("finish", [0, 30])
def test_against_sorting(spark, finish):
    rnd = random.Random(3)
    rows = [("a", rnd.choice([1.5, 2.0, rnd.random() * 9])) for _ in range(400)] + [("b", 7.0)] * 50 + [("c", -1.0), ("c", None), ("c", math.nan), (None, 4.0), ("c", math.inf)]
    got = {(r.g, r.percentile): (r.value, r["values"]) for r in M.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ("g",), "v", (0.5, 0.99, 1.0, 0.001), finish=finish).collect()}
    want = {}
    for g in ("a", "b", "c", None):
        v = [x for k, x in rows if k == g and x is not None and math.isfinite(x)]
        want |= {(g, p): (exact(v, p), len(v)) for p in (0.5, 0.99, 1.0, 0.001)}
    assert got == want


def test_last_write_counts_once(spark):
    schema = "request_id string, source string, ts timestamp, provider string, pipeline string, latency_s double, ingest_seq long, value string"
    rows = [("r", "s", None, " A ", None, 1.0, 1, ""), ("r", "s", None, "a", "x", 5.0, 2, ""), ("r", "s", None, "a", "x", 5.0, 2, ""), ("q", "s", None, "a", "x", math.nan, 9, ""), ("q", "t", None, "A", "x", 0.0, 1, "")]
    got = M.measurements(spark.createDataFrame(rows, schema)).select("provider", "pipeline", "value").collect()
    assert sorted(tuple(r) for r in got) == [("a", "x", 0.0), ("a", "x", 5.0)]


def test_summaries_of_days_add_up_within_the_error(spark):
    rnd = random.Random(5)
    rows = [(d, math.exp(rnd.gauss(0, 2)) if rnd.random() < 0.9 else 0.0) for d in range(4) for _ in range(200)]
    days = M.summaries(spark.createDataFrame(rows, "day int, v double"), ("day",), "v")
    for r in M.combined(days.select("day", "bucket", "values"), ("day",)).collect() + M.combined(days.selectExpr("0 as day", "bucket", "values"), ("day",)).collect():
        values = [v for d, v in rows if r["values"] > 200 or d == r.day]
        assert abs(r.estimate - exact(values, r.percentile)) <= 0.0101 * exact(values, r.percentile)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert M.percentiles(df, ("g",), "v").count() == M.summaries(df, ("g",), "v").count() == 0
