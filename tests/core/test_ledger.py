import datetime as dt

import pytest

from lodestrand.operators import ledger
from lodestrand.operators.order_statistics import MEDIAN_HIGH, MEDIAN_LOW, even_rank, floor_rank, nearest_rank, values_at
from lodestrand.streaming import streams

SCHEMA = "request_id string, source string, ts timestamp, provider string, model string, pipeline string, input_tokens long, output_tokens long, cost_usd double, latency_s double, stages map<string,double>, refusal boolean, error boolean, ingest_seq long"


def row(i, source="api", day=1, provider="a", cost=0.5, latency=1.0, seq=1, stages=None, **more):
    return (f"r{i}", source, dt.datetime(2026, 1, day, 12), provider, more.get("model", "m"), more.get("pipeline"), 10, 5, cost, latency, stages, more.get("refusal", False), more.get("error", False), seq)


def test_ranks_of_eleven(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(1, 12)] + [("k", None), ("k", float("nan")), (None, -2.0), (None, -5.0)], "g string, v double")
    got = {r.g: r for r in values_at(df, ("g",), "v", {"p50": nearest_rank(50), "p95": nearest_rank(95), "even": even_rank(95), "floor": floor_rank(0.95), "low": MEDIAN_LOW, "high": MEDIAN_HIGH}).collect()}
    assert tuple(got["k"])[1:] == (11, 6.0, 10.0, 10.0, 11.0, 6.0, 6.0)
    assert (got[None].p50, got[None].p95, got[None].n) == (-5.0, -2.0, 2)


def test_ranks_against_sorting(spark):
    import random

    rnd = random.Random(1)
    values = [rnd.choice([0.0, 1.5, rnd.gauss(0, 50)]) for _ in range(700)]
    r = values_at(spark.createDataFrame([(v,) for v in values], "v double").selectExpr("1 as g", "v"), ("g",), "v", {f"p{p}": nearest_rank(p) for p in (1, 50, 95, 99)}).first()
    assert all(r[f"p{p}"] == sorted(values)[max(0, int(p / 100 * 700 + 0.5) - 1)] for p in (1, 50, 95, 99))


def test_latest_and_summary(spark):
    rows = [row(1, seq=1, cost=9.0), row(1, seq=2, cost=None), row(1, seq=2, cost=None, stages={"a": 1.0}), row(2, provider=" A ", cost=None, latency=float("nan"), error=True), row(3, provider="b", cost=0.0, refusal=True), row(3, source="eval", provider="b", cost=2.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    last = ledger.latest(df)
    assert last.count() == 4 and last.where("request_id = 'r1'").first().stages == {"a": 1.0}
    got = {r.provider: r for r in ledger.summary(last).collect()}
    assert (got["a"].requests, got["a"].errors, got["a"].cost_usd, got["a"].p95) == (2, 1, None, 1.0)
    assert (got["b"].requests, got["b"].refusals, got["b"].cost_usd) == (2, 1, 2.0)
    with pytest.raises(ValueError):
        ledger.summary(df, "colour")
    assert ledger.summary(df.limit(0)).count() == 0 and ledger.since(df, "2026-01-02").count() == 0


def test_stream_keeps_the_last_write(spark, tmp_path):
    keep = "request_id string, source string, latency_s double, ingest_seq long"
    for k, rows in enumerate([[("a", "s", 1.0, 1), ("b", "s", 2.0, 1)], [("a", "s", 3.0, 5), ("a", "s", 2.0, 4)], [("a", "s", 9.0, 3), ("c", "s", 1.0, 1)]]):
        spark.createDataFrame(rows, keep).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = streams.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        streams.drained(streams.upsert(source, str(tmp_path / "out"), str(tmp_path / "log"), buckets=2))
    got = {(r.request_id, r.latency_s) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 3.0), ("b", 2.0), ("c", 1.0)}
