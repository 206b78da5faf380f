import json

import pytest

from lodestrand.operators import ingest, judging, replies


def read(spark, column, texts):
    return [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column("t").alias("x")).collect()]


def test_rankings(spark):
    good = json.dumps({"ranking": ["a", "b c", "ü"]})
    bad = ["no json", json.dumps({"ranking": ["a", 1]}), json.dumps({"ranking": "a"}), json.dumps({"other": []}), json.dumps(["a"]), good + " tail", "", None]
    got = read(spark, replies.ranking, [good, f"```json\n{good}\n```", f" ```\n{good}``` ", json.dumps({"ranking": []}), *bad])
    assert got == [["a", "b c", "ü"]] * 3 + [[]] + [None] * len(bad)


def test_plans(spark):
    hop = lambda *subs: "So: " + json.dumps({"classification": "multi_hop", "sub_queries": list(subs)}) + " ok"
    texts = [hop(" x ", "y"), hop("a", "b", "c", "d", "e"), hop("x", "  ", 3, None), json.dumps({"classification": "direct", "sub_queries": 1}), json.dumps({"classification": "odd"}), json.dumps({"classification": "multi_hop"}), "{broken", None]
    got = [tuple(p) for p in read(spark, lambda t: replies.plan(t, "t"), texts)]
    assert got[:2] == [("multi_hop", ["x", "y"], False), ("multi_hop", ["a", "b", "c", "d"], False)]
    assert got[2:] == [("direct", [t], i != 1) for i, t in enumerate(texts[2:])]


def test_critiques(spark):
    issue = {"kind": "incomplete", "detail": " d ", "fix": "f"}
    revise = lambda *issues: json.dumps({"verdict": "revise", "issues": list(issues)})
    texts = [json.dumps({"verdict": "pass", "issues": [1]}), json.dumps({"verdict": "pass"}), "x " + revise(issue, issue | {"kind": "contradiction"})]
    bad = [revise(), json.dumps({"verdict": "revise"}), revise(issue | {"kind": "odd"}), revise(issue | {"fix": " "}), revise(issue | {"detail": 5}), revise(issue, "x"), json.dumps({"verdict": "maybe"}), "none", None]
    got = read(spark, replies.critique, texts + bad)
    assert [c and (c.verdict, [tuple(i) for i in c.issues]) for c in got] == [("pass", []), ("pass", []), ("revise", [("incomplete", "d", "f"), ("contradiction", "d", "f")])] + [None] * len(bad)


def test_run_summary(spark):
    schema = "provider string, model string, mode string, rerank string, pipeline string, refusal boolean, judged boolean, latency_s double, input_tokens long, output_tokens long, cost_usd double, judge_cost_usd double"
    rows = [("p", None, "m", None, "x", r, j, lat, 10, 1, cost, jc) for r, j, lat, cost, jc in [(False, True, 1.0, 0.5, 0.1), (False, None, 3.0, 0.5, None), (True, True, None, 0.5, 0.2), (None, False, 2.0, 0.5, None)]]
    rows += [("q", "m", "m", "r", "x", False, True, None, 1, 1, None, None)]
    got = {r.provider: r for r in judging.run_summary(spark.createDataFrame(rows, schema)).collect()}
    p, q = got["p"], got["q"]
    assert (p["items"], p.judged, p.refusals, p.judge_failures, p.latency_mean, p.latency_p50, p.latency_p95) == (4, 1, 1, 2, 2.0, 2.0, 3.0)
    assert (p.cost_usd, p.judge_cost_usd, q.cost_usd, q.judge_cost_usd, q.latency_p50) == (2.0, pytest.approx(0.3), None, None, None)
    frame = spark.createDataFrame(rows, schema)
    assert judging.of_config(frame, "m", "none").count() == 4 and judging.of_config(frame, rerank="r").count() == 1 and judging.of_config(frame).count() == 5


def test_labelable_and_once(spark):
    golden = spark.createDataFrame([("a", "lookup"), ("b", "synthesis")], "example_id string, type string")
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("z", False), (None, False)], "example_id string, refusal boolean")
    assert sorted((r.example_id, r.type) for r in judging.labelable(rows, golden).collect()) == [("a", "lookup"), ("b", "synthesis")]
    assert judging.once(golden, "example_id").count() == 2
    with pytest.raises(Exception, match="more than one row for a"):
        judging.once(rows.where("example_id = 'a'"), "example_id").collect()


def test_substantial_sections(spark):
    rows = spark.createDataFrame([("d", 0, "x" * 60), ("d", 1, "y"), ("e", 0, "ab"), ("e", 1, "abc "), ("e", 2, "abc"), ("f", 0, "")], "doc_id string, ordinal int, text string")
    assert sorted((r.doc_id, r.ordinal) for r in ingest.substantial(rows).collect()) == [("d", 0), ("e", 1), ("f", 0)]


def test_fingerprint_and_lines(spark):
    ids = lambda *xs: ingest.fingerprint(spark.createDataFrame([(x,) for x in xs], "id string"), "id").first()
    assert ids("sp-1", "sp-2", "sp-2", None) == ids("sp-2", "sp-1") != ids("sp-1", "sp-3") and ids("a").ids == 1 and ids().ids == 0
    text = "\n".join(["a", "a", "", "7", "a", "b", " ", "b", "c", "a"] + ["r"] * 20_000)
    assert spark.createDataFrame([(text,), (None,)], "t string").select(ingest.cleaned_lines("t").alias("t")).collect() == [("a\nb\nc\na\nr",), (None,)]


def test_section_ids(spark):
    want = {"AC-2(1) Automation": "AC-2(1)", " AU-12 Audit": "AU-12", "GOVERN 1.4 Roles": "govern-1-4", "3.1.2Scope": "3.1.2", "Appendix b": "appendix-b", "CHAPTER 3": "chapter-3"}
    other = {"three": "front-matter", "3 Scope": "front-matter", "": "front-matter", None: "front-matter"}
    rows = spark.createDataFrame([(t,) for t in [*want, *other, "3.1 Scope ........ 7"]], "t string")
    got = {r.t: (r.i, r.h) for r in rows.select("t", ingest.section_id("t").alias("i"), ingest.is_heading("t").alias("h")).collect()}
    assert {t: got[t][0] for t in want | other} == want | other
    assert all(got[t][1] for t in want) and not any(got[t][1] for t in other) and got["3.1 Scope ........ 7"] == ("3.1", False)
