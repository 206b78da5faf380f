import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import ingest, judging
from lodestrand.sources import files

TEXT = "Preface line.\nAC-2 Account Management\n" + "The owner reviews accounts every month. " * 40 + "\nAC-3 Access\nShort.\nAU-1 Audit Policy\n" + "Events are kept and read. " * 90 + "\n3.1 Scope\na | b\nc | d\ne | f\n"


def test_sections_tile_the_text():
    s = ingest.sections_of(TEXT)
    assert [x[0] for x in s] == ["untitled", "AC-2", "AC-3", "AU-1", "3.1"] and s[1][1] == "Account Management"
    assert all(a[3] <= b[2] for a, b in itertools.pairwise(s)) and ingest.sections_of(" \n") == []


def test_chunks(spark):
    df = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 900, "x")], "doc_id long, text string, ordinal string")
    rows = ingest.chunks(df, target=100, overlap=10).collect()
    one = [r for r in rows if r.doc_id == "1"]
    assert {r.doc_id for r in rows} == {"1", "4"} and all(r.token_count <= 150 for r in rows)
    assert all(r.text == TEXT[r.char_start : r.char_end] for r in one) and len({r.chunk_id for r in rows}) == len(rows)
    assert not any({"AC-2", "AU-1"} <= set(r.section_ids) for r in one)
    assert max(one, key=lambda r: r.ordinal).content_type == "table"
    flat = [w for r in sorted((r for r in rows if r.doc_id == "4"), key=lambda r: r.char_start) for w in [r.char_start, r.char_end]]
    assert flat[0] == 0 and flat[-1] == 4499


def test_windows_overlap_and_hold_every_sentence():
    rnd = random.Random(3)
    text = " ".join(" ".join(["w"] * rnd.randint(1, 30)) + "." for _ in range(60))
    ranges = ingest.windows(text, 0, len(text), 60, 10, 90)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text)
    assert all(b[0] <= a[1] + 1 for a, b in itertools.pairwise(ranges)) and all(ingest._size(text[a:b]) <= 90 for a, b in ranges)


@pytest.mark.parametrize(("a", "b", "same"), [("AC-2", "AC-3(1)", True), ("AC-2", "AU-1", False), ("3.1", "3.2", True), ("3.1", "4.1", False), ("Annex A", "Annex B", True), ("Annex A", "3", False), ("untitled", "untitled", True)])
def test_units(a, b, same):
    assert ingest.same_unit(a, b) is same


def kappa(pairs):
    n = len(pairs)
    o = sum((a - b) ** 2 for a, b in pairs) / n
    e = sum((a - b) ** 2 for a, _ in pairs for _, b in pairs) / n / n
    return 1.0 if e == 0 else 1 - o / e


def test_kappa_by_definition(spark):
    rnd = random.Random(2)
    data = [(g, rnd.randint(1, 5), rnd.randint(1, 5)) for g in range(6) for _ in range(20)] + [(9, 3, 3)] * 4
    got = {r.g: r.k for r in spark.createDataFrame(data, "g int, a double, b double".replace("double", "int")).groupBy("g").agg(judging.quadratic_kappa(F.col("a").cast("double"), F.col("b").cast("double")).alias("k")).collect()}
    assert got == {g: pytest.approx(kappa([(a, b) for x, a, b in data if x == g])) for g in {d[0] for d in data}}


def test_round_robin_and_extremes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9), ("c", 5), ("c", 6)], "t string, i int")
    assert [(r.t, r.i) for r in judging.round_robin(df, "t", "i", 5).collect()] == [("a", 1), ("b", 9), ("c", 5), ("a", 2), ("c", 6)]
    got = {r.i: (r.i_best,) for r in judging.extremes(df, high=("i",)).collect()}
    assert [i for i, (b,) in got.items() if b] == [9]


def test_scans_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = {"id": "1", "question": "q", "type": "lookup", "extra": 5}
    (folder / "a.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"id": "2", "held_out": True}) + "\n")
    assert {(r.id, r.held_out) for r in files.golden(spark, str(folder)).collect()} == {("1", False), ("2", True)}
    (folder / "b.rejudge.jsonl").write_text('{"id": "3"}\nnot json\n')
    assert {r.id for r in files.result_rows(spark, str(folder), files.GOLDEN).collect()} == {"1", "2"}
    bad = files.json_lines(spark, str(folder), files.GOLDEN, ("question",)).where("_bad is not null").collect()
    assert sorted(r["_bad"] for r in bad) == ["missing: question", "not json"]
    with pytest.raises(Exception, match="bad row"):
        files.golden(spark, str(folder)).collect()
    want = spark.createDataFrame([("a.jsonl", "0" * 64)], "name string, sha256 string")
    assert {r.path.rsplit("/", 1)[1]: r.verified for r in files.verified_files(spark, str(folder), want).collect()} == {"a.jsonl": False, "b.rejudge.jsonl": None}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [files.append_missing(rows, str(tmp_path / "t"), "k"), files.append_missing(rows, str(tmp_path / "t"), "k")] == [2, 0]
    files.write_audit(spark.sql("select timestamp '2026-01-05 10:00:00' as ts, 'h' as hash"), str(tmp_path / "audit"))
    assert (tmp_path / "audit" / "day=20260105").is_dir()
    odd = spark.createDataFrame([("a", 1), ("b", None)], "chunk_id string, extra int").select("chunk_id", *[F.lit(None).cast(t).alias(c) for c, t in [x.split(" ") for x in files.CHUNK.split(", ")[1:]]])
    files.write_chunks(odd, str(tmp_path / "chunks"))
    assert files.json_lines(spark, str(tmp_path / "chunks"), files.CHUNK).count() == 2
