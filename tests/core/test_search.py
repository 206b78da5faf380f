import sqlite3

import pytest

from lodestrand.functions.text import query_groups, terms
from lodestrand.operators import embeddings, ranking_eval, retrieval
from lodestrand.sources import vectors

DOCS = [
    ("d1", "Access control", "AC-2 account management covers accounts and access to accounts."),
    ("d2", "Audit", "Audit records must be kept, audit events reviewed; see AU-6."),
    ("d3", "AC-2(1) automation", "Automated account management supports ac-2 and ac 3."),
    ("d4", None, "Cryptographic keys rotate yearly, keys expire."),
    ("d5", "Training", ""),
    ("d6", "Café rules", "the café access list"),
]
QUERIES = [("q1", "AC-2 account account"), ("q2", "audit records"), ("q3", "keys"), ("q4", "zebra"), ("q5", "cafe access"), ("q6", None)]


def test_bm25_against_fts5(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(heading, body)")
    for i, (_, h, b) in enumerate(DOCS):
        db.execute("insert into t(rowid, heading, body) values (?, ?, ?)", (i + 1, h or "", b))
    got = {}
    for r in retrieval.bm25(spark.createDataFrame(QUERIES, "query_id string, query string"), retrieval.Index.of(spark.createDataFrame(DOCS, "doc string, heading string, text string"))).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc, r.score))
    match = {"q1": '"ac 2" OR "account" OR "account"', "q2": '"audit" OR "records"', "q3": '"keys"', "q5": '"cafe" OR "access"'}
    for q, m in match.items():
        want = db.execute("select rowid, -bm25(t) from t where t match ? order by 2 desc, 1", (m,)).fetchall()
        assert [d for _, d, _ in sorted(got[q])] == [f"d{i}" for i, _ in want]
        assert [s for _, _, s in sorted(got[q])] == pytest.approx([s for _, s in want], abs=1e-8)
    assert set(got) == set(match)


def test_neighbours_and_ties(spark):
    docs = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate([(1, 0), (2, 0), (0, 1), (0, 0), (-1, 0)])] + [(9, None)], "doc long, v array<double>")
    q = spark.createDataFrame([(7, [3.0, 0.0]), (8, None)], "query_id long, v array<double>")
    assert [(r.doc, r.rank) for r in retrieval.knn(q, docs, 3).orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]
    assert [r.doc for r in retrieval.knn(q, docs, 2, cosine=False, block=1).orderBy("rank").collect()] == [1, 0]
    assert retrieval.knn(q.limit(0), docs).count() == 0
    three = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "query_id long, v array<double>")
    found = lambda block: {(r.query_id, r.rank): r.doc for r in retrieval.knn(three, docs, 3, block=block).collect()}
    assert found(1) == found(100) and len(found(2)) == 15
    named = docs.withColumn("doc", docs.doc.cast("string"))
    assert [r.doc for r in retrieval.knn(q, named, 2).orderBy("rank").collect()] == ["0", "1"]


def test_fusion_and_reranking(spark):
    rank = spark.createDataFrame([("q", "a", "x", 1, 9.0), ("q", "a", "y", 2, 8.0), ("q", "b", "y", 1, 3.0), ("q", "b", "z", 2, 2.0)], "query_id string, mode string, doc string, rank int, score double")
    got = retrieval.rrf(rank).orderBy("rank").collect()
    assert [(r.doc, r.rank) for r in got] == [("y", 1), ("x", 2), ("z", 3)] and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert got[0].sources == {"a": 8.0, "b": 3.0}
    pool = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abcd")], "query_id string, doc string, rank int")
    listed = spark.createDataFrame([("q", ["c", "nope", "c", "a"])], "query_id string, docs array<string>")
    assert [r.doc for r in retrieval.rerank_listwise(pool, listed, 3).orderBy("rank").collect()] == ["c", "a", "b"]


def test_ranking_metrics_by_hand(spark):
    chunks = spark.createDataFrame([("c1", "p", ["s1", "s2"]), ("c2", "p", ["s1"]), ("c3", "o", ["s1"])], "doc string, doc_id string, section_ids array<string>")
    golden = spark.createDataFrame([("q", [("p", "s1"), ("p", "s2"), ("p", "s9")]), ("e", []), ("n", None)], "query_id string, citations array<struct<doc:string,section:string>>")
    rank = spark.createDataFrame([("q", "c3", 1), ("q", "c2", 2), ("q", "c1", 3)], "query_id string, doc string, rank int")
    import math

    got = {r.query_id: r for r in ranking_eval.per_query(rank, golden, chunks).collect()}
    ideal = sum(1 / math.log2(i + 1) for i in (1, 2, 3))
    assert (got["q"].recall_5, got["q"].precision_5, got["q"].mrr) == (pytest.approx(2 / 3), 0.4, 0.5)
    assert got["q"].ndcg_10 == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / ideal)
    assert all(got[k][c] == 0 for k in "en" for c in ("recall_20", "mrr", "ndcg_10"))


def test_terms_of_all_scripts(spark):
    text = "Łódź, o\u0301rgano Überprüfung — Ελλάδα Ёлка 東京 x2"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(terms("t").alias("t"), query_groups("t").alias("g")).collect()
    assert got[0].t == got[0].g == ["łodz", "organo", "uberprufung", "ελλαδα", "елка", "東京", "x2"] and got[1].t == []


def test_vectors_are_filled_by_and_by(spark, tmp_path):
    rows = spark.createDataFrame([("a", "keys and locks"), ("b", "locks and keys"), ("c", None)], "doc string, text string")
    folder, hashed = f"{tmp_path}/v", embeddings.hashed("text")
    fill = lambda df, **more: vectors.embed_missing(df, folder, hashed, "hashed", embeddings.SIZE, **more)
    assert fill(rows.where("doc = 'a'")) == 1 and fill(rows) == 2 and fill(rows) == 0
    got = {r.doc: r.v for r in vectors.read_vectors(spark, folder).collect()}
    assert got["a"] == got["b"] and sum(x * x for x in got["a"]) == pytest.approx(1) and not any(got["c"])
    with pytest.raises(ValueError):
        vectors.embed_missing(rows, folder, hashed, "other", embeddings.SIZE)
    with pytest.raises(Exception, match="64 components, not 65"):
        vectors.embed_missing(rows, f"{tmp_path}/w", hashed, "hashed", embeddings.SIZE + 1)
    assert fill(rows, force=True) == 3 and vectors.manifest(spark, folder) == ("hashed", 64)


def test_seeded_directions(spark):
    import random
    import zlib

    got = spark.createDataFrame([("x é",), ("x é",), (None,)], "t string").select(embeddings.seeded("t").alias("v")).collect()
    rnd = random.Random(zlib.crc32("x é".encode()))
    want = [rnd.gauss(0, 1) for _ in range(64)]
    norm = sum(x * x for x in want) ** 0.5
    assert got[0].v == got[1].v == pytest.approx([x / norm for x in want]) and sum(x * x for x in got[2].v) == pytest.approx(1)


def test_scores_joined_and_as_products_are_the_same(spark, monkeypatch):
    index = retrieval.Index.of(spark.createDataFrame(DOCS, "doc string, heading string, text string"))
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    found = lambda: [tuple(r) for r in retrieval.bm25(queries, index, 3).orderBy("query_id", "rank").collect()]
    products = found()
    monkeypatch.setattr(retrieval, "FEW_ASKED", 0)
    assert found() == products and len(products) > 5
