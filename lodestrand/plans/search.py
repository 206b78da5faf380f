"""Search over chunks and embeddings, and the quality of the rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import snippet
from lodestrand.operators import embeddings, ranking_eval, retrieval
from lodestrand.session import shared_folder
from lodestrand.sources import vectors
from lodestrand.sources.tables import table


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: golden questions whose number is divisible by 50."""
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    return table(spark, folder, "v2", "id", "question").where(number % 50 == 0).select(F.col("id").alias("query_id"), F.col("question").alias("query")).distinct()


def _docs(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return _rows(spark, folder, *more).dropDuplicates(["doc"])


def _rows(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Chunks as written, some of them more than once."""
    return table(spark, folder, "chunks", "chunk_id", "heading", "text", *more).withColumnRenamed("chunk_id", "doc")


#: The indexes and vector tables of this application's searches, by application and folder.
_INDEXES: dict[tuple[str, str], retrieval.Index] = {}
_VECTORS: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, folder: str) -> retrieval.Index:
    """The chunks' index, whose counts are written by the first search and read by all others of the same queries."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        _INDEXES[key] = retrieval.Index.of(_rows(spark, folder))
    return _INDEXES[key]


def _bm25(spark: SparkSession, folder: str, k: int = 10, fields: tuple[str, ...] | None = None) -> DataFrame:
    return retrieval.bm25(_queries(spark, folder), _index(spark, folder), k, fields)


def _vector_table(spark: SparkSession, folder: str) -> str:
    """The folder of the chunks' vectors, filled by the first search."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _VECTORS:
        path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
        vectors.embed_missing(_docs(spark, folder), path, embeddings.hashed("heading", "text"), HASHED, embeddings.SIZE)
        _VECTORS[key] = path
    return _VECTORS[key]


def _dense(spark: SparkSession, folder: str, k: int) -> DataFrame:
    asked = _queries(spark, folder).select("query_id", embeddings.hashed("query").alias("v"))
    return retrieval.knn(asked, vectors.read_vectors(spark, _vector_table(spark, folder)), k)


def search_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.normalised(_bm25(spark, folder)).select("query_id", F.col("doc").alias("chunk_id"), "rank", F.round("score", 6).alias("score"), F.round("normalised", 6).alias("normalised"))


def search_with_text(spark: SparkSession, folder: str) -> DataFrame:
    """Ids are ranked first; text joins only the ranked few."""
    texts = table(spark, folder, "chunks", "chunk_id", "heading", "text")
    found = texts.join(_bm25(spark, folder, 3).withColumnRenamed("doc", "chunk_id"), "chunk_id").select("query_id", "chunk_id", "rank", snippet("heading", 60).alias("heading"), snippet("text").alias("snippet"))
    return found.dropDuplicates(["query_id", "chunk_id"])


def postings_stats(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    size = index.length().agg(F.count("*").alias("docs"), F.sum("length").alias("occurrences"), F.round(F.avg("length"), 6).alias("average_length"))
    seen = index.postings.groupBy("term", "doc").agg(F.sum(F.size("places")).alias("f"))
    return seen.agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.max("f").alias("most")).join(size)


def term_idf(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    total = index.lengths.count()
    seen = index.postings.select("term", "doc").distinct().groupBy("term").agg(F.count("*").alias("docs"))
    return seen.withColumn("idf", F.round(retrieval.idf(F.col("docs"), total), 9))


def phrase_matches(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunks hold each control id that a query names, as a phrase."""
    groups = _queries(spark, folder).select(F.explode(retrieval.query_groups("query")).alias("grp")).where("grp rlike '-'").distinct()
    counts = retrieval.group_counts(_index(spark, folder).postings, groups)
    return groups.join(counts, "grp", "left").groupBy(F.col("grp").alias("phrase")).agg(F.count("doc").alias("chunks"), F.coalesce(F.sum("f"), F.lit(0)).alias("occurrences"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), rows.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))


def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.knn(*_vectors(spark, folder)).select("query_id", "doc", "rank", F.round("score", 6).alias("score"))


def knn_inner_product(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.knn(*_vectors(spark, folder), cosine=False).select("query_id", "doc", "rank", F.round("score", 6).alias("score"))


def knn_label_purity(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each query's neighbours that carry its label."""
    labels = table(spark, folder, "embeddings", "vec_id", "label")
    near = retrieval.knn(*_vectors(spark, folder), k=11).where("doc <> query_id")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return near.join(labels.select(F.col("vec_id").alias("doc"), "label"), "doc").join(own, "query_id").groupBy("own").agg(F.count("*").alias("neighbours"), F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 9).alias("share"))


def _rankings(spark: SparkSession, folder: str) -> DataFrame:
    both = _bm25(spark, folder, 50).withColumn("mode", F.lit("bm25"))
    return both.select("query_id", "doc", "score", "rank", "mode").unionByName(_dense(spark, folder, 50).withColumn("mode", F.lit("dense")))


def search_dense(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder, 10).select("query_id", F.col("doc").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


def embed_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The vector table after a second run, which finds nothing missing."""
    path = _vector_table(spark, folder)
    again = vectors.embed_missing(_docs(spark, folder), path, embeddings.hashed("heading", "text"), HASHED, embeddings.SIZE)
    model, size = vectors.manifest(spark, path)
    rows = vectors.read_vectors(spark, path)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.agg(F.count("*").alias("vectors"), F.count_if(F.abs(norm - 1) < 1e-9).alias("of_length_1")).select(F.lit(model).alias("model"), F.lit(size).alias("dimensions"), F.lit(again).cast("long").alias("added_again"), "vectors", "of_length_1")


def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    fused = retrieval.rrf(_rankings(spark, folder))
    return fused.select("query_id", F.col("doc").alias("chunk_id"), "rank", F.round("score", 9).alias("score"), F.round(F.try_element_at("sources", F.lit("bm25")), 6).alias("bm25"), F.round(F.try_element_at("sources", F.lit("dense")), 6).alias("dense"))


def rerank_noop(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder, 30).where("rank <= 8").select("query_id", F.col("doc").alias("chunk_id"), "rank")


def rerank_listwise(spark: SparkSession, folder: str) -> DataFrame:
    """The heading ranking's first ten, as a judge's list, over the pool of thirty."""
    pool = _bm25(spark, folder, 30)
    listed = _bm25(spark, folder, 10, ("heading",)).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("docs"))
    return retrieval.rerank_listwise(pool, listed, 8).select("query_id", F.col("doc").alias("chunk_id"), "was", "rank")


def rerank_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """Another score over the same pool: here the chunk's number of terms."""
    pool = _bm25(spark, folder, 30)
    size = _index(spark, folder).length()  # from the counts that the search wrote
    return retrieval.rerank_by(pool.join(size, "doc"), "length", 8).select("query_id", F.col("doc").alias("chunk_id"), "was", "rank", "length")


def _golden(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    rows = table(spark, folder, "v2", "id", "type", "source_citations").where((number % 50 == 0) & (F.col("type") != "unanswerable"))
    return rows.select(F.col("id").alias("query_id"), F.col("source_citations").alias("citations")).distinct()


def _metrics(spark: SparkSession, folder: str, rankings: DataFrame) -> DataFrame:
    chunks = table(spark, folder, "chunks", "chunk_id", "doc_id", "section_ids").withColumnRenamed("chunk_id", "doc").distinct()
    return ranking_eval.per_query(rankings, _golden(spark, folder), chunks)


def eval_per_query(spark: SparkSession, folder: str) -> DataFrame:
    out = _metrics(spark, folder, _bm25(spark, folder, 20))
    return out.select("query_id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


def eval_macro(spark: SparkSession, folder: str) -> DataFrame:
    return ranking_eval.macro(_metrics(spark, folder, _bm25(spark, folder, 20)))


def eval_rerank_paired(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline and reranked over the identical pool."""
    pool = _bm25(spark, folder, 30)
    size = _index(spark, folder).length()
    again = retrieval.rerank_by(pool.join(size, "doc"), "length", 10).select("query_id", "doc", "score", "rank")
    first = _metrics(spark, folder, pool.where("rank <= 10")).withColumn("ranking", F.lit("bm25"))
    return ranking_eval.macro(first.unionByName(_metrics(spark, folder, again).withColumn("ranking", F.lit("bm25+length"))), "ranking")


HASHED = "hashed-terms-md5"
_FOLD = "strip_accents(lower({}))"


def _bm25_sql(fields: tuple[str, ...], name: str, k: int) -> str:
    """CTEs that end in {name}(query_id, doc, score, rank)."""
    tokens = ", ".join(f"coalesce(regexp_extract_all({_FOLD.format(f)}, '[\\p{{L}}\\p{{N}}]+'), []) AS t{i}" for i, f in enumerate(fields))
    occ = " UNION ALL ".join(f"SELECT doc, {i} AS field, unnest(t{i}) AS term, generate_subscripts(t{i}, 1) AS at FROM {name}_t" for i in range(len(fields)))
    return f"""
{name}_t AS (SELECT doc, {tokens} FROM d), {name}_o AS ({occ}),
{name}_l AS (SELECT doc, {" + ".join(f"len(t{i})" for i in range(len(fields)))} AS length FROM {name}_t),
{name}_p AS (SELECT DISTINCT grp, string_split(grp, '-') AS ts FROM asked),
{name}_x AS (SELECT grp, len(ts) AS n, unnest(ts) AS term, generate_subscripts(ts, 1) AS off FROM {name}_p),
{name}_s AS (SELECT x.grp, x.n, o.doc, o.field, o.at - x.off AS start FROM {name}_o o JOIN {name}_x x USING (term) GROUP BY ALL HAVING count(*) = x.n),
{name}_c AS (SELECT grp, doc, count(*) AS f FROM {name}_s GROUP BY ALL),
{name}_n AS (SELECT grp, count(*) AS n FROM {name}_c GROUP BY 1),
{name}_g AS (SELECT count(*) AS total, avg(length) AS avg_length FROM {name}_l),
{name}_w AS (SELECT c.grp, c.doc, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END
   * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)) AS w FROM {name}_c c JOIN {name}_n USING (grp) JOIN {name}_l l USING (doc), {name}_g),
{name}_q AS (SELECT query_id, doc, round(sum(w * times), 9) AS score FROM {name}_w JOIN asked USING (grp) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::INT AS rank FROM {name}_q QUALIFY rank <= {k})"""


_BASE = """
WITH q AS (SELECT DISTINCT id AS query_id, question AS query FROM v2 WHERE regexp_extract(id, '(\\d+)$', 1)::BIGINT % 50 = 0),
asked AS (SELECT query_id, grp, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(FOLDQ, '[\\p{L}\\p{N}]+(?:-[\\p{L}\\p{N}]+)*')) AS grp FROM q) GROUP BY ALL),
d AS (SELECT DISTINCT chunk_id AS doc, heading, text FROM chunks),
g AS (SELECT DISTINCT id AS query_id, source_citations AS citations FROM v2 WHERE regexp_extract(id, '(\\d+)$', 1)::BIGINT % 50 = 0 AND type <> 'unanswerable')
""".replace("FOLDQ", _FOLD.format("query"))

_BOTH, _HEAD = ("heading", "text"), ("heading",)


def _eval_sql(rankings: str) -> str:
    """CTEs that end in m(query_id, ranking, recall_5, ...), of rows (ranking, query_id, doc, rank)."""
    return f"""
r AS ({rankings}),
c AS (SELECT query_id, unnest(citations) AS c, generate_subscripts(citations, 1) AS citation FROM g),
h AS (SELECT r.ranking, r.query_id, c.citation, r.rank FROM r JOIN (SELECT DISTINCT chunk_id, doc_id, section_ids FROM chunks) k ON k.chunk_id = r.doc
      JOIN c ON c.query_id = r.query_id AND c.c.doc = k.doc_id AND list_contains(k.section_ids, c.c.section)),
f AS (SELECT ranking, query_id, count(DISTINCT citation) FILTER (rank <= 5) AS c5, count(DISTINCT citation) FILTER (rank <= 10) AS c10, count(DISTINCT citation) FILTER (rank <= 20) AS c20,
      count(DISTINCT rank) FILTER (rank <= 5) AS p5, min(rank) FILTER (rank <= 20) AS first FROM h GROUP BY ALL),
fc AS (SELECT DISTINCT ranking, query_id, min(rank) AS rank FROM h GROUP BY ranking, query_id, citation HAVING min(rank) <= 10),
dc AS (SELECT ranking, query_id, sum(1 / log2(rank + 1.0)) AS dcg FROM fc GROUP BY ALL),
n AS (SELECT ranking, query_id, coalesce(len(citations), 0) AS n FROM g, (SELECT DISTINCT ranking FROM r)),
m AS (SELECT n.ranking, n.query_id, CASE WHEN n > 0 THEN coalesce(c5, 0) / n ELSE 0 END AS recall_5, CASE WHEN n > 0 THEN coalesce(c10, 0) / n ELSE 0 END AS recall_10,
      CASE WHEN n > 0 THEN coalesce(c20, 0) / n ELSE 0 END AS recall_20, coalesce(p5, 0) / 5 AS precision_5, coalesce(1.0 / first, 0)::DOUBLE AS mrr,
      CASE WHEN n > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg_10
      FROM n LEFT JOIN f USING (ranking, query_id) LEFT JOIN dc USING (ranking, query_id))"""


_NAMES = ("recall_5", "recall_10", "recall_20", "precision_5", "mrr", "ndcg_10")
_MACRO = "count(*) AS queries, " + ", ".join(f"round(avg({n}), 9) AS {n}" for n in _NAMES)

QUERIES = {
    f.__name__: f
    for f in (search_bm25, search_dense, embed_manifest, search_with_text, postings_stats, term_idf, phrase_matches, knn_cosine, knn_inner_product, knn_label_purity, hybrid_rrf, rerank_noop, rerank_listwise, rerank_by_length, eval_per_query, eval_macro, eval_rerank_paired)
}

#: CTEs that end in e(query_id, doc, score, rank): cosine of hashed terms, from the terms b_o of _bm25_sql.
_DENSE = r""", qo AS (SELECT query_id, unnest(regexp_extract_all(strip_accents(lower(query)), '[\p{L}\p{N}]+')) AS term FROM q),
ev AS (SELECT doc, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS j, sum(CASE WHEN substr(md5(term), 5, 1) < '8' THEN 1 ELSE -1 END) AS x FROM b_o GROUP BY ALL),
eq AS (SELECT query_id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS j, sum(CASE WHEN substr(md5(term), 5, 1) < '8' THEN 1 ELSE -1 END) AS x FROM qo GROUP BY ALL),
en AS (SELECT doc, sqrt(sum(x * x)) AS n FROM ev GROUP BY 1), em AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM eq GROUP BY 1),
ep AS (SELECT query_id, doc, sum(a.x * b.x) AS p FROM eq a JOIN ev b USING (j) GROUP BY ALL),
es AS (SELECT query_id, doc, round(p / (em.n * en.n), 9) AS score FROM ep JOIN en USING (doc) JOIN em USING (query_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::INT AS rank FROM es QUALIFY rank <= {})
"""


def _dense_sql(k: int) -> str:
    return _DENSE.replace("rank <= {}", f"rank <= {k}")


_KNN = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc, round({}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::INT AS rank FROM s)
"""
_COSINE, _INNER = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"

SQL = {
    "search_bm25": _BASE + "," + _bm25_sql(_BOTH, "b", 10) + " SELECT query_id, doc AS chunk_id, rank, round(score, 6) AS score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS normalised FROM b",
    "search_with_text": _BASE + "," + _bm25_sql(_BOTH, "b", 3) + " SELECT query_id, doc AS chunk_id, rank, substring(heading, 1, 60) AS heading, substring(text, 1, 300) AS snippet FROM b JOIN d USING (doc)",
    "postings_stats": _BASE
    + "," + _bm25_sql(_BOTH, "b", 1)
    + ", o AS (SELECT term, doc, count(*) AS f FROM b_o GROUP BY ALL) SELECT (SELECT count(*) FROM o) AS postings, (SELECT count(DISTINCT term) FROM o) AS terms, (SELECT max(f) FROM o) AS most, count(*) AS docs, sum(length)::BIGINT AS occurrences, round(avg(length), 6) AS average_length FROM b_l",
    "term_idf": _BASE
    + "," + _bm25_sql(_BOTH, "b", 1)
    + ", o AS (SELECT term, count(DISTINCT doc) AS docs FROM b_o GROUP BY 1), i AS (SELECT term, docs, ln((total - docs + 0.5) / (docs + 0.5)) AS raw FROM o, b_g) SELECT term, docs, round(CASE WHEN raw > 0 THEN raw ELSE 1e-6 END, 9) AS idf FROM i",
    "phrase_matches": _BASE
    + "," + _bm25_sql(_BOTH, "b", 1)
    + " SELECT p.grp AS phrase, count(c.doc) AS chunks, coalesce(sum(c.f), 0)::BIGINT AS occurrences FROM b_p p LEFT JOIN b_c c USING (grp) WHERE p.grp LIKE '%-%' GROUP BY 1",
    "knn_cosine": _KNN.format(_COSINE) + "SELECT query_id, doc, rank, round(score, 6) AS score FROM r WHERE rank <= 10",
    "knn_inner_product": _KNN.format(_INNER) + "SELECT query_id, doc, rank, round(score, 6) AS score FROM r WHERE rank <= 10",
    "knn_label_purity": _KNN.format(_COSINE)
    + "SELECT a.label AS own, count(*) AS neighbours, round(avg((a.label = b.label)::INT), 9) AS share FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc WHERE rank <= 11 AND doc <> query_id GROUP BY 1",
    "hybrid_rrf": _BASE
    + "," + _bm25_sql(_BOTH, "b", 50) + _dense_sql(50)
    + """, u AS (SELECT *, 'bm25' AS mode FROM b UNION ALL SELECT *, 'dense' FROM e),
f AS (SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, max(score) FILTER (mode = 'bm25') AS bm25, max(score) FILTER (mode = 'dense') AS dense FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc)::INT AS rank FROM f QUALIFY rank <= 10)
SELECT query_id, doc AS chunk_id, rank, round(score, 9) AS score, round(bm25, 6) AS bm25, round(dense, 6) AS dense FROM r""",
    "search_dense": _BASE + "," + _bm25_sql(_BOTH, "b", 1) + _dense_sql(10) + " SELECT query_id, doc AS chunk_id, rank, round(score, 6) AS score FROM e",
    "embed_manifest": _BASE + "," + _bm25_sql(_BOTH, "b", 1) + _dense_sql(1) + " SELECT 'hashed-terms-md5' AS model, 64 AS dimensions, 0::BIGINT AS added_again, (SELECT count(*) FROM d) AS vectors, count(*) FILTER (n > 0) AS of_length_1 FROM en",
    "rerank_noop": _BASE + "," + _bm25_sql(_BOTH, "b", 8) + " SELECT query_id, doc AS chunk_id, rank FROM b",
    "rerank_listwise": _BASE
    + "," + _bm25_sql(_BOTH, "b", 30) + "," + _bm25_sql(_HEAD, "e", 10)
    + ", r AS (SELECT b.query_id, b.doc AS chunk_id, b.rank AS was, row_number() OVER (PARTITION BY b.query_id ORDER BY e.rank NULLS LAST, b.rank)::INT AS place FROM b LEFT JOIN e USING (query_id, doc)) SELECT query_id, chunk_id, was, place AS rank FROM r WHERE place <= 8",
    "rerank_by_length": _BASE
    + "," + _bm25_sql(_BOTH, "b", 30)
    + " SELECT query_id, doc AS chunk_id, b.rank AS was, row_number() OVER (PARTITION BY query_id ORDER BY length DESC, b.rank)::INT AS rank, length::INT AS length FROM b JOIN b_l USING (doc) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length DESC, b.rank) <= 8",
    "eval_per_query": _BASE + "," + _bm25_sql(_BOTH, "b", 20) + "," + _eval_sql("SELECT 'x' AS ranking, query_id, doc, rank FROM b") + " SELECT query_id, " + ", ".join(f"round({n}, 9) AS {n}" for n in _NAMES) + " FROM m",
    "eval_macro": _BASE + "," + _bm25_sql(_BOTH, "b", 20) + "," + _eval_sql("SELECT 'x' AS ranking, query_id, doc, rank FROM b") + " SELECT " + _MACRO + " FROM m",
    "eval_rerank_paired": _BASE
    + "," + _bm25_sql(_BOTH, "b", 30)
    + ", z AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY length DESC, b.rank)::INT AS rank FROM b JOIN b_l USING (doc)),"
    + _eval_sql("SELECT 'bm25' AS ranking, query_id, doc, rank FROM b WHERE rank <= 10 UNION ALL SELECT 'bm25+length', query_id, doc, rank FROM z WHERE rank <= 10")
    + " SELECT ranking, " + _MACRO + " FROM m GROUP BY 1",
}
