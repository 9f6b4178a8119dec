"""Queries of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import evaluate, fusion, knn
from .registered import query

_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
_COS = "list_cosine_similarity(embedding::DOUBLE[], v)"


def rows(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def first(t):
    return knn.vector_of(rows(t), "id", "vector", 0)


def rounded(df, name="score"):
    return df.select("id", F.round(name, 6).alias("score"))


@query("knn_topk", f"WITH {_Q} SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings CROSS JOIN q ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _(t):
    return rounded(knn.search(rows(t), "id", "vector", [first(t)], 10))


@query("knn_by_id", f"WITH {_Q} SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings CROSS JOIN q WHERE vec_id <> 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def _(t):
    return rounded(knn.by_id(rows(t), "id", "vector", 0, 10))


@query("similar_threshold", f"WITH {_Q} SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings CROSS JOIN q WHERE vec_id <> 0 AND {_COS} >= 0.2")
def _(t):
    return rounded(knn.by_id(rows(t), "id", "vector", 0, least=0.2))


@query(
    "knn_batch",
    """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings CROSS JOIN q)
    SELECT qid AS query, id, round(score, 6) AS score, CAST(r - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""",
)
def _(t):
    asked = rows(t).where("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    return knn.search_set(rows(t), "id", "vector", asked, 5).withColumn("score", F.round("score", 6))


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    nxt = rows(t).select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("vector").alias("other"))
    return rows(t).join(nxt, "id").select(F.col("id").alias("a"), "b", F.round(vectors.cosine(F.col("vector"), F.col("other")), 6).alias("cosine"))


@query("similarity_join", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def _(t):
    return knn.similarity_join(rows(t), "id", "vector", 0.3, "label").withColumn("score", F.round("score", 6))


@query(
    "binary_two_phase",
    f"""WITH {_Q}, c AS (SELECT vec_id, embedding, v, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding[i] > 0) <> (v[i] > 0) THEN 1 ELSE 0 END)) AS d FROM embeddings CROSS JOIN q ORDER BY d, vec_id LIMIT 80)
    SELECT vec_id AS id, round({_COS}, 6) AS score FROM c ORDER BY {_COS} DESC, vec_id LIMIT 10""",
)
def _(t):
    return rounded(knn.two_phase_binary(rows(t), "id", "vector", first(t), 10))


@query(
    "int8_two_phase",
    f"""WITH {_Q}, x AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS e FROM embeddings), m AS (SELECT i, min(e) AS lo, max(e) AS hi FROM x GROUP BY 1),
    z AS (SELECT vec_id, i, round(greatest(0, least(1, (e - lo) / (CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END))) * 255) - 128 AS c FROM x JOIN m USING (i)), zq AS (SELECT i, c AS qc FROM z WHERE vec_id = 0),
    p AS (SELECT vec_id, CAST(sum(c * qc) AS BIGINT) AS p FROM z JOIN zq USING (i) GROUP BY 1 ORDER BY p DESC, vec_id LIMIT 40)
    SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings JOIN p USING (vec_id) CROSS JOIN q ORDER BY {_COS} DESC, vec_id LIMIT 10""",
)
def _(t):
    return rounded(knn.two_phase_int8(rows(t), "id", "vector", first(t), 10))


@query(
    "mrl_rerank",
    f"""WITH {_Q}, c AS (SELECT vec_id, embedding, v, {_COS} AS f FROM embeddings CROSS JOIN q ORDER BY f DESC, vec_id LIMIT 40), s AS (SELECT vec_id AS id, 0.7 * f + 0.3 * list_cosine_similarity(embedding[1:16]::DOUBLE[], v[1:16]) AS score FROM c)
    SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10""",
)
def _(t):
    return rounded(knn.rerank_mrl(rows(t), "id", "vector", first(t), 10, 16))


@query("missing_vectors", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    return knn.missing_vectors(t.documents.select(F.col("doc_id").alias("id")), rows(t))


@query("knn_cells")
def _(t):
    """Cells probed for every row whose id is divisible by 20; tests hold the recall beside the exact search."""
    df = rows(t)
    centres = knn.fit_cells(df, "vector")
    index = knn.build_cells(df, "id", "vector", centres)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    return knn.search_cells(index, "id", "vector", centres, asked, 10).withColumn("score", F.round("score", 6))


@query(
    "knn_cells_all",
    """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings CROSS JOIN q)
    SELECT qid AS query, id, round(score, 6) AS score, CAST(r - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10""",
)
def _(t):
    """All cells probed, which is exact."""
    df = rows(t)
    centres = knn.fit_cells(df, "vector", 16)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    return knn.search_cells(knn.build_cells(df, "id", "vector", centres), "id", "vector", centres, asked, 10, 16).withColumn("score", F.round("score", 6))


@query("finite_check", "SELECT count(*) AS good FROM embeddings WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: NOT isfinite(x)))")
def _(t):
    return rows(t).where((F.size("vector") == 64) & vectors.is_finite(F.col("vector"))).agg(F.count(F.lit(1)).alias("good"))


@query("embed_hashed")
def _(t):
    return knn.embed(t.benchmark, "item_id", "text").select("item_id", F.size("vector").alias("dims"))


@query(
    "qtc_rerank",
    f"""WITH {_Q}, c AS (SELECT vec_id, label, embedding, {_COS} AS score FROM embeddings CROSS JOIN q), t20 AS (SELECT * FROM c ORDER BY score DESC, vec_id LIMIT 20), b AS (SELECT label, max(score) AS best FROM c GROUP BY 1)
    SELECT vec_id AS id, round(0.7 * best + 0.3 * score, 6) AS score FROM t20 JOIN b USING (label)""",
)
def _(t):
    """Chunks of a record are the vectors of its label here."""
    all_ = knn.search(rows(t), "id", "vector", [first(t)]).select("id", "score").join(rows(t).select("id", "label"), "id")
    chunks = all_.groupBy("label").agg(F.collect_list("score").alias("chunk_scores"))
    return rounded(fusion.chunk_rerank(fusion.top(all_, 20).join(chunks, "label"), F.lit("")))


@query(
    "eval_recall_at_k",
    """WITH q AS (SELECT vec_id AS qid, label AS ql, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, ql, vec_id AS id, label, row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) - 1 AS rank FROM embeddings CROSS JOIN q),
    r AS (SELECT qid, count(*) FILTER (WHERE rank < 10 AND label = ql) AS found, count(*) FILTER (WHERE label = ql) AS relevant, min(rank) FILTER (WHERE rank < 10 AND label = ql) AS f, count(*) FILTER (WHERE rank < 10 AND label <> ql) AS fp FROM s GROUP BY 1)
    SELECT qid AS query, found, relevant, round(found / CAST(relevant AS DOUBLE), 8) AS recall, found > 0 AS hit, round(coalesce(1.0 / (f + 1), 0), 8) AS reciprocal_rank, fp AS false_positives FROM r""",
)
def _(t):
    asked = rows(t).where("id % 20 = 0").select(F.col("id").alias("query"), "vector", "label")
    ranked = knn.search_set(rows(t), "id", "vector", asked, 10)
    got = evaluate.at_k_by_label(ranked, asked, rows(t), 10)
    return got.withColumn("recall", F.round("recall", 8)).withColumn("reciprocal_rank", F.round("reciprocal_rank", 8))
