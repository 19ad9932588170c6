"""Retrieval and vector queries. The query text is the first benchmark passage, the query vector that of the smallest id."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.vectors import centroids, cosine
from loomspark.operators import retrieval as R
from loomspark.operators import similarity as S
from loomspark.plans.registry import query
from loomspark.sources.tables import read

TERMS = ["the", "and", "with", "reth", "nicht", "para"]


def first_vector(spark, d):
    row = read(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()
    return F.array(*[F.lit(float(x)).cast("double") for x in (row["embedding"] if row else [])])


_TOKENS = r"""
tok AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\w\sæøå]', ' ', 'g'), '\s+'), lambda w: w <> '') AS w FROM documents),
rows AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS len, w FROM tok),
terms AS (SELECT unnest(['the', 'and', 'with', 'reth', 'nicht', 'para']) AS t),
tf AS (SELECT doc_id, t, len, CAST(len(list_filter(w, lambda x: x = t)) AS DOUBLE) AS tf FROM rows CROSS JOIN terms),
facts AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS avg_len FROM rows),
dfs AS (SELECT t, CAST(count(*) FILTER (WHERE tf > 0) AS DOUBLE) AS df FROM tf GROUP BY t),
raw AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * tf.len / avg_len))) / 6 AS s
  FROM tf JOIN dfs USING (t) CROSS JOIN facts GROUP BY doc_id),
lex AS (SELECT doc_id, s / greatest((SELECT max(s) FROM raw), 1.0) AS lexical_score FROM raw)"""
_COS = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
cs AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS score FROM embeddings CROSS JOIN q)"""


@query("bm25_topk", f"WITH {_TOKENS} SELECT doc_id, round(lexical_score, 6) AS score FROM lex ORDER BY lexical_score DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    scored = R.bm25(read(spark, d, "documents"), TERMS, "doc_id", "text")
    return R.top_k(scored, "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query("cosine_topk", f"WITH {_COS} SELECT vec_id, round(score, 6) AS score FROM cs ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    scored = R.cosine_scores(read(spark, d, "embeddings"), first_vector(spark, d), "vec_id", "embedding")
    return R.top_k(scored, "vec_id", 20).select("vec_id", F.round("score", 6).alias("score"))


@query("hybrid_topk", f"""WITH {_TOKENS}, {_COS},
f AS (SELECT coalesce(vec_id, doc_id) AS doc_id, coalesce(score, 0) AS v, coalesce(lexical_score, 0) AS l FROM cs FULL JOIN lex ON vec_id = doc_id)
SELECT doc_id, round(v, 6) AS vector_score, round(l, 6) AS lexical_score, round(0.7 * v + 0.3 * l, 6) AS score FROM f
WHERE 0.7 * v + 0.3 * l >= 0.3 ORDER BY 0.7 * v + 0.3 * l DESC, doc_id LIMIT 20""")
def hybrid_topk(spark, d):
    lexical = R.bm25(read(spark, d, "documents"), TERMS, "doc_id", "text")
    vector = R.cosine_scores(read(spark, d, "embeddings"), first_vector(spark, d), "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    out = R.top_k(R.combine(vector, lexical, "doc_id"), "doc_id", 20, 0.3)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("vector_score", "lexical_score", "score")])


@query("score_fusion", f"""WITH {_TOKENS}, {_COS}
SELECT coalesce(vec_id, doc_id) AS doc_id, round(0.7 * coalesce(score, 0) + 0.3 * coalesce(lexical_score, 0), 6) AS score FROM cs FULL JOIN lex ON vec_id = doc_id""")
def score_fusion(spark, d):
    lexical = R.bm25(read(spark, d, "documents"), TERMS, "doc_id", "text")
    vector = R.cosine_scores(read(spark, d, "embeddings"), first_vector(spark, d), "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    return R.combine(vector, lexical, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("diversified_topk", f"""WITH {_COS}, r AS (SELECT vec_id, label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS own FROM cs JOIN embeddings USING (vec_id))
SELECT vec_id, label, round(score, 6) AS score FROM r WHERE own <= 3 ORDER BY r.score DESC, vec_id LIMIT 12""")
def diversified_topk(spark, d):
    rows = read(spark, d, "embeddings")
    scored = rows.select("vec_id", "label", cosine(F.col("embedding"), first_vector(spark, d)).alias("score"))
    return R.top_k(scored, "vec_id", 12, source="label", max_per_source=3).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("substance_retrieval", f"""WITH {_COS}, s AS (SELECT doc_id, least(1.0, score + 0.15 * CAST(lower(source) LIKE '%src1%' AS INT) + 0.08 * CAST(lower(text) LIKE '%the%' AS INT)
  + 0.15 * CAST(lower(source) LIKE '%the%' AS INT) + 0.08 * CAST(lower(text) LIKE '%src1%' AS INT)) AS score FROM cs JOIN documents ON vec_id = doc_id)
SELECT doc_id, round(score, 6) AS score FROM s WHERE score >= 0.3 ORDER BY s.score DESC, doc_id LIMIT 15""")
def substance_retrieval(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    out = R.boosted(rows, first_vector(spark, d), ["src1", "the"], "doc_id", "embedding", F.col("source"), F.col("text"))
    return out.select("doc_id", F.round("score", 6).alias("score"))


_PAIRS = """p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


@query("pairwise_cosine_threshold", f"WITH {_PAIRS} SELECT i, j, round(sim, 6) AS sim FROM p WHERE sim >= 0.35")
def pairwise_cosine_threshold(spark, d):
    return S.all_pairs(read(spark, d, "embeddings"), "vec_id", "embedding", 0.35).select("i", "j", F.round("sim", 6).alias("sim"))


@query("similarity_distribution", f"""WITH {_PAIRS}, s AS (SELECT sim FROM p)
SELECT count(*) AS n, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std,
 round(list_sort(list(sim))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1], 6) AS median,
 round(list_sort(list(sim))[CAST(floor(count(*) * 0.1) AS BIGINT) + 1], 6) AS p10,
 round(list_sort(list(sim))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1], 6) AS p90,
 round(1 - avg(sim), 6) AS diversity FROM s""")
def similarity_distribution(spark, d):
    return S.distribution(read(spark, d, "embeddings"), "vec_id", "embedding")


@query("label_centroids", """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
SELECT label, dim, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM e GROUP BY label, dim""")
def label_centroids(spark, d):
    c = centroids(read(spark, d, "embeddings"), ["label"], "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", (F.col("pos") + 1).cast("long").alias("dim"), F.round("v", 6).alias("x"))


_CENT = """e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY label, dim), c AS (SELECT label AS cluster, list(x ORDER BY dim) AS v FROM m GROUP BY label)"""


@query("nearest_centroid", f"""WITH {_CENT}, s AS (SELECT vec_id, cluster, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS sim FROM embeddings CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, cluster) AS r FROM s)
SELECT vec_id, CASE WHEN sim >= 0.2 THEN cluster END AS cluster, round(sim, 6) AS sim FROM r WHERE r = 1""")
def nearest_centroid(spark, d):
    rows = read(spark, d, "embeddings")
    cents = centroids(rows, ["label"], "embedding").withColumnsRenamed({"label": "cluster"})
    return S.nearest(rows, cents, "vec_id", "embedding", "cluster", 0.2)


@query("centroid_outliers", f"""WITH {_CENT}, s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS sim FROM embeddings JOIN c ON cluster = label),
g AS (SELECT label, avg(sim) AS m, stddev_pop(sim) AS sd FROM s GROUP BY label)
SELECT vec_id, label, round(sim, 6) AS sim, sim < m - 1.5 * sd AS outlier FROM s JOIN g USING (label)""")
def centroid_outliers(spark, d):
    return S.outliers(read(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query("embedding_issues", "SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'dimension' ELSE 'ok' END AS issue, count(*) AS n FROM embeddings GROUP BY 1")
def embedding_issues(spark, d):
    e = F.col("embedding")
    issue = F.when(e.isNull(), "missing").when(F.size(e) == 0, "empty").when(F.size(e) != 64, "dimension").otherwise("ok")
    return read(spark, d, "embeddings").groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


@query("semantic_diversity", """WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 20)
SELECT round(1 - avg(list_cosine_similarity(a.v, b.v)), 6) AS diversity FROM f a JOIN f b ON a.vec_id < b.vec_id""")
def semantic_diversity(spark, d):
    first = read(spark, d, "embeddings").orderBy("vec_id").limit(20)
    return S.cosine_pairs(first, "vec_id", "embedding").agg(F.round(1 - F.avg("sim"), 6).alias("diversity"))


@query("similarity_clusters", f"""WITH RECURSIVE {_PAIRS}, ed AS (SELECT i AS a, j AS b FROM p WHERE sim >= 0.35 UNION ALL SELECT j, i FROM p WHERE sim >= 0.35),
w AS (SELECT vec_id AS n, vec_id AS l FROM embeddings UNION SELECT ed.b, w.l FROM w JOIN ed ON ed.a = w.n)
SELECT n AS vec_id, min(l) AS component FROM w GROUP BY n""")
def similarity_clusters(spark, d):
    from loomspark.operators.graph import components

    rows = read(spark, d, "embeddings")
    pairs = S.all_pairs(rows, "vec_id", "embedding", 0.35)
    return components(rows.select("vec_id"), pairs.select(F.col("i").alias("a"), F.col("j").alias("b")), "vec_id")


@query("lsh_pairs")
def lsh_pairs(spark, d):
    return S.lsh_pairs(read(spark, d, "embeddings"), "vec_id", "embedding", 0.35).select("i", "j", F.round("sim", 6).alias("sim"))


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return S.kmeans(read(spark, d, "embeddings"), "vec_id", "embedding", 8)
