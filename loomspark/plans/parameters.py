"""Parameters per consultation; a source of documents stands for one."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import parameters as P
from loomspark.plans.registry import query
from loomspark.sources.tables import read


@query("retrieval_params", """
WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
k AS (SELECT *, CASE WHEN n <= 10 THEN greatest(3, n) WHEN n <= 50 THEN least(10, CAST(ceil(n * 0.3) AS BIGINT)) WHEN n <= 200 THEN 20 WHEN n <= 500 THEN 30 ELSE 40 END AS k FROM n)
SELECT source, lang, n, k, CASE WHEN k <= 5 THEN greatest(2, k) WHEN k <= 10 THEN CAST(ceil(k * 0.6) AS BIGINT) WHEN k <= 20 THEN 10 ELSE least(15, CAST(ceil(k * 0.5) AS BIGINT)) END AS rerank,
 CASE WHEN n <= 20 THEN n WHEN n <= 100 THEN 50 ELSE 100 END AS embedding_batch,
 CASE WHEN n <= 5 THEN 'tiny' WHEN n <= 20 THEN 'small' WHEN n <= 50 THEN 'medium' WHEN n <= 150 THEN 'large' ELSE 'xlarge' END AS scale,
 CASE WHEN n <= 5 THEN 10 WHEN n <= 10 THEN 30 WHEN n <= 20 THEN 50 ELSE 100 END AS validations FROM k""")
def retrieval_params(spark, d):
    rows = read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    n = F.col("n")
    rows = rows.withColumn("k", P.retrieval_k(n))
    return rows.select(
        "source", "lang", "n", "k", P.rerank_k(F.col("k")).alias("rerank"), P.embedding_batch(n).alias("embedding_batch"), P.by_bands(n, P.SCALE).alias("scale"), P.by_bands(n, P.VALIDATIONS).alias("validations")
    )


@query("model_batches", """
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n <= 5 THEN n WHEN n <= 10 THEN least(10, n) WHEN n <= 20 THEN 15 ELSE 20 END AS batch, list_transform(range(0, greatest(CAST(ceil(n / 4) AS BIGINT), 1)), lambda i: least(n - i * 4, 4)) AS sizes FROM n""")
def model_batches(spark, d):
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return rows.select("conv_id", P.model_batch(F.col("n")).alias("batch"), P.batches(F.col("n"), 4).alias("sizes"))


@query("explosion_ratio", """
WITH n AS (SELECT l_suppkey, count(*) AS a, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, p / a AS ratio FROM n),
s AS (SELECT *, CASE WHEN ratio > 0.7 THEN 'TOO_MANY_POSITIONS' WHEN ratio > 0.5 THEN 'SLIGHTLY_HIGH' WHEN ratio < 0.3 THEN 'GOOD_CONSOLIDATION' WHEN ratio < 0.4 THEN 'OPTIMAL' ELSE 'ACCEPTABLE' END AS status FROM r)
SELECT l_suppkey, round(ratio, 6) AS ratio, status, round(greatest(0.60, least(0.90, 0.82 + CASE status WHEN 'TOO_MANY_POSITIONS' THEN -0.03 WHEN 'SLIGHTLY_HIGH' THEN -0.01 ELSE 0 END)), 6)::DOUBLE AS threshold FROM s""")
def explosion_ratio(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("a"), F.count_distinct("l_partkey").alias("p"))
    found = P.explosion(F.col("a"), F.col("p"), F.lit(0.82))
    return rows.select("l_suppkey", F.round(found["ratio"], 6).alias("ratio"), found["status"].alias("status"), F.round(found["threshold"], 6).alias("threshold"))


@query("position_verbosity", """
WITH n AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS r, count(DISTINCT l_suppkey) AS m FROM lineitem GROUP BY 1)
SELECT l_partkey, CASE WHEN r > 20 OR m > 5 THEN 'high' WHEN r > 10 OR m > 3 THEN 'medium' ELSE 'low' END AS verbosity,
 CASE WHEN r <= 15 THEN 1 WHEN r <= 40 THEN 2 WHEN r <= 100 THEN 4 WHEN r <= 300 THEN 5 WHEN r <= 800 THEN 7 ELSE 10 END AS sentences FROM n""")
def position_verbosity(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("r"), F.count_distinct("l_suppkey").alias("m"))
    return rows.select("l_partkey", P.verbosity(F.col("r"), F.col("m")).alias("verbosity"), P.by_bands(F.col("r"), P.SENTENCES_MIN).alias("sentences"))


@query("placeholder_texts", """
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'Se vedhæftet.' WHEN doc_id % 50 = 2 THEN ' ' ELSE text END AS text FROM documents)
SELECT doc_id FROM t WHERE trim(text) = '' OR regexp_matches(lower(trim(text)), '^se vedhæft(et|ning)\\.?$')""".replace("\\\\", "\\"))
def placeholder_texts(spark, d):
    text = F.when(F.col("doc_id") % 50 == 1, "Se vedhæftet.").when(F.col("doc_id") % 50 == 2, " ").otherwise(F.col("text"))
    return read(spark, d, "documents").where(P.is_placeholder(text)).select("doc_id")


@query("mixed_scope", """
WITH f AS (SELECT doc_id, lang = 'de' AS section, source = 'src1' AS theme, contains(text, 'license') AS concept, CAST(contains(text, '@') AS INT) + CAST(contains(text, 'token') AS INT) AS examples FROM documents),
r AS (SELECT doc_id, examples, CASE WHEN section THEN 'section' WHEN theme THEN 'theme' WHEN concept THEN 'concept' WHEN examples > 0 THEN 'example' ELSE 'uncertain' END AS reason FROM f)
SELECT doc_id, reason, reason <> 'example' AS in_scope, CAST(CASE reason WHEN 'section' THEN 0.95 WHEN 'theme' THEN 0.9 WHEN 'concept' THEN 0.8 WHEN 'example' THEN least(0.5 + 0.15 * examples, 0.95) ELSE 0.5 END AS DOUBLE) AS confidence FROM r""")
def mixed_scope(spark, d):
    from loomspark.operators.rules import scope

    examples = F.col("text").contains("@").cast("int") + F.col("text").contains("token").cast("int")
    found = scope(F.col("lang") == "de", F.col("source") == "src1", F.col("text").contains("license"), examples, F.lit(0))
    return read(spark, d, "documents").select("doc_id", *[found[k].alias(k) for k in ("reason", "in_scope", "confidence")])
