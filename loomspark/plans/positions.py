"""Queries on positions and labels: parts stand for positions, brands for themes, suppliers for members."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import labels as L
from loomspark.operators import positions as P
from loomspark.plans.registry import query
from loomspark.sources.tables import checkpointed, read

_POS = r"""m AS (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS members FROM lineitem GROUP BY 1),
pos AS (SELECT p_partkey AS id, p_brand AS theme, p_type AS title, members, list_distinct(list_filter(string_split_regex(regexp_replace(lower(p_type), '[^\w\sæøå]', ' ', 'g'), '\s+'), lambda w: w <> '')) AS w
  FROM part JOIN m ON l_partkey = p_partkey),
pr AS (SELECT a.id AS i, b.id AS j, a.members AS x, b.members AS y, len(a.members) AS n, len(b.members) AS k, len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(a.w || b.w)) AS DOUBLE) AS sim FROM pos a JOIN pos b ON a.theme = b.theme AND a.id <> b.id)"""


def positions(spark, d):
    members = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("members"))
    return read(spark, d, "part").join(members, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("theme"), F.col("p_type").alias("title"), "members")


@query("redundant_pairs", f"""WITH {_POS}, o AS (SELECT i, j, sim, len(list_intersect(x, y)) / CAST(least(n, k) AS DOUBLE) AS ov FROM pr WHERE i < j)
SELECT i AS id_1, j AS id_2, round(sim, 6) AS title_sim, round(ov, 6) AS overlap FROM o WHERE sim >= 0.85 OR (sim >= 0.6 AND ov >= 0.5)""")
def redundant_pairs(spark, d):
    return P.redundant(checkpointed(positions(spark, d)), "id", "theme", "title", "members", digits=6)


@query("micro_best_match", f"""WITH {_POS}, r AS (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, k DESC, j) AS r FROM pr WHERE n <= 25 AND k > 25 AND sim >= 0.3)
SELECT i AS small, j AS large, round(sim, 6) AS sim FROM r WHERE r = 1""")
def micro_best_match(spark, d):
    out = P.best_for_small(positions(spark, d), "id", "theme", "title", "members", 25, 0.3)
    return out.select("small", "large", F.round("sim", 6).alias("sim"))


@query("merge_candidates", """
WITH e AS (SELECT vec_id AS id, label, [vec_id % 7, vec_id % 11] AS members, vec_id % 2 AS d, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.id AS id_1, b.id AS id_2, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.label = b.label AND a.id < b.id AND a.d = b.d
WHERE list_cosine_similarity(a.v, b.v) >= CASE WHEN len(list_distinct(a.members)) = 1 OR len(list_distinct(b.members)) = 1 THEN 0.25 ELSE 0.3 END""")
def merge_candidates(spark, d):
    v = F.col("vec_id")
    rows = read(spark, d, "embeddings").select(v.alias("id"), "label", F.array_distinct(F.array(v % 7, v % 11)).alias("members"), F.when(v % 2 == 0, "pro").otherwise("contra").alias("stance"), "embedding")
    out = P.merge_candidates(rows, "id", "label", "members", "stance", "embedding", 0.3)
    return out.select("id_1", "id_2", F.round("sim", 6).alias("sim"))


@query("closest_theme", r"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS theme FROM part),
w AS (SELECT name, theme, list_distinct(string_split(lower(name), ' ')) AS a, list_distinct(string_split(lower(theme), ' ')) AS b FROM n CROSS JOIN t),
s AS (SELECT name, theme, len(list_intersect(a, b)) / CAST(len(list_distinct(a || b)) AS DOUBLE) AS sim FROM w),
c AS (SELECT name, theme, CASE WHEN lower(name) = lower(theme) THEN 3.0 WHEN contains(lower(name), lower(theme)) OR contains(lower(theme), lower(name)) THEN 2.0 WHEN sim > 0.25 THEN sim END AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC NULLS LAST, theme) AS r FROM c)
SELECT name, CASE WHEN score IS NOT NULL THEN theme END AS theme, round(CAST(score AS DOUBLE), 6) AS score FROM r WHERE r = 1""")
def closest_theme(spark, d):
    parts = read(spark, d, "part")
    out = P.closest_theme(parts.select(F.col("p_name").alias("name")), parts.select(F.get(F.split("p_name", " "), 1).alias("theme")), "name", "theme")
    return out.select("name", "theme", F.round("score", 6).alias("score"))


@query("orphan_members", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def orphan_members(spark, d):
    rows = read(spark, d, "lineitem")
    return P.lost_members(rows, rows.where("l_quantity >= 45"), "l_partkey")


@query("count_labels", """
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT *, CASE WHEN n <= 12 THEN ['én','to','tre','fire','fem','seks','syv','otte','ni','ti','elleve','tolv'][n] ELSE CAST(n AS VARCHAR) END AS word FROM n)
SELECT o_custkey, upper(substr(word, 1, 1)) || substr(word, 2) || ' ' || CASE WHEN n = 1 THEN 'borger' ELSE 'borgere' END AS label, CAST(n AS INT) AS parsed FROM w""")
def count_labels(spark, d):
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = rows.withColumn("label", L.with_noun("n"))
    return rows.select("o_custkey", "label", L.parsed_count("label").alias("parsed"))


@query("member_labels", """
WITH m AS (SELECT c_nationkey, list(c_name ORDER BY c_name) FILTER (WHERE c_acctbal > 9000) AS names, count(*) FILTER (WHERE c_acctbal <= -900) AS citizens FROM customer GROUP BY 1),
w AS (SELECT c_nationkey, coalesce(names, []) || CASE WHEN citizens > 0 THEN [CASE WHEN citizens <= 12 THEN ['én','to','tre','fire','fem','seks','syv','otte','ni','ti','elleve','tolv'][citizens] ELSE CAST(citizens AS VARCHAR) END || CASE WHEN citizens = 1 THEN ' borger' ELSE ' borgere' END] ELSE [] END AS p FROM m)
SELECT c_nationkey, CASE WHEN len(p) = 0 THEN '' WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[:len(p) - 1], ', ') || ' og ' || p[len(p)] END AS label FROM w""")
def member_labels(spark, d):
    rows = read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.when(F.col("c_acctbal") > 9000, F.col("c_name")))).alias("names"), F.count_if(F.col("c_acctbal") <= -900).alias("citizens"))
    return rows.select("c_nationkey", L.from_members(F.col("names"), F.col("citizens")).alias("label"))
