"""Aggregation, ranking and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators import aggregation as A
from loomspark.operators import ranking as K
from loomspark.plans.registry import query
from loomspark.sources.tables import read


@query("respondent_breakdown", """
SELECT c_nationkey, coalesce(list_sort(list(DISTINCT c_name) FILTER (WHERE c_mktsegment = 'MACHINERY')), []) AS authority_names,
 coalesce(list_sort(list(DISTINCT c_name) FILTER (WHERE c_mktsegment = 'BUILDING')), []) AS committee_names,
 coalesce(list_sort(list(DISTINCT c_name) FILTER (WHERE c_mktsegment = 'FURNITURE')), []) AS organization_names,
 count(*) FILTER (WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'FURNITURE')) AS citizens, count(*) AS total FROM customer GROUP BY 1""")
def respondent_breakdown(spark, d):
    seg = F.col("c_mktsegment")
    kind = F.when(seg == "MACHINERY", "authority").when(seg == "BUILDING", "committee").when(seg == "FURNITURE", "organization").otherwise("citizen")
    return A.breakdown(read(spark, d, "customer"), ["c_nationkey"], "c_name", kind)


@query("direction_majority", """
WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2), t AS (SELECT conv_id, max(n) AS m, sum(n) AS t FROM c GROUP BY 1)
SELECT t.conv_id, CASE WHEN m / t > 0.5 THEN (SELECT min(role) FROM c WHERE c.conv_id = t.conv_id AND c.n = m) END AS top, round(m / t, 6) AS top_share FROM t""")
def direction_majority(spark, d):
    return A.majority(read(spark, d, "conversations"), ["conv_id"], F.col("role"), 0.5).withColumn("top_share", F.round("top_share", 6))


@query("mixed_directions", """
WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_pro, count(*) FILTER (WHERE role = 'assistant') AS n_contra FROM conversations GROUP BY 1)
SELECT *, CASE WHEN n_pro > n_contra THEN 'pro' WHEN n_contra > n_pro THEN 'contra' ELSE 'neutral' END AS direction,
 CASE WHEN n_pro >= 2 AND n_contra >= 2 THEN 'high' WHEN n_pro >= 1 AND n_contra >= 1 THEN 'low' ELSE 'none' END AS mixed FROM c""")
def mixed_directions(spark, d):
    return A.stance(read(spark, d, "conversations"), ["conv_id"], F.col("role") == "user", F.col("role") == "assistant")


@query("herfindahl", """
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share FROM c)
SELECT lang, round(sum(share * share), 6) AS concentration, count(*) AS values,
 coalesce(list(source ORDER BY n DESC, source) FILTER (WHERE share > 0.2), [])[:3] AS dominant FROM s GROUP BY lang""")
def herfindahl(spark, d):
    return A.herfindahl(read(spark, d, "documents"), "source", ["lang"]).withColumn("concentration", F.round("concentration", 6))


@query("coverage_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_orphans(spark, d):
    return A.coverage(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("coverage_catch_all", """
SELECT CAST(quality AS VARCHAR) AS theme, doc_id FROM labels UNION ALL SELECT 'other', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def coverage_catch_all(spark, d):
    members = read(spark, d, "labels").select(F.col("quality").cast("string").alias("theme"), "doc_id")
    return A.with_catch_all(members, read(spark, d, "documents"), "doc_id", "theme", "other")


@query("merge_groups", """
SELECT l_suppkey AS component, list_sort(list(DISTINCT l_orderkey)) AS members, min_by(l_shipmode_like, (-length(l_shipmode_like), l_shipmode_like)) AS summary
FROM (SELECT *, l_returnflag || repeat('x', CAST(l_linenumber AS INT)) AS l_shipmode_like FROM lineitem) GROUP BY 1""")
def merge_groups(spark, d):
    rows = read(spark, d, "lineitem")
    rows = rows.select(F.col("l_suppkey").alias("component"), "l_orderkey", F.concat("l_returnflag", F.repeat(F.lit("x"), F.col("l_linenumber").cast("int"))).alias("s"))
    return A.merged_groups(rows, "component", "l_orderkey", "s")


@query("overlapping_groups", """
WITH m AS (SELECT DISTINCT s_nationkey AS g, p_size AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
s AS (SELECT g, count(*) AS n FROM m GROUP BY 1), c AS (SELECT a.g AS g1, b.g AS g2, count(*) AS common FROM m a JOIN m b USING (member) WHERE a.g < b.g GROUP BY 1, 2)
SELECT g1, g2, common, round(common / least(x.n, y.n), 6) AS coefficient FROM c JOIN s x ON x.g = g1 JOIN s y ON y.g = g2 WHERE common / least(x.n, y.n) >= 0.5 AND greatest(x.n, y.n) > 1""")
def overlapping_groups(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.overlapping_groups(rows, "s_nationkey", "p_size").withColumn("coefficient", F.round("coefficient", 6))


@query("multi_membership", "SELECT l_partkey, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def multi_membership(spark, d):
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("groups")).where("groups > 1")


@query("key_topics", r"""
WITH w AS (SELECT lang, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\w\sæøå]', ' ', 'g'), '\s+'), lambda x: length(x) > 4)) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c)
SELECT lang, word, n, rank FROM r WHERE rank <= 5""")
def key_topics(spark, d):
    from loomspark.functions.text import words_over

    return A.word_counts(read(spark, d, "documents"), ["lang"], words_over("text", 4), 5)


@query("corpus_stats", """
SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, count(DISTINCT source) AS sources,
 count(*) FILTER (WHERE length(text) < 100) AS short FROM documents GROUP BY lang""")
def corpus_stats(spark, d):
    n = F.length("text")
    return read(spark, d, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.count_distinct("source").alias("sources"), F.count_if(n < 100).alias("short")
    )


@query("global_statistics", """
SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total, count(*) FILTER (WHERE c_acctbal < 0) AS negative
FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def global_statistics(spark, d):
    return read(spark, d, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))


@query("quality_score", """
WITH q AS (SELECT source, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 0) AS low FROM labels JOIN documents USING (doc_id) GROUP BY 1),
s AS (SELECT source, greatest(100.0 - least(toxic * 5.0, 40.0) - least(low * 2.0, 30.0), 0.0) AS score FROM q)
SELECT source, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def quality_score(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("low"))
    score = A.quality_score({"toxic": (F.col("toxic"), 5.0, 40.0), "low": (F.col("low"), 2.0, 30.0)})
    return rows.select("source", score.alias("score"), A.grade(score).alias("grade"))


@query("confidence_bands", """
WITH s AS (SELECT doc_id, round(CAST(0.3 AS DOUBLE) * least(n_chars / CAST(2000 AS DOUBLE), 1.0) + 0.25 * CAST(quality = 1 AS INT) + 0.25 * CAST(toxic = 0 AS INT) + 0.2 * CAST(lang = 'en' AS INT) + CAST(1e-9 AS DOUBLE), 2) AS confidence FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN confidence < 0.6 THEN 'high' WHEN confidence < 0.75 THEN 'medium' ELSE 'low' END AS priority FROM s""")
def confidence_bands(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    flag = lambda c: c.cast("double")
    parts = [(F.least(F.col("n_chars") / 2000, F.lit(1.0)), 0.3), (flag(F.col("quality") == 1), 0.25), (flag(F.col("toxic") == 0), 0.25), (flag(F.col("lang") == "en"), 0.2)]
    return rows.withColumns(A.weighted_confidence(parts, 0.6, 0.75)).select("doc_id", "confidence", "priority")


@query("priority_sort", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_orderpriority, o_totalprice DESC, o_orderkey) AS position FROM orders""")
def priority_sort(spark, d):
    out = K.priority_order(read(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "P", F.col("o_orderpriority"), F.col("o_totalprice"), "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "position")


@query("diverse_sample", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM r WHERE i % greatest(n // 20, 1) = 0 AND i // greatest(n // 20, 1) < 20""")
def diverse_sample(spark, d):
    return K.every_kth(read(spark, d, "documents"), 20, ["lang"], [F.length("text"), F.col("doc_id")]).select("doc_id", "lang")


@query("representative_sample", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM r WHERE i < 4 OR i >= n - 4 OR (i >= floor((n - 12) / 2) AND i < floor((n - 12) / 2) + 12)""")
def representative_sample(spark, d):
    return K.representative(read(spark, d, "documents"), 20, ["lang"], [F.length("text"), F.col("doc_id")]).select("doc_id", "lang")


@query("stratified_systematic_sample", """
WITH r AS (SELECT doc_id, lang, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 2000 THEN 'medium' ELSE 'long' END AS band FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, band ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang, band) AS n, (SELECT count(*) FROM documents) AS total FROM r),
t AS (SELECT *, least(greatest(1, floor(n * 120 / total + 0.5)), n) AS want FROM s)
SELECT doc_id, lang, band FROM t WHERE floor((i + 1) * want / n) > floor(i * want / n)""")
def stratified_systematic_sample(spark, d):
    n = F.length("text")
    rows = read(spark, d, "documents").withColumn("band", F.when(n < 500, "short").when(n < 2000, "medium").otherwise("long"))
    return K.stratified(rows, [F.col("lang"), F.col("band")], [F.col("doc_id")], 120).select("doc_id", "lang", "band")


@query("split_large_groups", """
WITH r AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), p AS (SELECT *, CAST(floor((dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1) / 300) AS INT) + 1 AS part FROM r)
SELECT *, max(part) OVER (PARTITION BY l_suppkey) AS "of" FROM p""")
def split_large_groups(spark, d):
    return K.parts(read(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct(), ["l_suppkey"], "l_orderkey", 300)


@query("citation_registry", """
WITH f AS (SELECT role, conv_id, min(turn) AS t FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY t, conv_id, role) AS n FROM f)
SELECT role, conv_id, 'CITE_' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS citation_id FROM r""")
def citation_registry(spark, d):
    return K.citation_ids(read(spark, d, "conversations"), ["role", "conv_id"], [F.col("turn"), F.col("conv_id"), F.col("role")])


@query("relevance_filter", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT event_id, user_id, value FROM r WHERE value >= 90 OR r <= 3""")
def relevance_filter(spark, d):
    return K.keep_relevant(read(spark, d, "events"), ["user_id"], "value", "event_id", 90.0, 3).select("event_id", "user_id", "value")


@query("compress_ranges", """
WITH n AS (SELECT DISTINCT l_suppkey, l_linenumber AS x FROM lineitem), i AS (SELECT *, x - row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS g FROM n),
s AS (SELECT l_suppkey, g, min(x) AS lo, max(x) AS hi FROM i GROUP BY 1, 2)
SELECT l_suppkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM s GROUP BY 1""")
def compress_ranges(spark, d):
    from loomspark.functions.text import compress_numbers

    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_linenumber").alias("x")).select("l_suppkey", compress_numbers(F.col("x")).alias("ranges"))


@query("complexity_bands", """
SELECT doc_id, CASE WHEN length(text) < 500 THEN 'light' WHEN length(text) < 2000 THEN 'medium' ELSE 'heavy' END AS complexity, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents""")
def complexity_bands(spark, d):
    from loomspark.functions.text import estimate_tokens

    return read(spark, d, "documents").select("doc_id", A.banded(F.length("text"), [(499, "light"), (1999, "medium")], "heavy").alias("complexity"), estimate_tokens("text").alias("tokens"))


@query("primary_assignment", """
WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem)
SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN r = 1 THEN 'primary' ELSE 'secondary' END AS role FROM r""")
def primary_assignment(spark, d):
    rank = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.col("l_quantity").desc(), "l_orderkey", "l_linenumber"))
    return read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.when(rank == 1, "primary").otherwise("secondary").alias("role"))


@query("usage_totals", """
SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def usage_totals(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("user_id").alias("users"))


@query("large_groups", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 0.01 * (SELECT count(*) FROM orders)")
def large_groups(spark, d):
    total = read(spark, d, "orders").agg(F.count("*").alias("total"))
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("n")).join(F.broadcast(total)).where(F.col("n") >= 0.01 * F.col("total")).drop("total")
