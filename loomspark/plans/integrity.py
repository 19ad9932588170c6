"""Citations, references and members; suppliers stand for members, parts for positions, lines for citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import integrity as I
from loomspark.plans.registry import query
from loomspark.plans.tuning import pick
from loomspark.sources.tables import placed, read

NOTES = ["Gruppen omfatter alle", "ok", "Citatuddrag er ikke indsat her", "deludkast 2", "god"]
MARKS = ["a <<REF_1>><<REF_2>> b", "a <<REF_1>> b <<REF_2>>", "a <<REF_3>> c", "none", "<<REF_1>> <<REF_1>>"]
FLAGS = ["large_group", "x", "mixed_directions", "low_citation_coverage", "very_small_group"]
PRIORITY = ["high", "medium", "low"]


@query("quote_issues", """WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 3 = 0 THEN '   ' ELSE substr(text, 1, CAST(conv_id % 20 AS INT)) END AS q FROM conversations)
SELECT CASE WHEN q IS NULL OR q = '' THEN 'missing' WHEN trim(q) = '' THEN 'empty' WHEN length(q) < 10 THEN 'short' END AS issue, count(*) AS n FROM q GROUP BY 1""")
def quote_issues(spark, d):
    t = F.col("turn")
    quote = F.when(t % 5 == 0, None).when(t % 3 == 0, "   ").otherwise(F.substr("text", F.lit(1), (F.col("conv_id") % 20).cast("int")))
    return read(spark, d, "conversations").groupBy(I.quote_issue(quote).alias("issue")).agg(F.count("*").alias("n"))


@query("resolved_citations", """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN '[CITATION NOT FOUND: ' || l_partkey || ']' ELSE p_name END AS quote
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey""")
def resolved_citations(spark, d):
    registry = read(spark, d, "part").where("p_size <= 25").withColumnRenamed("p_partkey", "l_partkey")
    return I.resolved(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), registry, "l_partkey", "p_name").drop("l_partkey")


@query("reference_issues", f"""WITH r AS (SELECT p_partkey AS id, {MARKS}[p_partkey % 5 + 1] AS summary, {NOTES}[p_partkey // 5 % 5 + 1] AS notes, p_size AS n, p_partkey % 9 AS q, p_partkey % 4 AS bad FROM part),
f AS (SELECT id, list_filter([CASE WHEN regexp_matches(summary, '<<REF_[0-9]+>><<REF_[0-9]+>>') THEN 'double_reference' END, CASE WHEN len(list_filter({I.FORBIDDEN}, lambda p: contains(lower(notes), p))) > 0 THEN 'forbidden_notes' END,
  CASE WHEN bad > 0 THEN 'malformed_quote' END, CASE WHEN n > 15 AND q > 5 THEN 'too_many_quotes' END], lambda x: x IS NOT NULL) AS f FROM r)
SELECT id, unnest(f) AS issue FROM f""")
def reference_issues(spark, d):
    p = F.col("p_partkey")
    notes = F.element_at(F.array(*map(F.lit, NOTES)), (F.floor(p / 5) % 5 + 1).cast("int"))
    return read(spark, d, "part").select(p.alias("id"), F.explode(I.reference_issues(pick(MARKS, "p_partkey"), notes, F.col("p_size"), p % 9, p % 4)).alias("issue"))


@query("sub_position_issues", f"""WITH r AS (SELECT p_partkey AS id, {MARKS}[p_partkey % 5 + 1] AS summary, p_partkey % 4 AS parts, p_size AS members, p_partkey % 50 AS largest FROM part),
f AS (SELECT id, list_filter([CASE WHEN parts > 0 AND len(list_distinct(regexp_extract_all(summary, '<<REF_[0-9]+>>'))) < 2 THEN 'missing_refs' END, CASE WHEN parts >= 2 AND largest > members * 0.8 THEN 'concentrated' END], lambda x: x IS NOT NULL) AS f FROM r)
SELECT id, unnest(f) AS issue FROM f""")
def sub_position_issues(spark, d):
    p = F.col("p_partkey")
    return read(spark, d, "part").select(p.alias("id"), F.explode(I.sub_position_issues(pick(MARKS, "p_partkey"), p % 4, F.col("p_size"), p % 50)).alias("issue"))


@query("tracked_members", "SELECT l_suppkey AS member, arg_max(l_partkey, (l_orderkey, l_linenumber)) AS position, count(DISTINCT l_partkey) AS positions FROM lineitem GROUP BY 1")
def tracked_members(spark, d):
    rows = placed(read(spark, d, "lineitem"), "place").withColumnsRenamed({"l_suppkey": "member", "l_partkey": "position"})
    return I.tracked(rows, "member", "position", ["l_orderkey", "l_linenumber"], "place")


@query("merge_history", """SELECT l_partkey AS source, arg_max(l_suppkey, (l_orderkey, l_linenumber)) AS target, max(merged) AS merged FROM lineitem JOIN (SELECT l_suppkey AS t, count(*) AS merged FROM lineitem GROUP BY 1)
 ON t = (SELECT arg_max(x.l_suppkey, (x.l_orderkey, x.l_linenumber)) FROM lineitem x WHERE x.l_partkey = lineitem.l_partkey) GROUP BY 1""")
def merge_history(spark, d):
    rows = read(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "source", "l_suppkey": "target"})
    history, last = I.merge_history(rows, "source", "target", ["l_orderkey", "l_linenumber"])
    return last.join(history, "target").select("source", "target", "merged")


@query("token_chunks", """WITH RECURSIVE o AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
c AS (SELECT conv_id, turn, r, n AS used, 0 AS chunk FROM o WHERE r = 1
 UNION ALL SELECT o.conv_id, o.turn, o.r, CASE WHEN c.used > 0 AND c.used + o.n > 60 THEN o.n ELSE c.used + o.n END, c.chunk + CAST(c.used > 0 AND c.used + o.n > 60 AS INT) FROM c JOIN o ON o.conv_id = c.conv_id AND o.r = c.r + 1)
SELECT conv_id, turn, chunk FROM c""")
def token_chunks(spark, d):
    rows = read(spark, d, "conversations").withColumn("n", F.ceil(F.length("text") / 4))
    return I.token_chunks(rows, "conv_id", "turn", "n", 60)


@query("patched_members", """SELECT l.l_orderkey, l.l_linenumber, coalesce(o.o_orderpriority, l.l_returnflag) AS l_returnflag FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey""")
def patched_members(spark, d):
    patches = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("l_returnflag"))
    return I.refreshed(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), patches, ["l_orderkey"], ["l_returnflag"])


_TOUCHED = "p AS (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal < 0)"


@query("touched_themes", f"WITH {_TOUCHED} SELECT DISTINCT p_brand AS theme FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey IN (SELECT s_suppkey FROM p)")
def touched_themes(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), F.col("p_brand").alias("theme"))
    return I.touched(rows, read(spark, d, "supplier").where("s_acctbal < 0"), "s_suppkey", ["theme"])


@query("touched_positions", f"WITH {_TOUCHED} SELECT DISTINCT l_partkey AS position FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM p)")
def touched_positions(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("position"))
    return I.touched(rows, read(spark, d, "supplier").where("s_acctbal < 0"), "s_suppkey", ["position"])


@query("merged_items", """WITH i AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_quantity < 40 THEN l_quantity / 40 END AS confidence, l_discount * 10 AS relevance FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM i)
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, round(least(1.0, coalesce(confidence, 0.7) * (0.5 + relevance * 0.5)), 6) AS confidence FROM r WHERE r = 1""")
def merged_items(spark, d):
    rows = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 40, F.col("l_quantity") / 40).alias("confidence"), (F.col("l_discount") * 10).alias("relevance"))
    out = I.merged_items(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"], "confidence", "relevance")
    return out.drop("relevance").withColumn("confidence", F.round("confidence", 6))


@query("mean_confidence", """SELECT l_suppkey, round(coalesce(sum(l_quantity / 50 * (l_discount * 10)) FILTER (WHERE l_quantity < 25) / nullif(sum(l_discount * 10) FILTER (WHERE l_quantity < 25), 0), 0.5), 6) AS confidence FROM lineitem GROUP BY 1""")
def mean_confidence(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") < 25, F.col("l_quantity") / 50).alias("confidence"), (F.col("l_discount") * 10).alias("relevance"))
    return I.mean_confidence(rows, ["l_suppkey"], "confidence", "relevance").withColumn("confidence", F.round("confidence", 6))


@query("review_queue", f"""WITH r AS (SELECT p_partkey AS id, {PRIORITY}[p_partkey % 3 + 1] AS priority, p_size AS score, [{FLAGS}[p_partkey % 5 + 1], {FLAGS}[p_partkey // 5 % 5 + 1]] AS f FROM part)
SELECT id, row_number() OVER (PARTITION BY priority ORDER BY score, id) AS place, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS band,
 CASE WHEN list_contains(f, 'mixed_directions') THEN 'mixed_directions' WHEN list_contains(f, 'low_embedding_similarity') THEN 'low_embedding_similarity' WHEN list_contains(f, 'large_group') THEN 'large_group' WHEN list_contains(f, 'very_small_group') THEN 'very_small_group'
  WHEN list_contains(f, 'low_citation_coverage') THEN 'low_citation_coverage' WHEN priority = 'high' THEN 'low confidence' END AS reason FROM r""")
def review_queue(spark, d):
    from pyspark.sql.window import Window

    p = F.col("p_partkey")
    other = F.element_at(F.array(*map(F.lit, FLAGS)), (F.floor(p / 5) % 5 + 1).cast("int"))
    rows = read(spark, d, "part").select(p.alias("id"), pick(PRIORITY, "p_partkey").alias("priority"), F.col("p_size").alias("score"), F.array(pick(FLAGS, "p_partkey"), other).alias("f"))
    place = F.row_number().over(Window.partitionBy("priority").orderBy("score", "id"))
    return rows.select("id", place.alias("place"), I.review_order(F.col("priority")).alias("band"), I.review_reason(F.col("f"), F.col("priority")).alias("reason"))


@query("shared_substance", """WITH e AS (SELECT vec_id AS key, label AS ref, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT vec_id, vec_id % 40 + 100, CAST(embedding AS DOUBLE[]) FROM embeddings),
p AS (SELECT a.key AS key_1, b.key AS key_2, count(*) AS shared, list_cosine_similarity(any_value(a.v), any_value(b.v)) AS sim FROM e a JOIN e b ON a.ref = b.ref AND a.key < b.key GROUP BY 1, 2)
SELECT key_1, key_2, shared, round(sim, 6) AS sim FROM p WHERE sim >= 0.3 AND sim < 0.75""")
def shared_substance(spark, d):
    e = read(spark, d, "embeddings").withColumnRenamed("vec_id", "key")
    refs = e.select("key", F.explode(F.array(F.col("label").cast("long"), F.col("key") % 40 + 100)).alias("ref"))
    return I.shared_substance(refs, "key", "ref", e, "embedding", 0.3).withColumn("sim", F.round("sim", 6))
