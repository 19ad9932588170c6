"""Queries of the relational layer over the star-schema tables.

Orders stand for curated responses, line items for their attachments, customers for consultations.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators import relational as R
from loomspark.plans.registry import query
from loomspark.sources.tables import read

OPEN = "o_orderstatus = 'O'"


@query("status_counts", """
SELECT c_nationkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS approved,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS pending,
       CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE o_orderstatus = 'F') = count(*) THEN 'ready'
            WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'in-progress' ELSE 'draft' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""")
def status_counts(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy("c_nationkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("approved"), F.count_if(F.expr(OPEN)).alias("pending"))
    return out.withColumn("status", R.status_of(F.col("approved"), F.col("total")))


@query("paged_search", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND (o_orderpriority ILIKE '%urg%' OR CAST(o_orderkey AS VARCHAR) ILIKE '%urg%' OR o_orderstatus ILIKE '%urg%')
ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey LIMIT 25 OFFSET 25""")
def paged_search(spark, d):
    rows = R.searched(read(spark, d, "orders"), ["o_orderpriority", "o_orderkey", "o_orderstatus"], "urg", F.expr(OPEN))
    return R.page(rows, [F.coalesce("o_totalprice", F.lit(0.0)).desc(), F.col("o_orderkey")], 2, 25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("page_with_children", """
WITH p AS (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50)
SELECT p.o_orderkey, p.o_orderstatus, count(l_orderkey) AS n_children, coalesce(sum(l_linenumber), 0) AS line_sum
FROM p LEFT JOIN lineitem ON l_orderkey = p.o_orderkey GROUP BY 1, 2""")
def page_with_children(spark, d):
    rows = R.page(read(spark, d, "orders"), [F.col("o_orderkey")], 1, 50).select("o_orderkey", "o_orderstatus")
    children = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(rows, "o_orderkey", "left_semi")
    out = R.nested(rows, children, "o_orderkey", ["l_linenumber", "l_partkey"], "children")
    total = F.aggregate("children", F.lit(0).cast("long"), lambda s, c: s + c["l_linenumber"])
    return out.select("o_orderkey", "o_orderstatus", F.size("children").cast("long").alias("n_children"), total.alias("line_sum"))


@query("publish_renumber", """
SELECT o_custkey, o_orderkey, response_id, l_linenumber,
       row_number() OVER (PARTITION BY o_custkey, response_id ORDER BY l_linenumber) AS attachment_id,
       'Bilag ' || row_number() OVER (PARTITION BY o_custkey, response_id ORDER BY l_linenumber) AS title
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS response_id
      FROM orders WHERE o_orderstatus = 'F') r
JOIN lineitem ON l_orderkey = o_orderkey""")
def publish_renumber(spark, d):
    child = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.lit("").alias("title"))
    out = R.publish(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), child, ["o_custkey"], "o_orderkey", "l_linenumber", F.col("o_orderstatus") == "F", "title")
    return out.where("l_linenumber is not null").select("o_custkey", "o_orderkey", "response_id", "l_linenumber", "attachment_id", "title")


@query("latest_wins_upsert", """
SELECT user_id, event_id, event_type, value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_wins_upsert(spark, d):
    rows = R.latest_wins(read(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return rows.select("user_id", "event_id", "event_type", "value")


@query("upsert_merge", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT DISTINCT o_custkey, 'PENDING' FROM orders WHERE o_orderstatus = 'P'""")
def upsert_merge(spark, d):
    patch = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit("PENDING").alias("c_mktsegment")).distinct()
    return R.upsert(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), patch, ["c_custkey"])


@query("cascade_delete", """
SELECT l_orderkey, count(*) AS n FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW') GROUP BY 1""")
def cascade_delete(spark, d):
    gone = read(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.delete_keys(read(spark, d, "lineitem"), gone, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("replace_partition", """
SELECT c_nationkey, c_mktsegment, count(*) AS n FROM (
 SELECT c_nationkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)
 UNION ALL SELECT s_nationkey, 'SUPPLIER' FROM supplier) GROUP BY 1, 2""")
def replace_partition(spark, d):
    base = read(spark, d, "customer").select("c_nationkey", "c_mktsegment")
    rows = read(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.lit("SUPPLIER").alias("c_mktsegment"))
    return R.replace_partition(base, rows, ["c_nationkey"]).groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("state_patch", """
SELECT c.c_custkey, CASE WHEN p.o_custkey IS NOT NULL THEN NULL ELSE c.c_mktsegment END AS c_mktsegment, c.c_name
FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') p ON p.o_custkey = c.c_custkey""")
def state_patch(spark, d):
    patch = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    patch = patch.select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(True).alias("has_c_mktsegment"), F.lit("x").alias("c_name"), F.lit(False).alias("has_c_name"))
    return R.patch_columns(read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), patch, ["c_custkey"], ["c_mktsegment", "c_name"])


@query("overlay_coalesce", """
SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'flagged' END, d.lang) AS lang, coalesce(CASE WHEN l.quality = 1 THEN 'reviewed' END, d.source) AS source
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def overlay_coalesce(spark, d):
    edits = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").alias("lang"), F.when(F.col("quality") == 1, "reviewed").alias("source"))
    return R.overlay(read(spark, d, "documents").select("doc_id", "lang", "source"), edits, ["doc_id"], ["lang", "source"])


@query("source_fallback", """
WITH a AS (SELECT s_nationkey AS k, s_suppkey AS id FROM supplier), b AS (SELECT c_nationkey AS k, c_custkey AS id FROM customer), c AS (SELECT n_nationkey AS k, n_nationkey AS id FROM nation)
SELECT k, id, 'published' AS source_name FROM a
UNION ALL SELECT k, id, 'prepared' FROM b WHERE k NOT IN (SELECT k FROM a)
UNION ALL SELECT k, id, 'raw' FROM c WHERE k NOT IN (SELECT k FROM a) AND k NOT IN (SELECT k FROM b)""")
def source_fallback(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    b = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"))
    c = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("long").alias("id"))
    return R.source_fallback([("published", a), ("prepared", b), ("raw", c)], ["k"])


@query("index_projection", """
SELECT o_orderkey, o_custkey, o_orderstatus = 'O' AS open FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P' AND lower(o_orderpriority) LIKE '%high%' ORDER BY o_orderdate, o_orderkey""")
def index_projection(spark, d):
    rows = read(spark, d, "orders").where(~F.col("o_orderstatus").eqNullSafe("P") & F.lower("o_orderpriority").contains("high"))
    return rows.orderBy(F.col("o_orderdate").asc_nulls_first(), "o_orderkey").select("o_orderkey", "o_custkey", F.expr(OPEN).alias("open"))


@query("partition_summary", """
SELECT n_nationkey, n_name, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, coalesce(o.n, 0) AS orders
FROM nation LEFT JOIN (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) s ON s.k = n_nationkey
LEFT JOIN (SELECT c_nationkey k, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n_nationkey""")
def partition_summary(spark, d):
    out = read(spark, d, "nation").select("n_nationkey", "n_name")
    orders = read(spark, d, "orders").join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    for name, rows, key in (("customers", read(spark, d, "customer"), "c_nationkey"), ("suppliers", read(spark, d, "supplier"), "s_nationkey"), ("orders", orders, "c_nationkey")):
        counts = rows.groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(name))
        out = out.join(counts, "n_nationkey", "left").fillna(0, [name])
    return out


@query("undo_redo_state", """
WITH log AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)
SELECT user_id, event_id, sequence,
 sequence > max(sequence) OVER (PARTITION BY user_id) - 1 AS undone FROM log""")
def undo_redo_state(spark, d):
    new = read(spark, d, "events").select("user_id", "event_id", "ts")
    log = new.limit(0).select("user_id", "event_id", F.lit(0).alias("sequence"), F.lit(None).cast("timestamp").alias("undone_at"))
    log = R.append_operations(log, new.withColumn("undone_at", F.lit(None).cast("timestamp")), "user_id", ["ts", "event_id"])
    log = R.undo(R.undo(log, "user_id", F.current_timestamp()), "user_id", F.current_timestamp())
    log = R.redo(log, "user_id")
    return log.select("user_id", "event_id", F.col("sequence"), F.col("undone_at").isNotNull().alias("undone"))


@query("active_drafts", """
SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'closed'
  WHEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'active' ELSE 'archived' END AS status
FROM orders""")
def active_drafts(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.expr(OPEN), "active").otherwise("closed").alias("status"))
    return R.archive_active(rows, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "status")


@query("incremental_diff", """
WITH now AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 10 <> 3),
was AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text, lang FROM documents WHERE doc_id % 11 <> 5)
SELECT coalesce(now.doc_id, was.doc_id) AS doc_id, CASE WHEN was.doc_id IS NULL THEN 'new' WHEN now.doc_id IS NULL THEN 'removed'
  WHEN now.text = was.text AND now.lang = was.lang THEN 'unchanged' ELSE 'modified' END AS change
FROM now FULL JOIN was ON now.doc_id = was.doc_id""")
def incremental_diff(spark, d):
    # Two states of a table are made from one: the rules below say which rows each lacks and which have changed.
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    was = docs.where("doc_id % 11 <> 5").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.incremental(docs.where("doc_id % 10 <> 3"), was, "doc_id", ["text", "lang"])


@query("baseline_merge", """
SELECT d.doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars) AS value FROM documents d LEFT JOIN labels l USING (doc_id)""")
def baseline_merge(spark, d):
    docs = read(spark, d, "documents")
    new = read(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    return R.merge_with_baseline(docs.select("doc_id"), new, docs.select("doc_id", F.col("n_chars").alias("value")), "doc_id", "value")


@query("patch_merge", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'patched' FROM labels WHERE quality = 1""")
def patch_merge(spark, d):
    touched = read(spark, d, "labels")
    patched = touched.where("quality = 1").select("doc_id", F.lit("patched").alias("lang"))
    return R.patch_merge(read(spark, d, "documents").select("doc_id", "lang"), patched, touched, "doc_id")


@query("json_props_flatten", """
SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS whole, props IS NOT NULL AND json_valid(props) AS has_props FROM events""")
def json_props_flatten(spark, d):
    parsed = F.try_parse_json("props") if hasattr(F, "try_parse_json") else F.from_json("props", "map<string,string>")
    return read(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("whole"), (F.col("props").isNotNull() & parsed.isNotNull()).alias("has_props"))


@query("event_log_latest", """
SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events GROUP BY user_id""")
def event_log_latest(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))


@query("usage_grouping_sets", """
SELECT event_type, CAST(user_id % 4 AS BIGINT) AS step, count(*) AS calls, round(sum(value), 4) AS total
FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), ())""")
def usage_grouping_sets(spark, d):
    read(spark, d, "events").withColumn("step", F.col("user_id") % 4).createOrReplaceTempView("loom_calls")
    return spark.sql("SELECT event_type, step, count(*) AS calls, round(sum(value), 4) AS total FROM loom_calls GROUP BY GROUPING SETS ((event_type), (step), ())")


@query("export_ids", "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation) ORDER BY k")
def export_ids(spark, d):
    parts = [read(spark, d, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct().orderBy("k")


@query("chunk_batches", """
SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS batch,
 CAST(ceil(count(*) OVER (PARTITION BY o_custkey) / 5.0) AS BIGINT) AS batches FROM orders""")
def chunk_batches(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    size = F.count("*").over(Window.partitionBy("o_custkey"))
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor((rank - 1) / 5).alias("batch"), F.ceil(size / 5).alias("batches"))
