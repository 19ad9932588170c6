"""Queries on chunks, copies, drafts, models and a whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import chunking, dedupe, editlog, models, similarity
from loomspark.plans.registry import query
from loomspark.sources.tables import OWN_FOLDER, Steps, read


@query("free_text_chunks")
def free_text_chunks(spark, d):
    return chunking.chunked(read(spark, d, "documents"), "doc_id", "text")


@query("chunk_statistics")
def chunk_statistics(spark, d):
    return chunking.chunk_stats(chunking.chunked(read(spark, d, "documents"), "doc_id", "text"))


@query("long_document_chunks")
def long_document_chunks(spark, d):
    return chunking.chunked(read(spark, d, "documents"), "doc_id", "text", lambda t: chunking.long_document(t, 2000, 200))


@query("argument_chunks", """
SELECT conv_id, turn AS chunk_index, substr('Role: ' || role || chr(10) || 'Text: ' || text, 1, 1200) AS content FROM conversations WHERE trim(text) <> ''""")
def argument_chunks(spark, d):
    return chunking.argument_chunks(read(spark, d, "conversations").where("trim(text) <> ''"), "conv_id", "turn", {"Role": "role", "Text": "text"})


@query("copy_groups")
def copy_groups(spark, d):
    return dedupe.copy_groups(read(spark, d, "documents"), "doc_id", "text")


@query("edit_log_fold", """WITH m AS (SELECT DISTINCT conv_id AS draft, turn FROM conversations WHERE turn % 3 = 0 AND turn % 2 <> 1),
r AS (SELECT DISTINCT conv_id AS draft, role, turn FROM conversations)
SELECT draft, 'talk' AS theme, role AS title, coalesce(list(r.turn ORDER BY r.turn) FILTER (WHERE m.turn IS NULL), []) AS members FROM r LEFT JOIN m USING (draft, turn) GROUP BY draft, role
UNION ALL SELECT draft, 'other', 'no opinion', list(turn ORDER BY turn) FROM m GROUP BY draft""")
def edit_log_fold(spark, d):
    rows = read(spark, d, "conversations")
    start = rows.groupBy(F.col("conv_id").alias("draft"), F.lit("talk").alias("theme"), F.col("role").alias("title")).agg(F.array_sort(F.collect_set("turn")).alias("members"))
    data = F.to_json(F.struct(F.array("turn").alias("responses")))
    log = rows.where("turn % 3 = 0").select(F.col("conv_id").alias("draft"), F.col("turn").cast("int").alias("sequence"), F.lit("MARK_NO_OPINION").alias("kind"), data.alias("data"), (F.col("turn") % 2 == 1).alias("undone"))
    return editlog.folded(start, log)


@query("stub_embeddings")
def stub_embeddings(spark, d):
    return models.embedded(read(spark, d, "benchmark").select("item_id", "text"), "text").select("item_id", "embedding")


@query("leader_clusters")
def leader_clusters(spark, d):
    return similarity.leaders(read(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.35)


@query("diverse_points")
def diverse_points(spark, d):
    return similarity.farthest_points(read(spark, d, "embeddings"), ["label"], "vec_id", "embedding")


@query("consultation_run")
def consultation_run(spark, d):
    import uuid

    from loomspark.plans.orchestrator import Run, consultation

    rows = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.col("role").alias("theme"))
    folder = spark.conf.get("spark.checkpoint.dir", None) or OWN_FOLDER
    store = Steps(spark, f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/run-{uuid.uuid4().hex}")
    return Run(spark, consultation(rows, "the thing and that"), store, "conversations").run()["themes"]
