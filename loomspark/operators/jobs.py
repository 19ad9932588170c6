"""Jobs, their events and artefacts, caches with a time to live, and what a change makes necessary to run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ["status", "step", "progress", "error"]
FINAL = ["completed", "failed", "cancelled"]


def job_state(events: DataFrame) -> DataFrame:
    """job_id and the last value that is set of each field, completed_at where the status is final.

    ``events`` are append-only: job_id, at, seq, and the fields, null where an event leaves them as they are.
    """
    order = F.struct("at", "seq")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in FIELDS]
    out = events.groupBy("job_id").agg(*last, F.max(F.when(F.col("status").isin(FINAL), F.col("at"))).alias("__end"))
    return out.withColumn("completed_at", F.when(F.col("status").isin(FINAL), F.col("__end"))).drop("__end")


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("job_id", "step").agg(F.max_by("path", F.struct("created_at", "path")).alias("path"))


def recent_events(events: DataFrame, job: str, limit: int = 100) -> DataFrame:
    return events.where(F.col("job_id") == job).orderBy(F.col("at").desc(), F.col("seq").desc()).limit(limit)


def fresh(cache: DataFrame, now: Column, hours: Column) -> DataFrame:
    """Entries younger than their time to live."""
    return cache.where(now.cast("timestamp").cast("long") - F.col("stored_at").cast("long") < hours * 3600)


def without_oldest(cache: DataFrame, share: float = 0.25) -> DataFrame:
    """The cache without its oldest quarter (rounded up)."""
    total = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(total.orderBy("stored_at", "key"))
    return cache.withColumn("__r", rank).withColumn("__n", F.count("*").over(total)).where(F.col("__r") > F.ceil(F.col("__n") * share)).drop("__r", "__n")


def cache_is_valid(cached: DataFrame, hash_: str, steps: list[str]) -> DataFrame:
    """valid: whether all steps are there under the hash."""
    have = cached.where((F.col("hash") == hash_) & F.col("step").isin(steps)).agg(F.count_distinct("step").alias("n"))
    return have.select((F.col("n") == len(steps)).alias("valid"))


def reusable_steps(changes: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """step, reusable: a step can be reused if nothing that it depends on has changed. ``changes``: kind, change."""
    changed = changes.where("change <> 'unchanged'").select("kind").distinct()
    rows = changes.sparkSession.createDataFrame([(s, k) for s, kinds in needs.items() for k in kinds], "step string, kind string")
    hit = rows.join(changed, "kind", "left_semi").select("step").distinct().withColumn("hit", F.lit(True))
    return rows.select("step").distinct().join(hit, "step", "left").select("step", F.col("hit").isNull().alias("reusable"))


def savings(reused: Column, total: Column, tokens: int = 2700, price: float = 3e-6) -> dict[str, Column]:
    """The share of responses that are reused, and the cost that they do not cause again."""
    return {"share": F.when(total == 0, 0.0).otherwise(reused / total), "saved": reused * tokens * price}


def remaining_seconds(steps: DataFrame, total: int) -> DataFrame:
    """Mean duration of the finished steps times the number of those left."""
    return steps.agg((F.coalesce(F.avg("seconds"), F.lit(0.0)) * (F.lit(total) - F.count("*"))).alias("remaining"))


def log_timings(lines: DataFrame, line: str = "line") -> DataFrame:
    """step, seconds from log lines like '[load-data] completed in 1.5s'."""
    pattern = r"\[([a-z-]+)\] completed in ([0-9.]+)s"
    found = lines.select(F.regexp_extract(line, pattern, 1).alias("step"), F.expr(f"try_cast(regexp_extract({line}, r'{pattern}', 2) AS double)").alias("seconds"))
    return found.where("step <> ''")
