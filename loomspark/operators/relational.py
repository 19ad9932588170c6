"""The relational layer: latest-wins upserts, partition replacement, overlays, publishing, paging, an undoable log.

Tables are frames; a write is a function from old rows and new rows to the new table, so that any Parquet or catalog
sink can hold it (see ``sources.tables``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_wins(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """One row per key: the one that comes first in the order of ``version``."""
    w = Window.partitionBy(*keys).orderBy(*version)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def upsert(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``patch`` in place of those of equal keys; ``patch`` has one row per key."""
    kept = base.join(patch.select(*keys), keys, "left_anti")
    return kept.unionByName(patch)


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_partition(base: DataFrame, rows: DataFrame, partition: list[str]) -> DataFrame:
    """``base`` with the whole partitions that occur in ``rows`` replaced by them."""
    return base.join(rows.select(*partition).distinct(), partition, "left_anti").unionByName(rows)


def patch_columns(base: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Read-modify-write: ``patch`` has, for each column c, c and has_c; only columns that are present overwrite, with null too."""
    p = patch.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], *[F.col(f"has_{c}").alias(f"__has_{c}") for c in columns])
    new = {c: F.when(F.coalesce(F.col(f"__has_{c}"), F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return base.join(p, keys, "left").withColumns(new).select(*base.columns)


def overlay(base: DataFrame, edits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A session's edits over the base rows: a null edit leaves the base value."""
    e = edits.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(e, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*base.columns)


def source_fallback(sources: list[tuple[str, DataFrame]], partition: list[str]) -> DataFrame:
    """For each partition, the rows of the first source that has any, with the source's name in ``source_name``."""
    out, seen = None, None
    for name, rows in sources:
        mine = rows if seen is None else rows.join(seen, partition, "left_anti")
        mine = mine.withColumn("source_name", F.lit(name))
        keys = rows.select(*partition).distinct()
        out = mine if out is None else out.unionByName(mine)
        seen = keys if seen is None else seen.union(keys).distinct()
    return out


def publish(rows: DataFrame, children: DataFrame, partition: list[str], key: str, child_key: str, approved: Column, child_title: str) -> DataFrame:
    """Approved rows numbered 1..n in their partition, with their children numbered 1..m and named if they have no name."""
    kept = rows.where(approved).withColumn("response_id", F.row_number().over(Window.partitionBy(*partition).orderBy(key)))
    child = kept.select(*partition, key, "response_id").join(children, [*partition, key] if set(partition) <= set(children.columns) else [key], "left")
    number = F.row_number().over(Window.partitionBy(*partition, "response_id").orderBy(child_key))
    child = child.withColumn("attachment_id", F.when(F.col(child_key).isNotNull(), number))
    return child.withColumn(child_title, F.when(F.col("attachment_id").isNull(), F.lit(None)).otherwise(F.coalesce(F.expr(f"nullif({child_title}, '')"), F.concat(F.lit("Bilag "), F.col("attachment_id")))))


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], out: str) -> DataFrame:
    """Parents with an array of their children's fields, ordered by them; an empty array where there are none."""
    packed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
    kind = packed.schema[out].dataType.simpleString()
    return parents.join(packed, key, "left").withColumn(out, F.coalesce(out, F.array().cast(kind)))


def searched(rows: DataFrame, columns: list[str], term: str | None, pending: Column | None = None) -> DataFrame:
    """Rows where the term occurs in any of the columns, whatever its case; all rows for no term."""
    if pending is not None:
        rows = rows.where(pending)
    if not term:
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).cast("string").ilike(f"%{term}%"), F.lit(False))
    return rows.where(found)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows, from 1, in a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def status_of(done: Column, total: Column) -> Column:
    """draft, in-progress or ready."""
    return F.when((total > 0) & (done == total), "ready").when(done > 0, "in-progress").otherwise("draft")


def append_operations(log: DataFrame, new: DataFrame, draft: str, order: list[str]) -> DataFrame:
    """``new`` operations numbered on from the largest sequence of their draft."""
    last = log.groupBy(draft).agg(F.max("sequence").alias("__last"))
    rank = F.row_number().over(Window.partitionBy(draft).orderBy(*order))
    rows = new.join(last, draft, "left").withColumn("sequence", F.coalesce("__last", F.lit(0)) + rank).drop("__last")
    return log.unionByName(rows.select(*log.columns))


def undo(log: DataFrame, draft: str, at: Column) -> DataFrame:
    """The last operation of each draft that is not undone becomes undone."""
    top = Window.partitionBy(draft, F.col("undone_at").isNull()).orderBy(F.col("sequence").desc())
    hit = F.col("undone_at").isNull() & (F.row_number().over(top) == 1)
    return log.withColumn("undone_at", F.when(hit, at).otherwise(F.col("undone_at")))


def redo(log: DataFrame, draft: str) -> DataFrame:
    """The first undone operation of each draft is done again."""
    low = Window.partitionBy(draft, F.col("undone_at").isNull()).orderBy("sequence")
    hit = F.col("undone_at").isNotNull() & (F.row_number().over(low) == 1)
    return log.withColumn("undone_at", F.when(~hit, F.col("undone_at")))


def archive_active(drafts: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Only the last active draft of each key stays active."""
    last = F.row_number().over(Window.partitionBy(key, F.col("status") == "active").orderBy(*order)) == 1
    return drafts.withColumn("status", F.when((F.col("status") == "active") & ~last, "archived").otherwise(F.col("status")))


def incremental(current: DataFrame, baseline: DataFrame, key: str, content: list[str]) -> DataFrame:
    """key and change: new, modified, unchanged or removed, by a hash of the whole content."""
    digest = lambda: F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    now, was = current.select(key, digest().alias("now")), baseline.select(key, digest().alias("was"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("was"), "unchanged").otherwise("modified")
    return now.join(was, key, "full_outer").select(key, change.alias("change"))


def merge_with_baseline(ids: DataFrame, new: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Current ids with their new value, else the one of the baseline."""
    n, b = new.select(key, F.col(value).alias("__new")), base.select(key, F.col(value).alias("__base"))
    return ids.join(n, key, "left").join(b, key, "left").select(key, F.coalesce("__new", "__base").alias(value))


def patch_merge(base: DataFrame, patched: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Baseline rows except those of touched ids, and the patched rows; touched ids without a patched row vanish."""
    return base.join(touched.select(key).distinct(), key, "left_anti").unionByName(patched)
