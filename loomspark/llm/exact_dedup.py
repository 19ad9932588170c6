"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep one row of each.

Texts are equal when they are identical after every space, tab, line feed, vertical tab, form feed and carriage
return is deleted. Everything is DataFrame work.

The first pass aggregates by (hash, normalised text): equal hashes meet in one place and Spark compares the bytes of
the texts there. Copies collapse on the map side, so a group that holds a third of all rows arrives as one row from
each task. The second pass joins hashes, never texts, back to the rows. Should two different texts share a hash, which
the stored groups tell, the rows of that hash join on the text too.

Cases: a null text counts as empty; empty texts are equal to each other and to texts of white space; a null id sorts
after all others and stays only where no row of its length has an id; rows that repeat id and text count each, and all
of them are marked ``kept`` if their id is (:func:`drop_copies` leaves one); an empty table gives an empty result;
other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import spread_join, stored, table, text_of

#: Characters that do not count in a comparison: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


#: Over any id's distance from the largest long.
SHIFT = "100000000000000000000"


def _decimal(digits: str) -> Column:
    return F.lit(digits).cast("decimal(21,0)")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's id, code points, normalised text and its hash."""
    text = text_of(text_col)
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), normalised(text).alias("norm")
    )
    return slim.withColumn("h", F.unhex(F.md5("norm")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of equal texts: h, keep_id, group_size, text_sha256, and variants (texts of that hash; the other columns count only where there is one)."""
    # The largest n wins, then the smallest id. One decimal, n then the id's distance from the largest long, orders by
    # both and, unlike a struct, stays in a hash aggregate's buffer. A null id has distance 0.
    distance = F.coalesce(_decimal(str(2**63)) - F.col("doc_id").cast("decimal(20,0)"), _decimal("0"))
    rank = F.col("n").cast("decimal(10,0)") * _decimal(SHIFT) + distance
    by_text = (
        _marked(docs, id_col, text_col)
        .withColumn("rank", rank.cast("decimal(38,0)"))
        .groupBy("h", "norm")
        .agg(F.count("*").alias("group_size"), F.max("rank").alias("rank"))
    )
    left = F.col("rank") % _decimal(SHIFT)
    keep = F.when(left > 0, (_decimal(str(2**63)) - left).cast("long"))
    by_text = by_text.select("h", "group_size", keep.alias("keep_id"), F.sha2("norm", 256).alias("text_sha256"))
    return by_text.groupBy("h").agg(
        F.count("*").alias("variants"),
        F.min("group_size").alias("group_size"),
        F.min("keep_id").alias("keep_id"),
        F.min("text_sha256").alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    found = stored(groups(docs, id_col, text_col), "exact-groups")
    rows = _marked(docs, id_col, text_col)
    # The groups tell which hashes are hot: their rows are spread by id.
    sizes = found.where("variants = 1").select("h", F.col("group_size").alias("n"))
    out = spread_join(rows.select("doc_id", "h"), found.where("variants = 1").drop("variants"), "h", ["doc_id"], sizes=sizes).drop("h")
    if not found.where("variants > 1").isEmpty():
        hard = rows.join(found.where("variants > 1").select("h"), "h", "left_semi")
        own = _by_bytes(hard)
        out = out.unionByName(hard.select("doc_id", "norm").join(own, "norm").drop("norm"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _by_bytes(hard: DataFrame) -> DataFrame:
    """For rows whose hash several texts share: one row per text."""
    order = F.struct(F.col("n"), F.col("doc_id").isNotNull(), -F.col("doc_id"))
    return hard.groupBy("norm").agg(
        F.count("*").alias("group_size"), F.max_by("doc_id", order).alias("keep_id"), F.first(F.sha2("norm", 256)).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with one id and equal texts, one."""
    found = stored(groups(docs, id_col, text_col), "exact-groups")
    norm = normalised(text_of(text_col))
    own_id = F.col(id_col).cast("long")
    same_id = lambda keep: own_id.eqNullSafe(keep)
    # Hash and id in one: a struct is never null, and structs are equal where their fields are, nulls included.
    marked = docs.withColumn("__own", F.struct(F.unhex(F.md5(norm)).alias("h"), own_id.alias("id")))
    keys = found.where("variants = 1").select(F.struct("h", F.col("keep_id").alias("id")).alias("__key"))
    kept = marked.join(keys, F.col("__own") == F.col("__key"), "left_semi")
    # Rows that repeat an id and a text are side by side after the join: the longest of them stays.
    longest = Window.partitionBy("__own").orderBy(F.length(text_of(text_col)).desc())
    kept = kept.withColumn("__number", F.row_number().over(longest)).where("__number = 1").select(*docs.columns)
    if not found.where("variants > 1").isEmpty():
        shared = found.where("variants > 1").select(F.col("h").alias("__h"))
        hard = _marked(docs, id_col, text_col).join(shared, F.col("h") == F.col("__h"), "left_semi")
        own = _by_bytes(hard).select(F.col("norm").alias("__norm"), F.col("keep_id").alias("__keep"))
        more = docs.join(own, (norm == F.col("__norm")) & same_id(F.col("__keep")), "left_semi").withColumn("__own", norm)
        kept = kept.unionByName(more.withColumn("__number", F.row_number().over(longest)).where("__number = 1").select(*docs.columns))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
