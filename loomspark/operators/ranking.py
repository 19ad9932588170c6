"""Orders, samples and batches that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def priority_order(rows: DataFrame, by: list[str], common: Column, priority: Column, size: Column, last: str) -> DataFrame:
    """``rows`` with position: common ones first, then by priority, then the larger, then by ``last``."""
    w = Window.partitionBy(*by).orderBy(common.desc(), priority.asc(), size.desc(), F.col(last))
    return rows.withColumn("position", F.row_number().over(w))


def every_kth(rows: DataFrame, limit: int, by: list[str], order: list[Column]) -> DataFrame:
    """At most ``limit`` rows per group, evenly over an order: every floor(n / limit)-th."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    step = F.greatest(F.floor(F.col("__n") / limit), F.lit(1))
    return rows.where((F.col("__i") % step == 0) & (F.floor(F.col("__i") / step) < limit)).drop("__i", "__n")


def representative(rows: DataFrame, limit: int, by: list[str], order: list[Column], edge: float = 0.2) -> DataFrame:
    """The shortest fifth, the longest fifth and the middle of ``limit`` rows per group; a row comes once."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    k = int(limit * edge)
    middle = limit - 2 * k
    start = F.floor((F.col("__n") - middle) / 2)
    keep = (F.col("__i") < k) | (F.col("__i") >= F.col("__n") - k) | ((F.col("__i") >= start) & (F.col("__i") < start + middle))
    return rows.where(keep).drop("__i", "__n")


def stratified(rows: DataFrame, strata: list[Column], order: list[Column], target: int) -> DataFrame:
    """About ``target`` rows, from each stratum its share (at least one), evenly over the order. Windows are per stratum."""
    names = [f"__s{i}" for i in range(len(strata))]
    rows = rows.withColumns(dict(zip(names, strata)))
    total = rows.agg(F.count("*").alias("__total"))
    w = Window.partitionBy(*names)
    rows = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w)).join(F.broadcast(total))
    want = F.greatest(F.lit(1), F.floor(F.col("__n") * target / F.col("__total") + 0.5))
    rows = rows.withColumn("__want", F.least(want, F.col("__n")))
    # Row i is taken if a multiple of n / want falls on it.
    hit = F.floor((F.col("__i") + 1) * F.col("__want") / F.col("__n")) > F.floor(F.col("__i") * F.col("__want") / F.col("__n"))
    return rows.where(hit).drop("__i", "__n", "__want", "__total", *names)


def random_order(rows: DataFrame, seed: int, id_col: str) -> Column:
    """A key that orders rows at random and alike on every run."""
    return F.struct(F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), F.col(id_col).alias("i"))


def parts(rows: DataFrame, by: list[str], key: str, size: int) -> DataFrame:
    """``rows`` with part i and of n: distinct keys in runs of ``size``."""
    w = Window.partitionBy(*by)
    rank = F.dense_rank().over(w.orderBy(key))
    rows = rows.withColumn("part", (F.floor((rank - 1) / size) + 1).cast("int"))
    return rows.withColumn("of", F.max("part").over(w))


def citation_ids(rows: DataFrame, keys: list[str], order: list[Column], start: int = 1, shards: int = 64) -> DataFrame:
    """keys, citation_id: distinct keys numbered in the order in which they are first seen, padded to three digits.

    Numbers run through all rows; the distinct keys are ranked in two levels, so no task holds them all: counts of
    ranges of the order first, then ranks inside a range.
    """
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__at"))
    ranged = first.repartitionByRange(shards, "__at").withColumn("__part", F.spark_partition_id())
    from loomspark.sources.tables import checkpointed

    ranged = checkpointed(ranged)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
    out = ranged.withColumn("__rank", rank).join(F.broadcast(before.select("__part", "__before")), "__part")
    number = (F.col("__before") + F.col("__rank") + start - 1).cast("string")
    return out.select(*keys, F.concat(F.lit("CITE_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("citation_id"))


def keep_relevant(rows: DataFrame, by: list[str], score: str, last: str, threshold: float, least: int) -> DataFrame:
    """Rows from the threshold on, but at least so many of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), last))
    return rows.withColumn("__r", rank).where((F.col(score) >= threshold) | (F.col("__r") <= least)).drop("__r")
