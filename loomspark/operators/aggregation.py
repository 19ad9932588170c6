"""Aggregates over groups of responses, arguments and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def respondent_class(name: Column, kind: Column, mode: str = "by_type") -> Column:
    """authority, committee, organization or citizen; ``by_name`` also takes a respondent with a name for an organization."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    found = F.when(kind.rlike("myndighed|authority"), "authority").when(kind.rlike("udvalg|committee"), "committee")
    found = found.when(kind.rlike("organisation|organization|forening|virksomhed"), "organization")
    if mode == "by_name":
        found = found.when((F.length(F.trim(name)) > 0) & ~kind.rlike("borger|citizen"), "organization")
    return found.otherwise("citizen")


def breakdown(rows: DataFrame, group: list[str], name: str, kind: Column) -> DataFrame:
    """group, names of authorities, committees and organizations (sorted, distinct), number of citizens, total."""
    names = lambda k: F.array_sort(F.collect_set(F.when(kind == k, F.col(name)))).alias(f"{k}_names")
    return rows.groupBy(*group).agg(
        names("authority"), names("committee"), names("organization"), F.count_if(kind == "citizen").alias("citizens"), F.count("*").alias("total")
    )


def majority(rows: DataFrame, group: list[str], value: Column, share: float) -> DataFrame:
    """group, top (the most frequent value, the smaller of equals, where its share is above ``share``, else null), top_share."""
    counts = rows.groupBy(*group, value.alias("__v")).agg(F.count("*").alias("__n"))
    top = counts.groupBy(*group).agg(F.max("__n").alias("__m"), F.sum("__n").alias("__t"), F.min_by("__v", F.struct((-F.col("__n")).alias("n"), "__v")).alias("__b"))
    part = F.col("__m") / F.col("__t")
    return top.select(*group, F.when(part > share, F.col("__b")).alias("top"), part.alias("top_share"))


def stance(rows: DataFrame, group: list[str], pro: Column, contra: Column) -> DataFrame:
    """group, n_pro, n_contra, direction (the larger, neutral for equal) and mixed (none, low, high)."""
    out = rows.groupBy(*group).agg(F.count_if(pro).alias("n_pro"), F.count_if(contra).alias("n_contra"))
    p, c = F.col("n_pro"), F.col("n_contra")
    direction = F.when(p > c, "pro").when(c > p, "contra").otherwise("neutral")
    mixed = F.when((p >= 2) & (c >= 2), "high").when((p >= 1) & (c >= 1), "low").otherwise("none")
    return out.withColumns({"direction": direction, "mixed": mixed})


def herfindahl(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Sum of squared shares, number of values, and up to three values with more than a fifth."""
    by = by or []
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(total))
    top = F.array_sort(F.collect_list(F.when(F.col("share") > 0.2, F.struct((-F.col("n")).alias("down"), F.col(value).alias("v")))))
    agg = [F.sum(F.pow("share", F.lit(2))).alias("concentration"), F.count("*").alias("values"), F.transform(F.slice(top, 1, 3), lambda x: x["v"]).alias("dominant")]
    return shares.groupBy(*by).agg(*agg)


def coverage(ids: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Ids that no group has."""
    return ids.select(key).join(members.select(key).distinct(), key, "left_anti")


def with_catch_all(members: DataFrame, ids: DataFrame, key: str, group: str, name: str) -> DataFrame:
    """``members`` (group, key) with the ids that none has in a group of their own."""
    lost = coverage(ids, members, key).select(F.lit(name).alias(group), key)
    return members.select(group, key).unionByName(lost)


def merged_groups(members: DataFrame, component: str, member: str, summary: str) -> DataFrame:
    """component, members (sorted, distinct), the longest summary (the smallest of equals)."""
    return members.groupBy(component).agg(
        F.array_sort(F.collect_set(member)).alias("members"), F.min_by(summary, F.struct((-F.length(summary)).alias("n"), F.col(summary).alias("s"))).alias("summary")
    )


def overlapping_groups(members: DataFrame, group: str, member: str, least: float = 0.5, by: str | None = None) -> DataFrame:
    """g1 < g2, common, coefficient: pairs of groups whose common members reach a share of the smaller; not two singles.

    Pairs come from common members by an equi join; distinct members are joined, so a pair counts each once.
    """
    m = members.select(*([by] if by else []), group, member).distinct()
    size = m.groupBy(group).agg(F.count("*").alias("n"))
    key = [member] + ([by] if by else [])
    a, b = m.withColumnRenamed(group, "g1"), m.withColumnRenamed(group, "g2")
    common = a.join(b, key).where("g1 < g2").groupBy("g1", "g2").agg(F.count("*").alias("common"))
    out = common.join(size.select(F.col(group).alias("g1"), F.col("n").alias("n1")), "g1").join(size.select(F.col(group).alias("g2"), F.col("n").alias("n2")), "g2")
    out = out.withColumn("coefficient", F.col("common") / F.least("n1", "n2"))
    return out.where((F.col("coefficient") >= least) & (F.greatest("n1", "n2") > 1)).select("g1", "g2", "common", "coefficient")


def word_counts(rows: DataFrame, by: list[str], words: Column, k: int) -> DataFrame:
    """The k most frequent words per group: by, word, n, rank (ties by word)."""
    counts = rows.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def quality_score(deductions: dict[str, tuple[Column, float, float]]) -> Column:
    """100 less, for each cause, its count times a weight, at most a cap."""
    score = F.lit(100.0)
    for count, weight, cap in deductions.values():
        score = score - F.least(count * weight, F.lit(cap))
    return F.greatest(score, F.lit(0.0))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def weighted_confidence(parts: list[tuple[Column, float]], low: float, high: float, out: str = "confidence") -> dict[str, Column]:
    """A weighted score, rounded to two places, and its band: high priority below ``low``, medium below ``high``."""
    # The small amount puts a score that is a half of the last place in decimals, and just below in binary, above.
    score = F.round(sum((c * w for c, w in parts), F.lit(0.0)) + 1e-9, 2)
    return {out: score, "priority": F.when(score < low, "high").when(score < high, "medium").otherwise("low")}


def banded(value: Column, bands: list[tuple[float, object]], rest: object) -> Column:
    """The value of the first band whose upper bound is not below."""
    found = None
    for bound, out in bands:
        found = F.when(value <= bound, F.lit(out)) if found is None else found.when(value <= bound, F.lit(out))
    return found.otherwise(F.lit(rest))
