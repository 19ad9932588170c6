"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import bound, tokenize
from loomspark.functions.vectors import cosine
from loomspark.sources.tables import checkpointed


def occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term))).cast("double")


def bm25(chunks: DataFrame, terms: list[str], id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """id, score: BM25 over the query's number of terms, then over the largest score (at least 1).

    A term's frequency in the query weighs it; its document frequency counts each text once. Texts are read and parted
    into words once: length and term counts are stored as a table of numbers, which all that follows reads.
    """
    weight = {t: terms.count(t) for t in terms}

    def counted(words: Column) -> Column:
        here = [occurrences(words, t).alias(f"tf{i}") for i, t in enumerate(weight)]
        return F.struct(F.size(words).cast("double").alias("len"), *here)

    # One array, one element: the words are worked out once for all counts of a row.
    rows = checkpointed(chunks.select(F.col(id_col), bound(tokenize(text_col), counted).alias("c")).select(id_col, "c.*"))
    facts = rows.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(weight))])
    score = F.lit(0.0)
    for i, n in enumerate(weight.values()):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + n * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # The facts are one row.
    scored = rows.join(F.broadcast(facts)).select(id_col, (score / max(1, len(terms))).alias("score"))
    top = scored.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("top"))
    return scored.join(F.broadcast(top)).select(id_col, (F.col("score") / F.col("top")).alias("score"))


def cosine_scores(chunks: DataFrame, query: Column, id_col: str, vector_col: str) -> DataFrame:
    """id, score: cosine of each chunk's vector and the query's; 0 where it has none."""
    return chunks.select(id_col, F.coalesce(cosine(F.col(vector_col), query), F.lit(0.0)).alias("score"))


def combine(vector: DataFrame, lexical: DataFrame, id_col: str, vector_weight: float = 0.7) -> DataFrame:
    """id, vector_score, lexical_score, score: a full outer join by id, weighted."""
    v, w = vector.select(id_col, F.col("score").alias("vector_score")), lexical.select(id_col, F.col("score").alias("lexical_score"))
    both = v.join(w, id_col, "full_outer").fillna(0.0, ["vector_score", "lexical_score"])
    return both.withColumn("score", vector_weight * F.col("vector_score") + (1 - vector_weight) * F.col("lexical_score"))


def top_k(scored: DataFrame, id_col: str, k: int, least: float | None = None, source: str | None = None, max_per_source: int | None = None) -> DataFrame:
    """The k best, ties by id; with a source and a cap, at most so many of each source."""
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    if source and max_per_source:
        own = F.row_number().over(Window.partitionBy(source).orderBy(F.col("score").desc(), id_col))
        scored = scored.withColumn("__own", own).where(F.col("__own") <= max_per_source).drop("__own")
    return scored.orderBy(F.col("score").desc(), id_col).limit(k)


def boosted(chunks: DataFrame, query: Column, words: list[str], id_col: str, vector_col: str, keywords: Column, content: Column, least: float = 0.3, k: int = 15) -> DataFrame:
    """Cosine plus 0.15 for each query word in the keywords and 0.08 for each in the content, at most 1; the best from ``least``."""
    hits = lambda text, w: sum((F.coalesce(F.lower(text).contains(x), F.lit(False)).cast("double") * w for x in words), F.lit(0.0))
    score = F.least(F.lit(1.0), F.coalesce(cosine(F.col(vector_col), query), F.lit(0.0)) + hits(keywords, 0.15) + hits(content, 0.08))
    return top_k(chunks.select(id_col, score.alias("score")), id_col, k, least)
