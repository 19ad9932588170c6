"""Quotes and their sources: exact places, a cascade of looser matches, best sentences, validation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text as T


def exact_places(docs: DataFrame, quotes: DataFrame, doc_id: str, doc_text: str, quote_id: str, quote_text: str) -> DataFrame:
    """doc_id, quote_id, place (from 1) of every document and quote that it contains.

    A quote's second to fourth words, which a text that contains it has whole between spaces, are its key; texts are cut
    into runs of three words, so an equi join finds the candidates. Quotes of fewer than five words are compared
    directly; they should be few.
    """
    q = quotes.select(F.col(quote_id).alias("__q"), F.col(quote_text).alias("__quote")).where("length(__quote) > 0")
    q = q.withColumn("__words", F.split("__quote", " "))
    long_ = q.where("size(__words) >= 5").select("__q", F.array_join(F.slice("__words", 2, 3), " ").alias("__key"))
    d = docs.select(F.col(doc_id).alias("__d"), F.col(doc_text).alias("__text"))

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))
        return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))

    keys = d.select("__d", F.explode(T.bound(F.split("__text", " "), runs)).alias("__key"))
    hits = keys.join(long_, "__key").select("__d", "__q").distinct()
    full = hits.join(d, "__d").join(q.drop("__words"), "__q").select("__d", "__q", "__text", "__quote")
    short = q.where("size(__words) < 5").drop("__words")
    direct = d.join(short, F.col("__text").contains(F.col("__quote"))).select("__d", "__q", "__text", "__quote")
    out = full.unionByName(direct).withColumn("place", F.expr("instr(__text, __quote)")).where("place > 0")
    return out.select(F.col("__d").alias(doc_id), F.col("__q").alias(quote_id), F.col("place").cast("long").alias("place"))


def shared_words(docs: DataFrame, quotes: DataFrame, doc_id: str, quote_id: str, words: int = 4) -> DataFrame:
    """docs with the quotes that share a run of words with them: candidates for :func:`flexible`."""
    grams = lambda rows, key: rows.select(key, F.explode(T.word_ngrams(T.tokenize("text"), words)).alias("gram"))
    pairs = grams(docs, doc_id).join(grams(quotes, quote_id), "gram").select(doc_id, quote_id).distinct()
    return pairs.join(docs, doc_id).join(quotes.select(quote_id, F.col("text").alias("quote")), quote_id)


def _spaced(quote: str) -> str:
    return r"\s+".join(map(re.escape, quote.split()))


def match(source: str | None, quote: str | None) -> tuple[str, float, int, int] | None:
    """How, how surely and where a quote is in a source: exact, spaces, case, letters and digits, or a run of words."""
    if not source or not quote or not quote.strip():
        return None
    at = source.find(quote)
    if at >= 0:
        return "exact", 1.0, at, at + len(quote)
    for method, confidence, flags in (("spaces", 0.95, 0), ("case", 0.9, re.I)):
        found = re.search(_spaced(quote), source, flags)
        if found:
            return method, confidence, found.start(), found.end()
    kept = [(c.lower(), i) for i, c in enumerate(source) if c.isalnum()]
    plain = "".join(c.lower() for c in quote if c.isalnum())
    if len(plain) >= 10:
        at = "".join(c for c, _ in kept).find(plain)
        if at >= 0 and at + len(plain) <= len(kept):
            return "letters", 0.85, kept[at][1], kept[at + len(plain) - 1][1] + 1
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", source)]
    wanted = re.findall(r"\w+", quote.lower())
    run = SequenceMatcher(None, [w for w, _, _ in words], wanted, autojunk=False).find_longest_match()
    share = run.size / max(1, len(wanted))
    if run.size >= 3 and (share > (0.55 if len(wanted) <= 20 else 0.75) or run.size > 20):
        return "words", round(min(0.5, share / 2), 4), words[run.a][1], words[run.a + run.size - 1][2]
    return None


def flexible(pairs: DataFrame, source: str, quote: str) -> DataFrame:
    """``pairs`` with method, confidence, start and end of the loosest match needed; rows without one go."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", method string, confidence double, start int, end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [match(s.as_py(), q.as_py()) for s, q in zip(b[source], b[quote])]
            keep = [i for i, f in enumerate(found) if f]
            rows = b.take(pa.array(keep, pa.int32()))
            cols = list(zip(*[found[i] for i in keep])) or [[]] * 4
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(c, k) for c, k in zip(cols, kinds)]], [*rows.schema.names, "method", "confidence", "start", "end"])

    return pairs.mapInArrow(run, schema)


def best_sentence(docs: DataFrame, id_col: str, text_col: str, terms: list[str], least: float = 0.3) -> DataFrame:
    """id, sentence, hits, share: the first of the sentences that contain most of the terms, if that is above ``least``."""
    rows = docs.select(id_col, F.posexplode(T.sentences(text_col)).alias("pos", "sentence"))
    hits = sum((F.lower("sentence").contains(t).cast("int") for t in terms), F.lit(0))
    rows = rows.withColumn("hits", hits)
    best = rows.groupBy(id_col).agg(F.max_by(F.struct("sentence", "hits"), F.struct(F.col("hits"), -F.col("pos"))).alias("b"))
    out = best.select(id_col, "b.sentence", "b.hits", (F.col("b.hits") / len(terms)).alias("share"))
    return out.where(F.col("share") > least)


def validated(citations: DataFrame, docs: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """citations with status: missing (no source), empty, exact, normalized or not-found."""
    joined = citations.join(docs.select(key, F.col(text).alias("__text")), key, "left")
    status = (
        F.when(F.col("__text").isNull(), "missing")
        .when(F.coalesce(F.trim(quote), F.lit("")) == "", "empty")
        .when(F.col("__text").contains(F.col(quote)), "exact")
        .when(T.normalize_quote("__text").contains(T.normalize_quote(quote)), "normalized")
        .otherwise("not-found")
    )
    return joined.withColumn("status", status).drop("__text")


def distinct_quotes(rows: DataFrame, by: list[str], quote: str, order: str, least: float = 0.85) -> DataFrame:
    """Quotes per group without those whose first 100 characters, or words, equal an earlier one's."""
    first = Window.partitionBy(*by, F.substring(quote, 1, 100)).orderBy(order)
    rows = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    words = T.word_set(quote)
    lead = F.first(words).over(Window.partitionBy(*by).orderBy(order))
    near = (T.jaccard(words, lead) >= least) & (F.row_number().over(Window.partitionBy(*by).orderBy(order)) > 1)
    return rows.withColumn("__near", near).where(~F.col("__near")).drop("__near")
