"""Language identification: the nearest of several centroids per language, by cosine of TF-IDF character n-grams.

A text's letters are lowered, all else counts as a word border; n-grams of one to three characters are hashed into a
fixed number of features. Document frequencies are counted over all training rows. The centroids are clustered (k-means
on the sphere, per language) from a sample of bounded size. A text is put into the language of the nearest centroid,
and rejected if it lies farther from it than texts of its length do: the bound of a language and size lies ``REACH`` of the
way from what nearly all texts of other languages stay under to what nearly all texts of the language itself reach. So
a few odd texts or wrong labels move no bound, and the shortest texts none but their own.

Cases: a null text, an empty one and one without a letter give ``und`` with score 0 and are rejected; texts of any
length are read whole; if no row is labelled, every text is ``und``; equal texts get equal results; an empty table gives
an empty result; the output has only the id and the columns named here, so others cannot clash. Of centroids equally
near, the first language in order wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import table, worker_tables

#: Features (a power of two), centroids per language, different labelled texts per language that the centroids are clustered from.
BITS, CENTROIDS, SAMPLE = 12, 4, 600
FEATURES = 1 << BITS
REACH = 0.5
#: Share of texts that a bound leaves out; size classes; sampled rows of a language that a bound needs, or takes shorter ones to.
LOW, SIZES, ENOUGH = 0.02, 24, 20
#: Share of a language's sample that a centroid needs.
LEAST_SHARE = 0.04
UNKNOWN = "und"
#: Characters that are worked on at a time.
AT_ONCE = 400_000
SPACE = 32


def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space for what is no letter."""
    return worker_tables("langid", _all_letters)


def _all_letters() -> np.ndarray:
    found = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            found[c] = ord(x.lower()[0])
    return found


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts, a row for each text."""
    lengths = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _letters()[points]
    doc = np.repeat(np.arange(len(texts)), lengths)
    keep = np.ones(len(found), bool)  # one space between words
    keep[1:] = (found[1:] != SPACE) | (found[:-1] != SPACE)
    a = np.concatenate([[SPACE], found[keep], [SPACE]]).astype(np.uint32)
    doc = doc[keep]
    left, mid, right = a[:-2], a[1:-1], a[2:]
    inside = mid != SPACE
    doc, left, mid, right = doc[inside], left[inside], mid[inside], right[inside]
    one = mid * np.uint32(0x9E3779B1)
    two = one + right * np.uint32(0x85EBCA77) + np.uint32(1)
    three = two + left * np.uint32(0xC2B2AE3D) + np.uint32(1)
    at = doc * FEATURES
    cells = np.concatenate([at + ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)) for h in (one, two, three)])
    return np.bincount(cells, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)


def in_portions(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Start and texts of portions of a bounded number of characters (of one text at least)."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > AT_ONCE:
            yield start, held
            start, held, size = i, [], 0
        held.append(t)
        size += len(t) + FEATURES // 16
    if held:
        yield start, held


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of counts; zero where a text has no letter."""
    with np.errstate(divide="ignore"):
        v = np.where(found > 0, 1 + np.log(found, dtype=np.float32), 0).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def size_class(found: np.ndarray) -> np.ndarray:
    """The power of two that the number of letters reaches (three n-grams a letter)."""
    return np.log2(np.maximum(found.sum(axis=1) // 3, 1)).astype(int)


def clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of k-means by cosine, begun with the mean and then with the vectors farthest from all chosen."""
    mean = vectors.mean(axis=0)
    chosen = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(vectors[np.argmin((vectors @ np.array(chosen).T).max(axis=1))])
    centers = np.array(chosen)
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        for j in range(len(centers)):
            if (own == j).any():
                c = vectors[own == j].mean(axis=0)
                centers[j] = c / max(np.linalg.norm(c), 1e-12)
    # A few vectors far from all others are wrong labels rather than a kind of text.
    members = np.bincount((vectors @ centers.T).argmax(axis=1), minlength=len(centers))
    return centers[members >= max(1, LEAST_SHARE * len(vectors))]


def bounds(sizes: np.ndarray, own: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The least cosine accepted by language and size, from rows' sizes, languages and greatest cosines to each language.

    A size with too few rows of a language takes in its rows of the next shorter sizes; a language without rows as short as
    a size has the lowest bound of the others; what no language has, is accepted.
    """
    found = np.full((cosine.shape[1], SIZES), np.inf)
    for j in range(cosine.shape[1]):
        mine, shortest = sizes[own == j], sizes[own == j].min(initial=SIZES)
        for size in range(shortest, SIZES):
            low = size
            while low > shortest and ((mine >= low) & (mine <= size)).sum() < ENOUGH:
                low -= 1
            inside = (sizes >= low) & (sizes <= size)
            good, others = cosine[inside & (own == j), j], cosine[inside & (own != j), j]
            reached, stayed = np.quantile(good, LOW), np.quantile(others, 1 - LOW) if len(others) else 0.0
            found[j, size] = stayed + REACH * (reached - stayed) if stayed < reached else reached
    if len(found):
        found = np.where(np.isinf(found), found.min(axis=0), found)
    return np.where(np.isinf(found), 0, found)


class Model:
    """Centroids, their languages, and the least cosine accepted by language (in order of its centroids) and size."""

    def __init__(self, idf: np.ndarray, centers: np.ndarray, langs: list[str], least: np.ndarray):
        self.idf, self.centers, self.langs, self.least = idf, centers, langs, least
        self.row = np.array([sorted(set(langs)).index(x) for x in langs], int)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        for _, part in in_portions(texts):
            found = counts(part)
            some = found.any(axis=1)
            if not self.langs:
                some[:] = False
                near, score, least = np.zeros(len(part), int), np.zeros(len(part)), 0
            else:
                cosine = weighted(found, self.idf) @ self.centers.T
                near, score = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0, 1)
                least = self.least[self.row[near], np.minimum(size_class(found), SIZES - 1)]
            far = score < least
            langs += [self.langs[n] if s else UNKNOWN for n, s in zip(near, some)]
            scores += [float(x) if s else 0.0 for x, s in zip(score, some)]
            rejected += [bool(f or not s) for f, s in zip(far, some)]
        return langs, scores, rejected


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model from ``labelled`` (text, lang), of which only rows with text and language count. Languages are taken to be few."""
    labelled = labelled.where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            for _, part in in_portions(batch["text"].to_pylist()):
                df[:FEATURES] += (counts(part) > 0).sum(axis=0)
                rows += len(part)
        df[FEATURES] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(df)], ["feature", "df"])

    df = np.zeros(FEATURES + 1, np.int64)
    for r in labelled.select("text").mapInArrow(frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    idf = (np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1).astype(np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for start, part in in_portions(batch["text"].to_pylist()):
                found = counts(part)
                v = weighted(found, idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[start : start + len(part)]), pa.array(size_class(found)), pa.array([x.tobytes() for x in v], pa.binary())], ["lang", "size", "v"]
                )

    # A sample by a hash of the text alone: of each language about ``sample`` different texts, however many there are.
    draw = F.xxhash64(F.lit(1), "text")
    totals = {r["lang"]: max(1, r["n"]) for r in labelled.groupBy("lang").agg(F.approx_count_distinct(draw, 0.02).alias("n")).collect()}
    if not totals:
        return Model(idf, np.zeros((0, FEATURES), np.float32), [], np.zeros((0, SIZES)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, sample / n))]), F.col("lang"))
    picked = labelled.withColumn("draw", draw).where(F.pmod("draw", F.lit(1_000_000)) / 1e6 < share).dropDuplicates(["lang", "draw"])
    picked = picked.select("lang", "text").mapInArrow(vectors, "lang string, size long, v binary").toPandas()
    langs, centers, sampled = [], [], []
    for lang in sorted(totals):
        own = picked[picked["lang"] == lang]
        if not len(own):
            continue
        m = _rows(own["v"])
        own = own[m.any(axis=1)]
        m = m[m.any(axis=1)]
        if not len(m):
            continue
        c = clustered(m, centroids)
        centers.append(c)
        langs += [lang] * len(c)
        sampled.append(own)
    if not centers:
        return Model(idf, np.zeros((0, FEATURES), np.float32), [], np.zeros((0, SIZES)))
    cosine = np.concatenate([np.stack([(m @ c.T).max(axis=1) for c in centers], axis=1) for m in (_rows(x["v"]) for x in sampled)])
    sizes = np.minimum(np.concatenate([x["size"].to_numpy() for x in sampled]), SIZES - 1)
    least = bounds(sizes, np.repeat(np.arange(len(sampled)), [len(x) for x in sampled]), cosine)
    return Model(idf, np.concatenate(centers).astype(np.float32), langs, least)


def _rows(packed) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float16) for x in packed]).astype(np.float32)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = model.predict([t or "" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of the id in decimal, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    kept = docs.where(~held_out(id_col))
    return kept.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is accepted as one of the languages, with all their columns."""
    model = fit(training(docs, id_col, text_col, lang_col))

    @F.pandas_udf("boolean")
    def accepted(texts):
        import pandas as pd

        return pd.Series([not r for r in model.predict([t or "" for t in texts])[2]])

    return docs.where(accepted(F.col(text_col).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(training(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
