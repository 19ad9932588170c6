"""Parameters of a run as Column expressions of its size, so that many consultations get theirs in one job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.operators.aggregation import banded

#: Upper bounds and what holds up to them; the last value holds beyond. None stands for no limit.
AGGREGATION_BATCH = ([(10, None), (30, 30), (60, 20)], 15)
WRITER_CHUNK = ([(10, None), (30, 30), (50, 25)], 20)
VALIDATIONS = ([(5, 10), (10, 30), (20, 50)], 100)
SCALE = ([(5, "tiny"), (20, "small"), (50, "medium"), (150, "large")], "xlarge")
AGGREGATION_TIER = ([(100, "small"), (500, "medium")], "large")
RELEVANCE = ([(10, 0.10), (20, 0.15), (50, 0.20), (150, 0.25), (500, 0.30)], 0.35)
HARMONIZATION = ([(99, 0.88), (499, 0.85), (1499, 0.82)], 0.80)
SENTENCES_MIN = ([(15, 1), (40, 2), (100, 4), (300, 5), (800, 7)], 10)
SENTENCES_MAX = ([(15, 2), (40, 3), (100, 5), (300, 7), (800, 10)], 16)
BATCH_BY_CLASS = {"light": 30, "medium": 20, "heavy": 10}
DEDUPLICATION = {"trivial": 0.88, "simple": 0.88, "moderate-low": 0.90, "moderate-mid": 0.92, "moderate-high": 0.93}
#: Texts that only say that the answer is elsewhere.
PLACEHOLDERS = [
    r"^høringssvar modtaget på (mail|blivhørt)\.?$", r"^modtaget på (mail|blivhørt)\.?$", r"^sendt via (mail|email)\.?$", r"^vedhæftet\.?$", r"^se vedhæftning\.?$", r"^se vedhæftet\.?$",
]


def by_bands(value: Column, table: tuple[list[tuple[float, object]], object]) -> Column:
    return banded(value, *table)


def is_placeholder(text: Column) -> Column:
    """Empty texts and those that match a placeholder as a whole."""
    plain = F.lower(F.trim(text))
    hit = F.coalesce(plain, F.lit("")) == ""
    for p in PLACEHOLDERS:
        hit = hit | F.coalesce(plain.rlike(p), F.lit(False))
    return hit


def retrieval_k(chunks: Column) -> Column:
    """How many chunks to retrieve: most of few, three tenths up to fifty, then by bands."""
    few = F.greatest(F.lit(3), chunks)
    share = F.least(F.lit(10), F.ceil(chunks * 0.3))
    return F.when(chunks <= 10, few).when(chunks <= 50, share).when(chunks <= 200, 20).when(chunks <= 500, 30).otherwise(40).cast("long")


def rerank_k(k: Column) -> Column:
    few = F.greatest(F.lit(2), k)
    return F.when(k <= 5, few).when(k <= 10, F.ceil(k * 0.6)).when(k <= 20, 10).otherwise(F.least(F.lit(15), F.ceil(k * 0.5))).cast("long")


def embedding_batch(items: Column) -> Column:
    return F.when(items <= 20, items).when(items <= 100, 50).otherwise(100).cast("long")


def model_batch(items: Column, kind: str = "medium") -> Column:
    base = BATCH_BY_CLASS.get(kind, 20)
    return F.when(items <= 5, items).when(items <= 10, F.least(F.lit(10), items)).when(items <= 20, min(15, base)).otherwise(base).cast("long")


def relevance(responses: Column, diversity: Column) -> Column:
    """By bands, lower for diverse answers and higher for uniform ones, from 0.05 to 0.40."""
    shift = F.when(diversity > 0.6, -0.05).when(diversity < 0.3, 0.03).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.40), by_bands(responses, RELEVANCE) + shift))


def explosion(arguments: Column, positions: Column, threshold: Column) -> dict[str, Column]:
    """ratio of positions to arguments, its status, and the threshold that follows, from 0.60 to 0.90."""
    ratio = F.when(arguments == 0, 0.0).otherwise(positions / arguments)
    status = (
        F.when(arguments == 0, "N/A").when(ratio > 0.7, "TOO_MANY_POSITIONS").when(ratio > 0.5, "SLIGHTLY_HIGH").when(ratio < 0.3, "GOOD_CONSOLIDATION").when(ratio < 0.4, "OPTIMAL").otherwise("ACCEPTABLE")
    )
    shift = F.when(status == "TOO_MANY_POSITIONS", -0.03).when(status == "SLIGHTLY_HIGH", -0.01).otherwise(0.0)
    moved = F.greatest(F.lit(0.60), F.least(F.lit(0.90), threshold + shift))
    return {"ratio": ratio, "status": status, "threshold": F.when(arguments == 0, threshold).otherwise(moved)}


def verbosity(respondents: Column, merges: Column) -> Column:
    return F.when((respondents > 20) | (merges > 5), "high").when((respondents > 10) | (merges > 3), "medium").otherwise("low")


def section_size(depth: Column, most: int, least: int) -> Column:
    """Smaller for deeper sections: down to the middle between most and least at depth six."""
    return F.floor(most - (most - least) * F.least(depth, F.lit(6)) / 6 * 0.5 + 0.5).cast("long")


def batches(items: Column, most: int) -> Column:
    """Sizes of batches: full ones, then the rest."""
    count = F.greatest(F.ceil(items / most), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.least(items - i * most, F.lit(most)).cast("long"))
