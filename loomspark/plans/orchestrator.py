"""Steps over frames, with stored artefacts, resume, early stop and reuse by content."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import aggregation, chunking, models, retrieval, similarity
from loomspark.sources.tables import Steps

Step = Callable[[dict[str, DataFrame]], DataFrame]


class Run:
    """A linear run of named steps; each sees the results of those before it."""

    def __init__(self, spark: SparkSession, steps: dict[str, Step], store: Steps, partition: str, label: str = "default"):
        self.spark, self.steps, self.store, self.partition, self.label = spark, steps, store, partition, label
        self.seconds: dict[str, float] = {}

    def run(self, resume_from: str | None = None, stop_after: str | None = None) -> dict[str, DataFrame]:
        """Results by step. Steps before ``resume_from`` are read from the store."""
        names = list(self.steps)
        first = names.index(resume_from) if resume_from else 0
        done: dict[str, DataFrame] = {}
        for i, name in enumerate(names):
            found = self.store.load(self.partition, name, self.label) if i < first else None
            if found is None:
                began = time.monotonic()
                found = self.store.save(self.steps[name](done), self.partition, name, self.label)
                self.seconds[name] = time.monotonic() - began
            done[name] = found
            if name == stop_after:
                break
        return done

    def remaining(self) -> float:
        """Estimated seconds to go: the mean of the steps so far for each that is left."""
        left = len(self.steps) - len(self.seconds)
        return left * sum(self.seconds.values()) / len(self.seconds) if self.seconds else 0.0


def consultation(responses: DataFrame, query: str, k: int = 10) -> dict[str, Step]:
    """Steps from responses (id, text, theme) to ranked chunks, extracted arguments and themes' statistics."""
    return {
        "load": lambda r: responses.where(F.length(F.trim("text")) > 0),
        "chunks": lambda r: chunking.chunked(r["load"], "id", "text"),
        "embed": lambda r: models.embedded(r["chunks"], "content"),
        "retrieve": lambda r: retrieval.top_k(
            retrieval.combine(
                retrieval.cosine_scores(_keyed(r["embed"]), F.array(*map(F.lit, models.stub_embed([query])[0])), "chunk_id", "embedding"),
                retrieval.bm25(_keyed(r["embed"]), query.lower().split(), "chunk_id", "content"),
                "chunk_id",
            ),
            "chunk_id",
            k,
        ),
        "arguments": lambda r: models.extracted(r["load"], "text").select("id", "theme", F.posexplode("arguments").alias("arg_index", "what")),
        "themes": lambda r: aggregation.word_counts(r["arguments"].withColumn("w", F.split("what", " ")), ["theme"], F.col("w"), 5),
        "stats": lambda r: similarity.distribution(_keyed(r["embed"]).withColumn("__id", F.xxhash64("chunk_id")), "__id", "embedding"),
    }


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.concat_ws("-", F.col("id").cast("string"), F.lpad(F.col("chunk_index").cast("string"), 5, "0")))
