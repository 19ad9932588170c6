"""The boundary to models: functions passed in, with stubs that depend on the text alone.

Embedding, extraction, judging, scoring and writing are plain Python callables on batches; the engine calls them over
Arrow batches, tries a failed batch again, and keeps the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stub_embed(texts: list[str], size: int = 16) -> list[list[float]]:
    """Vectors from hashes of words: equal texts get equal vectors, texts with common words similar ones."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            h = hashlib.md5(w.encode()).digest()
            v[h[0] % size] += 1.0 if h[1] % 2 else -1.0
        out.append(v)
    return out


def stub_score(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of the first text's words that the second has."""
    found = []
    for a, b in pairs:
        words = set(a.lower().split())
        found.append(len(words & set(b.lower().split())) / len(words) if words else 0.0)
    return found


def stub_extract(texts: list[str]) -> list[list[str]]:
    """The sentences of a text as its arguments."""
    return [[s.strip() for s in t.split(".") if s.strip()] for t in texts]


def _tried(call: Callable, batch: list, tries: int, empty) -> tuple[list, list[str | None]]:
    """The model's values and, where it failed to the last, empty ones with what went wrong."""
    error = "no try"
    for _ in range(tries):
        try:
            return call(batch), [None] * len(batch)
        except Exception as e:  # noqa: BLE001  a model may fail in any way; the rows then say how
            error = f"{type(e).__name__}: {e}"
    return [empty] * len(batch), [error] * len(batch)


def _batches(rows: list, size: int) -> Iterator[list]:
    for i in range(0, len(rows), size):
        yield rows[i : i + size]


def with_column(df: DataFrame, inputs: list[str], out: str, kind: str, call: Callable, batch: int = 100, tries: int = 3, most_chars: int | None = None, empty=None, error: str | None = None) -> DataFrame:
    """``df`` with the model's value for each row; one input gives texts, several tuples.

    Inputs are whole unless ``most_chars`` cuts them. Rows of a batch that fails ``tries`` times get ``empty`` and, in the column
    that ``error`` names, the reason; without such a column the job fails.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", {out} {kind}" + (f", {error} string" if error else ""))
    arrow = to_arrow_schema(schema).field(out).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[(x or "")[:most_chars] for x in b[c].to_pylist()] for c in inputs]
            rows = cols[0] if len(inputs) == 1 else list(zip(*cols))
            values, errors = [], []
            for part in _batches(rows, batch):
                got, why = _tried(call, part, tries, empty)
                values += got
                errors += why
            if error is None and any(errors):
                raise RuntimeError(f"the model failed {tries} times: {next(filter(None, errors))}")
            more = [pa.array(errors, pa.string())] if error else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, arrow), *more], [*b.schema.names, out, *([error] if error else [])])

    return df.mapInArrow(run, schema)


def embedded(df: DataFrame, text: str, call: Callable = stub_embed, out: str = "embedding", **options) -> DataFrame:
    """Vectors for texts: each distinct text is embedded once and joined back by its hash."""
    keyed = df.withColumn("__h", F.sha2(text, 256))
    distinct = keyed.select("__h", F.col(text).alias("__t")).dropDuplicates(["__h"])
    vectors = with_column(distinct, ["__t"], out, "array<double>", call, empty=[], **options).drop("__t")
    return keyed.join(vectors, "__h", "left").drop("__h")


def reranked(scored: DataFrame, query: str, text: str, id_col: str, k: int, call: Callable = stub_score) -> DataFrame:
    """Half the score and half the model's, the best k."""
    rows = with_column(scored.withColumn("__q", F.lit(query)), ["__q", text], "model_score", "double", call, empty=0.0).drop("__q")
    return rows.withColumn("score", 0.5 * F.col("score") + 0.5 * F.col("model_score")).orderBy(F.col("score").desc(), id_col).limit(k)


def extracted(df: DataFrame, text: str, call: Callable = stub_extract, out: str = "arguments", **options) -> DataFrame:
    return with_column(df, [text], out, "array<string>", call, batch=20, empty=[], **options)
