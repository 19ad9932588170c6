"""Exact top-k search by inner product: norm-bucketed retrieval.

Candidates are grouped by length into bands, and bands are cut into chunks of bounded size; a chunk's rows lie in order
of length and form buckets. A first pass over one chunk of the longest vectors gives each query a threshold, the k-th
best product found there, which its true k-th best cannot be below. For a bucket, threshold / (query's length *
longest candidate's length) is the local cosine threshold. Above 1, no candidate can reach it: the bucket is skipped
for that query. Where it is high, coordinates prune: the angle between candidate and query is small, so in the query's
largest coordinates the candidate must lie in narrow ranges. Where it is low, only length prunes. Survivors are
verified with exact integer products, and each query's best over all chunks are ranked.

Queries come in blocks and meet chunks, one (block, chunk) pair a group, so that the memory of a task does not depend on
the input. Bands lie in order of length, so the bands that a query can reach are a first few; queries that reach as many
share blocks. Neither queries nor candidates are sent to a pair whose bound rules it out. Products are exact: in doubles as long as no sum can pass 2**53, else in Python's integers.

Cases: a vector that is null or holds a null or a non-finite component, or whose id is null, takes no part; shorter
vectors count as filled up with zeros; rows that repeat id and vector count once; if an id has several vectors, the
smallest speaks for it as a query and none of them is its candidate; ties go to the smaller id; an empty table gives an
empty result; only id and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import exploded_range, stored, table

#: Queries in a block, candidates in a chunk and in a bucket, bands of length.
QUERY_BLOCK, CHUNK, BUCKET, BANDS = 2048, 4096, 512, 64
#: Local cosine threshold from which coordinates prune, and the coordinates looked at.
STEEP, FOCUS = 0.5, 4
FOUND = "query_id long, vec_id long, score long"


def integer_vector(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(t: pa.Table, width: int) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, width)


def _exact(q: np.ndarray, c: np.ndarray) -> type:
    """A type in which all products of the rows are exact."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    return np.float64 if most < 2**53 else object


def survivors(q: np.ndarray, q_len: np.ndarray, theta: np.ndarray, c: np.ndarray, c_len: np.ndarray, steep: float = STEEP):
    """Index pairs (query, candidate) of one bucket that may reach the queries' thresholds.

    ``theta`` is -inf where a query has no threshold yet.
    """
    longest = c_len.max(initial=0.0)
    active = np.flatnonzero(theta <= q_len * longest * (1 + 1e-9) + 1e-9)
    if not len(active):
        return active, active
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_len[active] * longest > 0, theta[active] / (q_len[active] * longest), -1.0)
        if np.median(local) < steep:
            reach = c_len[None, :] * q_len[active][:, None] * (1 + 1e-9) + 1e-9 >= theta[active][:, None]
            a, b = np.nonzero(reach)
            return active[a], b
        unit_q = q[active] / np.maximum(q_len[active], 1e-300)[:, None]
        unit_c = c / np.maximum(c_len, 1e-300)[:, None]
    near = np.arccos(np.clip(local, -1, 1))
    keep = np.ones((len(active), len(c)), bool)
    rows = np.arange(len(active))
    order = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
    for f in order.T:
        own = np.arccos(np.clip(unit_q[rows, f], -1, 1))
        low, high = np.cos(np.minimum(np.pi, own + near)) - 1e-9, np.cos(np.maximum(0.0, own - near)) + 1e-9
        at = unit_c[:, f].T
        keep &= (at >= low[:, None]) & (at <= high[:, None])
    keep |= (theta[active] <= 0)[:, None]
    a, b = np.nonzero(keep)
    return active[a], b


def best_of_chunk(queries: pa.Table, candidates: pa.Table, k: int, width: int) -> pa.Table:
    """Each query's k best candidates of one chunk, as far as they reach its threshold."""
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
    if not queries.num_rows or not candidates.num_rows:
        return empty
    q, c = _matrix(queries, width), _matrix(candidates, width)
    q_id, c_id = queries.column("query_id").to_numpy(), candidates.column("vec_id").to_numpy()
    theta = np.array([-np.inf if x is None else float(x) for x in queries.column("theta").to_pylist()])
    kind = _exact(q, c)
    length = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
    q_len, c_len = length(q), length(c)
    order = np.argsort(-c_len, kind="stable")
    c, c_id, c_len, q, c_exact = c[order], c_id[order], c_len[order], q, c[order].astype(kind)
    q_exact = q.astype(kind)
    got_q, got_c, got_s = [], [], []
    for at in range(0, len(c), BUCKET):
        part = slice(at, at + BUCKET)
        a, b = survivors(q, q_len, theta, c[part], c_len[part])
        if not len(a):
            continue
        if len(a) > 0.2 * len(q) * len(c_len[part]):
            score = (q_exact @ c_exact[part].T)[a, b]
        else:
            score = np.concatenate([(q_exact[a[i : i + 65536]] * c_exact[part][b[i : i + 65536]]).sum(axis=1) for i in range(0, len(a), 65536)])
        good = (score >= theta[a]) & (q_id[a] != c_id[part][b])
        got_q.append(q_id[a[good]])
        got_c.append(c_id[part][b[good]])
        got_s.append(score[good])
    if not got_q:
        return empty
    ids, found, scores = np.concatenate(got_q), np.concatenate(got_c), np.concatenate(got_s)
    scores = scores.astype(np.int64) if kind is np.float64 else np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], np.int64)
    order = np.lexsort((found, -scores.astype(np.float64) if kind is np.float64 else ~scores, ids))
    ids, found, scores = ids[order], found[order], scores[order]
    begin = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1]
    rank = np.arange(len(ids)) - np.repeat(begin, np.diff(np.r_[begin, len(ids)]))
    top = rank < k
    return pa.table({"query_id": ids[top], "vec_id": found[top], "score": scores[top]})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where ``is_query`` holds, the k other vectors of highest product."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integer_vector(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
    rows = rows.where("vec_id is not null and v is not null").groupBy("vec_id", "v").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = stored(rows.withColumn("length", length), "topk-vectors")
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.percentile_approx("length", [i / BANDS for i in range(1, BANDS)]).alias("cuts")).first()
    width = facts["width"] or 0
    # Bands by quantiles of length; each band is cut by a hash into chunks, so equal lengths, however many, spread.
    cuts = sorted(set(facts["cuts"] or []), reverse=True)
    band = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda x: x >= F.col("length")))
    rows = rows.withColumn("band", band)
    parts, longest, chunks = {}, {}, 0
    for r in sorted(rows.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect(), key=lambda r: r["band"]):  # at most BANDS rows
        parts[r["band"]] = (chunks, -(-r["n"] // CHUNK))
        longest[r["band"]] = r["longest"]
        chunks += parts[r["band"]][1]
    if not chunks:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    known = lambda found, of: F.element_at(F.create_map(*[F.lit(x) for pair in found.items() for x in pair]), F.col(of))
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    chunk = known({b: p[0] for b, p in parts.items()}, "band") + F.pmod(F.xxhash64("vec_id", "v"), known({b: p[1] for b, p in parts.items()}, "band"))
    candidates = rows.select("vec_id", filled.alias("v"), "band", chunk.cast("long").alias("chunk"))
    asking = rows.where("asks").groupBy("vec_id").agg(F.min_by("length", "v").alias("length"), F.min("v").alias("v"))
    asking = stored(asking.select(F.col("vec_id").alias("query_id"), "length", filled.alias("v")), "topk-queries")

    def best(keys, queries: pa.Table, found: pa.Table) -> pa.Table:
        return best_of_chunk(queries, found, k, width)

    def meet(queries: DataFrame, found: DataFrame) -> DataFrame:
        queries = queries.select("query_id", "v", "theta", "block", "chunk")
        found = found.select("vec_id", "v", "block", "chunk")
        return queries.groupBy("block", "chunk").cogroup(found.groupBy("block", "chunk")).applyInArrow(best, FOUND)

    blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    seeds = asking.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)), "theta": F.lit(None).cast("long"), "chunk": F.lit(0).cast("long")})
    theta = meet(seeds, exploded_range(candidates.where("chunk = 0"), blocks, "block")).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("theta"))
    # Bands that a query reaches: their longest vector may get to its threshold.
    reaches = F.array(*[F.lit(longest[b]) for b in sorted(longest)])
    reached = F.size(F.filter(reaches, lambda x: F.col("theta").isNull() | (F.col("length") * x * (1 + 1e-9) + 1e-9 >= F.col("theta"))))
    asking = stored(asking.join(theta, "query_id", "left").withColumn("reached", F.greatest(reached, F.lit(1))), "topk-asking")
    number = {r["reached"]: r["count"] for r in asking.groupBy("reached").count().collect()}  # at most BANDS rows
    bands, starts, upto, after = sorted(parts), {}, {}, 0
    # Blocks are numbered from the queries that reach most, so those that need a band are a first few, too.
    for r in sorted(number, reverse=True):
        starts[r] = (after, -(-number[r] // QUERY_BLOCK))
        after += starts[r][1]
        upto[r] = sum(parts[bands[-1]]) if r >= len(bands) else parts[bands[r]][0]
    needed = {b: sum(n for r, (_, n) in starts.items() if r > at) for at, b in enumerate(bands)}
    if not starts:
        return _ranked(meet(seeds, exploded_range(candidates.where("chunk = 0"), 1, "block")), k).select("query_id", "rank", "vec_id", "score")
    block = known({r: s[0] for r, s in starts.items()}, "reached") + F.pmod(F.xxhash64("query_id"), known({r: s[1] for r, s in starts.items()}, "reached"))
    asking = exploded_range(asking.withColumn("block", block.cast("long")), known(upto, "reached").cast("long"), "chunk")
    candidates = exploded_range(candidates, known(needed, "band").cast("long"), "block")
    return _ranked(meet(asking, candidates), k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
