"""Pairs of similar vectors, their distribution, nearest centroids, sign hashing and k-means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.vectors import centroids, cosine, norm
from loomspark.sources.tables import checkpointed

Strips = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]


def cosine_pairs(rows: DataFrame, id_col: str, vector: str, least: float | None = None, by: list[str] | None = None) -> DataFrame:
    """i, j, sim for i < j, within blocks of equal ``by`` where given. Norms are computed once per row.

    Without blocks the work is quadratic: :func:`all_pairs` is the form for whole tables, :func:`lsh_pairs` the one that
    may miss some.
    """
    by = by or []
    side = lambda n: rows.select(*[F.col(c).alias(f"{c}_{n}") for c in by], F.col(id_col).alias(n), F.col(vector).alias(f"v_{n}"), norm(F.col(vector)).alias(f"norm_{n}"))
    on = F.col("i") < F.col("j")
    for c in by:
        on = on & (F.col(f"{c}_i") == F.col(f"{c}_j"))
    pairs = side("i").join(side("j"), on)
    pairs = pairs.select("i", "j", cosine(F.col("v_i"), F.col("v_j"), F.col("norm_i"), F.col("norm_j")).alias("sim"))
    return pairs if least is None else pairs.where(F.col("sim") >= least)


#: Rows on either side of a block of pairs, and rows whose products are held at once.
PAIR_BLOCK, PAIR_STRIP = 4096, 256


def _blocks(rows: DataFrame, id_col: str, vector: str, by: str | None, fold: Callable[[Strips], Iterator[pa.RecordBatch]], schema: str, undefined: bool = False) -> DataFrame:
    """``fold`` of each block's strips (i, j and sim as arrays, for pairs of ids that differ): every pair is in one block, once.

    The n rows of each value of ``by`` are dealt to n / ``PAIR_BLOCK`` parts by a hash, and each two parts meet in a task of their
    own, so no task holds more than two parts, however common a value is. A strip has at most ``PAIR_STRIP`` rows of one part.
    """
    one = (F.lit(0) if by is None else F.col(by)).alias("by")
    kind = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = checkpointed(rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(one, F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast(kind)).alias("v")))
    parts = rows.groupBy("by").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("parts"))
    rows = rows.join(parts, "by").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = rows.select("by", "id", "v", "part", other).select("by", "id", "v", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))

    def strips(cell: pa.Table) -> Strips:
        v, part, all_ids = cell.column("v").combine_chunks(), cell.column("part").to_numpy(), cell.column("id").to_numpy()
        flat, ends = v.flatten(), np.cumsum([0, *v.value_lengths().to_numpy()])
        lost = np.cumsum([0, *flat.is_null().to_numpy(zero_copy_only=False)])
        whole, width = lost[ends[1:]] == lost[ends[:-1]], np.diff(ends)
        flat = flat.to_numpy(zero_copy_only=False)
        own = cell.column("a")[0].as_py() == cell.column("b")[0].as_py()
        for size in np.unique(width[whole]):
            at = np.flatnonzero(whole & (width == size))
            m = flat[ends[at][:, None] + np.arange(size)].astype(float)
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                m = m / (norms if undefined else np.maximum(norms, 1e-300))
            here, there = (np.arange(len(at)),) * 2 if own else (np.flatnonzero(part[at] == part.min()), np.flatnonzero(part[at] != part.min()))
            ids, others = all_ids[at][here], all_ids[at][there]
            for k in range(0, len(here), PAIR_STRIP):
                yield ids[k : k + PAIR_STRIP], others, m[here[k : k + PAIR_STRIP]] @ m[there].T, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(strips(pa.Table.from_batches(list(batches))))

    return cells.groupBy("by", "a", "b").applyInArrow(run, schema)


def all_pairs(rows: DataFrame, id_col: str, vector: str, least: float | None = None, by: str | None = None, undefined: bool = False) -> DataFrame:
    """i, j, sim for all i < j whose cosine reaches ``least``: every pair is looked at, as products of blocks of vectors.

    With ``by``, pairs have an equal value of it (not null). Pairs leave a task strip by strip, see :func:`_blocks`. Ids are longs;
    rows without a vector, or with one of another width than the block's, make no pair. With ``undefined``, a pair whose cosine is
    not a number, as that of a zero vector, reaches any ``least``, as it does in SQL.
    """

    def fold(strips: Strips) -> Iterator[pa.RecordBatch]:
        for ids, others, sim, own in strips:
            keep = np.ones(sim.shape, bool) if least is None else ~(sim < least) if undefined else sim >= least
            r, c = np.divmod(np.flatnonzero(keep), len(others))
            if own:  # a block with itself has each pair twice; ids of different parts differ
                once = ids[r] < others[c]
                r, c = r[once], c[once]
            left, right = ids[r], others[c]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(sim[r, c])], ["i", "j", "sim"])

    return _blocks(rows, id_col, vector, by, fold, "i long, j long, sim double", undefined)


def tables_for(least: float, planes: int, recall: float) -> int:
    """Tables of planes with which a pair of cosine ``least`` shares a bucket with probability ``recall``."""
    same = (1 - np.arccos(least) / np.pi) ** planes
    return int(np.ceil(np.log(1 - recall) / np.log(1 - same)))


def sign_hashes(rows: DataFrame, id_col: str, vector: str, tables: int = 12, planes: int = 8, seed: int = 7) -> DataFrame:
    """id, vector and bucket: the signs of projections on random planes, a row for each table of planes."""
    width = rows.select(F.size(vector).alias("n")).agg(F.max("n")).first()[0] or 0
    drawn = np.random.default_rng(seed).normal(size=(tables, planes, width))
    keys = []
    for t in range(tables):
        bits = F.lit(0)
        for p in range(planes):
            plane = F.array(*[F.lit(float(x)) for x in drawn[t, p]])
            total = F.aggregate(F.zip_with(F.col(vector), plane, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
            bits = bits * 2 + (total >= 0).cast("int")
        keys.append(F.concat(F.lit(f"{t}:"), bits.cast("string")))
    return rows.select(F.col(id_col), F.col(vector), F.explode(F.array(*keys)).alias("bucket"))


def lsh_pairs(rows: DataFrame, id_col: str, vector: str, least: float, planes: int = 3, recall: float = 0.98) -> DataFrame:
    """Pairs that share a bucket and reach ``least``; candidates are not capped, and not stored: each bucket is compared in blocks.

    There are as many tables as give a pair at the threshold the wanted probability; low thresholds need few planes. Where the buckets
    of all tables hold half of all pairs or more, all pairs are compared once instead, which costs less and misses none.
    """
    tables = tables_for(least, planes, recall)
    if tables >= 2**planes / 2:
        return all_pairs(rows, id_col, vector, least)
    found = all_pairs(sign_hashes(rows, id_col, vector, tables, planes), id_col, vector, least, "bucket")
    return found.groupBy("i", "j").agg(F.max("sim").alias("sim"))


def distribution(rows: DataFrame, id_col: str, vector: str, digits: int = 6) -> DataFrame:
    """n, mean, std, median, p10, p90 (by floor index of the sorted cosines of all pairs) and diversity, one row.

    Pairs are not stored: blocks give their moments and counts of coarse bins, then counts of values rounded to ``digits`` within
    the bins of the wanted places. Rounding keeps the order, so the rounded value at a place is the place's value, rounded.
    """
    coarse = 10 ** max(0, digits - 3)
    low = 10**digits // coarse + 1  # bins below 0; a value that is not a number has one above all
    key = lambda sim: np.where(np.isnan(sim), 2 * 10**digits, np.sign(sim) * np.floor(np.abs(sim) * 10**digits + 0.5)).astype(np.int64)

    def values(strips: Strips) -> Iterator[np.ndarray]:
        for ids, others, sim, own in strips:
            yield sim[ids[:, None] < others[None, :]] if own else sim.ravel()

    def batch(total: dict[int, int], **moments: float) -> pa.RecordBatch:
        filled = {name: np.array([x] + [0.0] * len(total)) for name, x in moments.items()}
        return pa.RecordBatch.from_pydict({"bin": pa.array([None, *total], pa.int64()), "n": pa.array([0, *total.values()], pa.int64()), **filled})

    def first(strips: Strips) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        mass, square, apart = 0.0, 0.0, 0.0
        for sim in values(strips):
            if len(sim):
                mean = sim.mean()
                mass, square, apart = mass + len(sim) * mean, square + len(sim) * mean * mean, apart + float(((sim - mean) ** 2).sum())
                counts = np.bincount(key(sim) // coarse + low)
                for k in np.flatnonzero(counts):
                    total[int(k) - low] = total.get(int(k) - low, 0) + int(counts[k])
        yield batch(total, mass=mass, square=square, apart=apart)

    def second(bins: list[int]):
        wanted = np.zeros(4 * low, bool)
        wanted[[b + low for b in bins]] = True

        def fold(strips: Strips) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for sim in values(strips):
                k = key(sim)
                for x, n in zip(*np.unique(k[wanted[k // coarse + low]], return_counts=True)):
                    total[int(x)] = total.get(int(x), 0) + int(n)
            yield batch(total)

        return fold

    schema = "bin long, n long"
    found = checkpointed(_blocks(rows, id_col, vector, None, first, f"{schema}, mass double, square double, apart double").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "mass", "square", "apart")]))
    facts = found.where("bin is null").select("mass", "square", "apart").first()
    counts = sorted(map(tuple, found.where("bin is not null").select("bin", "n").collect()))  # bins of -1 to 1, some thousands
    n = sum(c for _, c in counts)
    row = (0, *[None] * 6)
    if n:
        places = [int(n * p) for p in (0.5, 0.1, 0.9)]
        ends = np.cumsum([c for _, c in counts])
        holds = [int(np.searchsorted(ends, p, side="right")) for p in places]
        bins = sorted({counts[h][0] for h in holds})
        fine = sorted(map(tuple, _blocks(rows, id_col, vector, None, second(bins), schema).where("bin is not null").groupBy("bin").agg(F.sum("n")).collect()))
        at = []
        for place, h in zip(places, holds):
            inside = [(x, c) for x, c in fine if x // coarse == counts[h][0]]
            rest = place - int(ends[h] - counts[h][1])
            x = inside[int(np.searchsorted(np.cumsum([c for _, c in inside]), rest, side="right"))][0]
            at.append(float("nan") if x == 2 * 10**digits else x / 10**digits)
        mean = facts["mass"] / n
        spread = float(np.sqrt(max(0.0, (facts["apart"] + facts["square"] - n * mean * mean) / n)))
        row = (n, mean, spread, *at, 1 - mean)
    out = rows.sparkSession.createDataFrame([row], "n long, mean double, std double, median double, p10 double, p90 double, diversity double")
    return out.select("n", *[F.round(c, digits).alias(c) for c in out.columns[1:]])


def nearest(rows: DataFrame, cents: DataFrame, id_col: str, vector: str, cluster: str, least: float) -> DataFrame:
    """id, cluster (null below ``least``), sim: the nearest of few centroids; of equal ones the smallest."""
    small = cents.select(F.array_sort(F.collect_list(F.struct(cluster, "centroid"))).alias("all"))
    scored = F.transform("all", lambda c: F.struct((-F.round(cosine(F.col(vector), c["centroid"]), 9)).alias("down"), c[cluster].alias("c"), cosine(F.col(vector), c["centroid"]).alias("sim")))
    best = F.array_min(scored)
    out = rows.join(F.broadcast(small)).select(id_col, best.alias("b"))
    return out.select(id_col, F.when(F.col("b.sim") >= least, F.col("b.c")).alias(cluster), F.round("b.sim", 6).alias("sim"))


def outliers(rows: DataFrame, id_col: str, group: str, vector: str, spread: float = 1.5) -> DataFrame:
    """id, group, sim to the group's centroid, and whether it lies below the mean by ``spread`` deviations."""
    cents = centroids(rows, [group], vector)
    sims = rows.join(cents, group).select(id_col, group, cosine(F.col(vector), F.col("centroid")).alias("sim"))
    facts = sims.groupBy(group).agg(F.avg("sim").alias("m"), F.stddev_pop("sim").alias("sd"))
    return sims.join(facts, group).select(id_col, group, F.round("sim", 6).alias("sim"), (F.col("sim") < F.col("m") - spread * F.col("sd")).alias("outlier"))


def kmeans(rows: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """id, cluster: Lloyd's rounds from the first k vectors; ties to the smaller cluster; an empty cluster stays.

    Rounds go on until no centroid moves, or until moves no longer lessen the squared distances (then only rounding is left); each
    lessens them, so they end. A round brings k sums from each task. Vectors that are null, hold null or non-finite values or have
    another width than the first have no cluster.
    """
    first = rows.where(_finite(vector)).orderBy(id_col).select(vector).limit(k).collect()
    width = len(first[0][vector]) if first else 0
    cents = np.array([r[vector] for r in first if len(r[vector]) == width], float).reshape(-1, width)
    good = _finite(vector) & (F.size(vector) == width)
    points = checkpointed(rows.where(good).select(F.transform(vector, lambda x: x.cast("double")).alias("v")))

    def nearest_of(column: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
        dist = np.stack([((v - c) ** 2).sum(axis=1) for c in at], axis=1)
        return v, dist.argmin(axis=1), dist.min(axis=1)

    def sums(at: np.ndarray):
        def run(batches):
            n, total, dist = np.zeros(len(at), np.int64), np.zeros(at.shape), np.zeros(len(at))
            for batch in batches:
                v, own, d = nearest_of(batch.column(0), at)
                n += np.bincount(own, minlength=len(at))
                dist += np.bincount(own, d, minlength=len(at))
                for c in range(len(at)):
                    total[c] += v[own == c].sum(axis=0)
            yield pa.RecordBatch.from_pydict({"c": pa.array(range(len(at)), pa.int32()), "n": n, "total": pa.array(total.tolist(), pa.list_(pa.float64())), "dist": dist})

        return run

    least = np.inf
    while len(cents):
        n, total, dist = np.zeros(len(cents), np.int64), np.zeros(cents.shape), 0.0
        for r in points.mapInArrow(sums(cents), "c int, n long, total array<double>, dist double").collect():  # k rows of each task
            n[r["c"]] += r["n"]
            total[r["c"]] += r["total"]
            dist += r["dist"]
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], cents)
        if np.allclose(moved, cents, rtol=0, atol=1e-9) or dist >= least:
            break
        cents, least = moved, dist

    def label(batches):
        for batch in batches:
            fits = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            own = np.zeros(len(fits), np.int32)
            if fits.any():
                own[fits] = nearest_of(batch.column(1).drop_null(), cents)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, mask=~fits)], ["id", "cluster"])

    kept = rows.select(F.col(id_col).alias("id"), F.when(good, F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    return kept.mapInArrow(label, f"id {rows.schema[id_col].dataType.simpleString()}, cluster int").withColumnRenamed("id", id_col)


def _finite(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def farthest_points(rows: DataFrame, group: list[str], id_col: str, vector: str, most: int = 40) -> DataFrame:
    """group, id, pick: samples per group, the one nearest the centroid first, then whichever is farthest from those taken.

    Sequential by nature, so it runs per group; a group must fit a task.
    """

    def pick(pdf):
        pdf = pdf.sort_values(id_col)
        v = np.array(pdf[vector].tolist(), float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        n = len(v) if len(v) <= 10 else min(most, int(np.ceil(5 + 3 * np.log2(len(v)))))
        order = [int(np.argmax(v @ v.mean(axis=0)))]
        near = v @ v[order[0]]
        while len(order) < n:
            near[order] = np.inf
            order.append(int(np.argmin(near)))
            near = np.maximum(near, v @ v[order[-1]])
        out = pdf.iloc[order][[*group, id_col]].copy()
        out["pick"] = range(1, len(order) + 1)
        return out

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*group, id_col])
    return rows.select(*group, id_col, vector).groupBy(*group).applyInPandas(pick, f"{kinds}, pick int")


def leaders(rows: DataFrame, group: list[str], id_col: str, vector: str, least: float = 0.85) -> DataFrame:
    """group, id, leader: in order of id, each vector joins the first leader it resembles, or becomes one."""

    def assign(pdf):
        pdf = pdf.sort_values(id_col)
        v = np.array(pdf[vector].tolist(), float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        heads: list[int] = []
        own = []
        for i in range(len(v)):
            sims = v[heads] @ v[i] if heads else np.array([])
            hit = np.flatnonzero(sims >= least)
            if len(hit):
                own.append(heads[int(hit[0])])
            else:
                heads.append(i)
                own.append(i)
        ids = pdf[id_col].to_numpy()
        return pdf[[*group, id_col]].assign(leader=ids[own])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*group, id_col])
    return rows.select(*group, id_col, vector).groupBy(*group).applyInPandas(assign, f"{kinds}, leader {rows.schema[id_col].dataType.simpleString()}")
