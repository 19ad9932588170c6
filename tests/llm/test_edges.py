"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for all ten operators."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bpe, exact_dedup, langid, licenses, minhash, mixing, pii, resharding, secrets, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string, h string, norm string, kept boolean, row string, band string, words string"


def frame(spark, rows):
    """Documents with extra columns that have the names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, 1, 2, "k", "h", "n", True, "r", "b", "w") for i, t, lang, s in rows], DOCS)


LONG = "the quick brown fox jumps over the lazy dog " * 3000
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "hello world of words", "en", None), (4, "hello world of words", "en", None),
    (None, "no id here but words", "en", "b"), (5, LONG, "en", "b"), (6, "HELLO world of words", None, "a"), (7, "bonjour tout le monde", "fr", "c"), (8, "12345 !!", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).cache()


OPERATORS = {
    "langid": lambda d: langid.predict(d, langid.fit(langid.training(d))), "bpe": lambda d: bpe.round_trips(d, *bpe.vocabulary()), "licenses": licenses.scan, "pii": lambda d: pii.replaced(d, "k"),
    "reshard": resharding.assignment, "exact": exact_dedup.exact_groups, "secrets": secrets.scan, "mix": mixing.mix, "near": minhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_row_for_each_row(docs, none, name):
    found = OPERATORS[name](docs).collect()
    assert name == "licenses" or sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, *_ in ROWS)
    assert OPERATORS[name](none).collect() == []


FILTERS = {"language": langid.drop_rejected, "exact": exact_dedup.drop_copies, "near": minhash.drop_near_duplicates, "mix": mixing.mixed_documents}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(docs, none, name):
    found = FILTERS[name](docs)
    assert found.columns == docs.columns
    texts = [r["text"] for r in found.collect()]
    if name == "language":
        assert None not in texts and "" not in texts and "12345 !!" not in texts and "hello world of words" in texts
    if name == "exact":
        assert len(texts) == 7 and texts.count("hello world of words") == 1
    if name == "near":
        assert texts.count("hello world of words") == 1 and LONG in texts
    assert FILTERS[name](none).collect() == []


def test_exact_groups_by_brute_force(docs):
    clear = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for r in exact_dedup.exact_groups(docs).collect():
        own = [(i, t or "") for i, t, *_ in ROWS if hashlib.sha256(clear(t).encode()).hexdigest() == r["text_sha256"]]
        keep = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        assert (r["group_size"], r["keep_id"], r["kept"]) == (len(own), keep, r["doc_id"] == keep)


def test_exact_groups_with_one_hash_for_all(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    d = frame(spark, [(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "a ", "en", "s")])
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(d).collect()}
    kept = sorted(r["doc_id"] for r in exact_dedup.drop_copies(d).collect())
    assert found == {1: (3, 2), 2: (2, 1), 3: (3, 2)} and kept == [2, 3]


def test_topk_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [2.0, -1.0]), (2, [2.0, -1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (7, [1.0]), (40, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("block", F.lit(1))
    got = topk.top_k(d, F.col("vec_id") % 20 == 0, 3).collect()
    vec = {i: [np.floor(64.0 * x) for x in v] + [0] * (2 - len(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (0, 20, 40):
        best = sorted((-int(np.dot(vec[q], vec[c])), c) for c in vec if c != q)[:3]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == want
    assert topk.top_k(d.limit(0), F.col("vec_id") % 20 == 0, 3).collect() == []


def test_topk_prunes_without_loss():
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(40, 8)), rng.normal(size=(300, 8)) * rng.uniform(0.2, 3, size=(300, 1))
    ql, cl = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    for steep in (-2.0, 2.0):  # coordinates always, length always
        for share in (0.2, 0.6, 0.9):
            theta = share * ql * cl.max()
            a, b = topk.survivors(q, ql, theta, c, cl, steep)
            assert set(zip(*np.nonzero(q @ c.T >= theta[:, None]))) <= set(zip(a, b))


def test_mix_targets_and_bounds(spark):
    rows = [(i, " ".join(["w"] * (50 + i % 40)), "en", "big" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(600)]
    found = mixing.mix(frame(spark, rows)).toPandas()
    assert (found["taken"] <= 2 * found["size"]).all() and found["size"].sum() == sum(50 + i % 40 for i in range(600))
    by = found.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 1.5 * mixing.BLOCK_WORDS).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6 and (by["target"] <= 2 * by["size"] + 1e-9).all()
    again = mixing.mix(frame(spark, rows).repartition(7)).toPandas()
    assert sorted(again["taken"]) == sorted(found["taken"])


def test_mix_materials_agree(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30 + i)), "en", f"s{i % 3}") for i in range(40)]
    d = frame(spark, rows)
    taken = mixing.mix(d).agg(F.sum("taken")).first()[0]
    words = lambda f: f.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words(mixing.mixed_documents(d)) == taken == words(mixing.mixed_blocks(d))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 1000])
def test_permutation(spark, n):
    p = mixing.with_permuted(spark.range(n), F.col("id"), F.lit(n).cast("long"), [F.lit("key")], "p").toPandas()["p"]
    assert sorted(p) == list(range(n))


def test_reshard_is_even_and_gapless(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    found = resharding.assignment(d, 10, 7).toPandas()
    by = found.groupby("shard").agg(bytes=("size", "sum"), n=("slot", "count"), last=("slot", "max"), different=("slot", "nunique"))
    assert len(by) == 10 and (by["n"] == by["last"] + 1).all() and (by["n"] == by["different"]).all()
    assert by["bytes"].max() - by["bytes"].min() < 0.02 * by["bytes"].mean()


def test_cheapest_flow_moves_the_least():
    rng = np.random.default_rng(1)
    for _ in range(30):
        supply = [int(x) for x in rng.integers(0, 60, rng.integers(1, 6))]
        capacity = resharding.even_capacities(sum(supply) + int(rng.integers(0, 4)), int(rng.integers(1, 7)))
        flow = resharding.cheapest_flow(supply, capacity)
        least = sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in enumerate(supply))
        assert sum(x for i, j, x in flow if i != j) == least


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), F.lit(20)).alias("text"), F.when(F.col("id") < 200, 0).when(F.col("id") < 300, 1).otherwise(2).alias("shard"))
    d.write.partitionBy("shard").parquet(str(tmp_path / "old"))
    total = 400 * 36
    touched = resharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), [total // 4, total // 4, total // 4, total // 4])
    new = spark.read.parquet(str(tmp_path / "new"))
    kept = spark.read.parquet(str(tmp_path / "old")).where(~F.col("shard").isin(touched))
    assert new.count() + kept.count() == 400 and touched == [0, 3]
    assert {r["shard"]: r["count"] for r in new.groupBy("shard").count().collect()} == {0: 100, 3: 100}


def test_near_keeps_different_texts_of_null_or_equal_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcdefg"]
    ids = [None, None, None, 5, 5, 5, 8]
    rows = [(i, t, "en", "s") for i, t in zip(ids, texts)] + [(None, texts[1], "en", "s"), (9, texts[2], "en", "s"), (None, texts[6], "en", "s")]
    found = minhash.drop_near_duplicates(frame(spark, rows)).select("doc_id", "text").collect()
    want = [(None, 0), (None, 1), (9, 2), (5, 3), (5, 4), (5, 5), (8, 6)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in found) == sorted((str(i), texts[n]) for i, n in want)


def test_mixed_documents_have_the_words_of_the_drawn_blocks(spark):
    """Every word is unique, so that the words of a source must be those of its blocks, each as often as it is drawn."""
    rng = np.random.default_rng(2)
    space = [" ", "\n", "  ", "\t"]
    rows = [(i, " " + "".join(f"d{i}w{k}" + space[k % 4] for k in range(int(n))), "en", f"s{i % 3}") for i, n in enumerate(rng.integers(1, 700, 40))]
    rows += [(None, "".join(f"n{k} " for k in range(300)), "en", None), (None, "".join(f"m{k} " for k in range(300)), "en", None)]
    rows += [(7, "".join(f"r{k} " for k in range(400)), "en", s) for s in ("s0", "s0", "s1")]
    d = frame(spark, rows)
    count = lambda texts: Counter((s, w) for s, t in texts for w in t.split())
    got = [(r["source"], r["text"]) for r in mixing.mixed_documents(d).collect()]
    want = count((r["source"], r["text"]) for r in mixing.mixed_blocks(d).collect())
    assert count(got) == want and len({t.split()[0] for _, t in got} - {t.split()[0] for _, t, *_ in rows}) > 3
    # Texts keep their order, and the space between words that stood together.
    source = {w: t for _, t, *_ in rows for w in t.split()}
    for _, t in got:
        own = source[t.split()[0]]
        places = [own.split().index(w) for w in t.split()]
        assert places == sorted(set(places)) and (t == own or t == t.strip())
        kept = re.findall(r"\S+\s*", t)
        assert all(own.split()[n] + own.split(own.split()[n], 1)[1][: len(x) - len(x.rstrip())] == x for n, x in zip(places, kept))
