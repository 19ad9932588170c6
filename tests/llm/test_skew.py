"""Hot keys, blocks and repeats: the same results however rows are dealt."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import exact_dedup, langid, minhash, resharding, secrets, topk
from loomspark.llm.common import spread_join


def test_spread_join_equals_a_plain_one(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("r"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), F.col("id").alias("__x"))
    once = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for least in (1, 60, 10**9):
        monkeypatch.setattr("loomspark.llm.common.HOT_ROWS", least)
        for how in ("inner", "left"):
            got, want = spread_join(rows, once, "k", ["r"], how=how), rows.join(once, "k", how)
            assert got.columns == ["k", "r", "__x", "v"]
            assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_hot_texts_of_copies_and_secrets(spark, monkeypatch):
    hot = "user = bob AbCdEf0123456789AbCdEf0123"
    rows = [(i, hot if i % 3 == 0 else f"login: me{i} AbCdEf0123456789AbCdEf0{i % 7}23") for i in range(120)] + [(None, hot), (0, hot)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    copies = Counter(map(tuple, exact_dedup.exact_groups(d).collect()))
    spans = Counter(map(str, secrets.scan(d).collect()))
    monkeypatch.setattr("loomspark.llm.common.HOT_ROWS", 5)
    assert Counter(map(tuple, exact_dedup.exact_groups(d).collect())) == copies and Counter(map(str, secrets.scan(d).collect())) == spans
    kept = exact_dedup.drop_copies(d).collect()
    assert sorted(r["text"] for r in kept) == sorted({t for _, t in rows})


def test_near_classes_by_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [list(rng.integers(0, 5000, 60).astype(str)) for _ in range(4)]
    rows = []
    for i in range(160):  # chains: each text is near the one before it, not to the first
        b = base[i % 4]
        b[(i // 4) % 60] = f"n{i}"
        rows.append((i, " ".join(b)))
    rows += [(1000 + i, " ".join(rng.integers(0, 9000, 40).astype(str))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in sets}
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(d).collect()} == want
    for name, value in (("OPEN_BLOCK", 3), ("MEMBER_BLOCK", 4), ("BLOCK_BYTES", 900)):
        monkeypatch.setattr(minhash, name, value)
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(d).collect()} == want


def test_similarity_below_one_half():
    weigh = lambda **w: (np.arange(len(w), dtype=np.uint64), np.array(list(w.values())))
    a, b = (np.array([1, 2, 3], np.uint64), np.array([1, 1, 8])), (np.array([3, 4, 5], np.uint64), np.array([1, 5, 4]))
    p, q = {1: 0.1, 2: 0.1, 3: 0.8}, {3: 0.1, 4: 0.5, 5: 0.4}
    want = 1 / sum(max(p.get(j, 0) / p[3], q.get(j, 0) / q[3]) for j in range(1, 6))
    assert abs(minhash.similarity(a, b) - want) < 1e-12 and minhash.similarity(a, b, 0.5) == 0.0


def test_topk_sends_only_what_may_win(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 6)) * rng.uniform(0.05, 4, size=(900, 1)) ** 2
    d = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    for name, value in (("QUERY_BLOCK", 7), ("CHUNK", 50), ("BUCKET", 16), ("BANDS", 8)):
        monkeypatch.setattr(topk, name, value)
    got = [tuple(r) for r in topk.top_k(d, F.col("vec_id") % 20 == 0, 5).collect()]
    whole = np.floor(64 * v.astype(np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 900, 20):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(900) if c != q)[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(got) == want


def test_rewrite_sends_equal_rows_where_the_plan_says(spark, tmp_path):
    rows = [(1, "same text of some length", 0)] * 60 + [(i, "x" * (i % 30), i % 2) for i in range(100)] + [(None, None, 1), (None, "", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(str(tmp_path / "old"))
    total = sum(len(t or "") + resharding.OVERHEAD for _, t, _ in rows)
    capacities = resharding.even_capacities(total, 4)
    written = resharding.rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), capacities)
    new = spark.read.parquet(str(tmp_path / "new")).collect()
    assert written == [0, 1, 2, 3] and Counter((r["doc_id"], r["text"]) for r in new) == Counter((i, t) for i, t, _ in rows)
    sizes = Counter()
    for r in new:
        sizes[r["shard"]] += len(r["text"] or "") + resharding.OVERHEAD
    assert all(abs(sizes[j] - c) < 100 for j, c in enumerate(capacities))


def test_learning_sees_each_text_once_and_no_id(spark):
    rows = [(i, "das ist ein hund und eine katze im garten", "de") for i in range(500)] + [(600 + i, f"the dog {i} and the cat in the garden", "en") for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.training(d).columns == ["text", "lang"]
    model = langid.fit(langid.training(d))
    shifted = langid.fit(langid.training(d.withColumn("doc_id", F.col("doc_id") + 0)))
    assert model.predict(["der hund und die katze", "the cat and the dog"])[0] == ["de", "en"] and np.allclose(model.centers, shifted.centers)
