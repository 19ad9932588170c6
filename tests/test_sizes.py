"""What larger tables and ties showed: places of rows, rounds without a bound, pairs in blocks, copies as classes."""

import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.operators import consolidation, dedupe, integrity, positions, similarity
from loomspark.plans import registry


def against_sql(spark, folder, name):
    """Rows of a query and of its SQL, on one thread so that the first row of equals is the first of the file."""
    con = duckdb.connect(config={"threads": 1})
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want = con.execute(registry.ORACLES[name]).df()
    return sorted(map(tuple, registry.QUERIES[name](spark, str(folder)).toPandas()[want.columns].astype(object).values.tolist())), sorted(map(tuple, want.astype(object).values.tolist()))


@pytest.mark.parametrize("files", [1, 3])
def test_tracked_members_with_ties(spark, tmp_path, files):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"l_orderkey": rng.integers(0, 4, 900), "l_partkey": rng.integers(0, 50, 900), "l_suppkey": rng.integers(0, 40, 900), "l_linenumber": rng.integers(1, 3, 900)}).astype("Int64")
    rows.loc[rows.index % 17 == 3, "l_orderkey"] = None
    rows.loc[rows.index % 5 == 3, "l_partkey"] = None
    (tmp_path / "lineitem.parquet").mkdir()
    for k, part in enumerate(np.array_split(np.arange(900), files)):
        rows.iloc[part].to_parquet(tmp_path / "lineitem.parquet" / f"part-{k}.parquet", index=False)
    mine, want = against_sql(spark, tmp_path, "tracked_members")
    assert mine == want and len(want) == 40


def test_kmeans_goes_on_until_nothing_moves(spark):
    n = 4000
    v = np.sort(np.random.default_rng(2).exponential(size=n)) ** 3
    rows = [(i, [float(x)]) for i, x in enumerate(v)] + [(n, None), (n + 1, [1.0, 2.0]), (n + 2, [float("nan")]), (n + 3, [None])]
    got = {r["id"]: r["cluster"] for r in similarity.kmeans(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 6).collect()}
    cents, rounds, own = v[:6].copy(), 0, None
    while own is None or (own != (now := ((v[:, None] - cents) ** 2).argmin(axis=1))).any():
        own = ((v[:, None] - cents) ** 2).argmin(axis=1)
        cents, rounds = np.array([v[own == c].mean() if (own == c).any() else cents[c] for c in range(6)]), rounds + 1
    assert rounds > 50 and got == dict(enumerate(own)) | dict.fromkeys(range(n, n + 4))


@pytest.mark.parametrize("size, strip", [(4096, 256), (40, 7)])
def test_distribution_without_stored_pairs(spark, monkeypatch, size, strip):
    monkeypatch.setattr(similarity, "PAIR_BLOCK", size)
    monkeypatch.setattr(similarity, "PAIR_STRIP", strip)
    monkeypatch.setattr(similarity, "all_pairs", None)
    v = np.random.default_rng(9).normal(size=(150, 5))
    v[100:] = v[0]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.sort((unit @ unit.T)[np.triu_indices(150, 1)])
    want = [len(sims), sims.mean(), sims.std(), *[sims[int(len(sims) * p)] for p in (0.5, 0.1, 0.9)], 1 - sims.mean()]
    d = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)] + [(900, None)], "id long, v array<double>")
    assert np.allclose(list(similarity.distribution(d, "id", "v").first()), want, atol=1.1e-6)
    assert list(similarity.distribution(d.where("id = 1"), "id", "v").first()) == [0, *[None] * 6]


def test_copies_of_a_text_are_one_class(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(consolidation, "by_component", lambda pairs, *a, f=consolidation.by_component: (sizes.append(pairs.count()), f(pairs, *a))[1])
    texts = ["alpha beta gamma", "alpha gamma beta", "alpha beta", "other words here", "opposed thing"]
    rows = [(i, texts[i % 5], "pro_change" if i % 5 == 4 and i % 2 else "pro_status_quo") for i in range(400)] + [(400, "lonely text", None)]
    got = {r["key"]: r["group"] for r in consolidation.text_groups(spark.createDataFrame(rows, "id long, text string, s string"), "id", "text", "s").collect()}
    assert got == {i: {0: 2, 1: 2, 2: 2, 3: 3, 4: 4 if i % 2 == 0 else 9}[i % 5] for i in range(400)} and sizes == [1]


def embeddings(folder, n=60, zero=()):
    v = np.random.default_rng(3).normal(size=(n, 4)).astype("float32")
    v[list(zero)] = 0
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(v), "label": (np.arange(n) % 3).astype("int32")}).to_parquet(folder / "embeddings.parquet", index=False)


@pytest.mark.parametrize("size", [4096, 7])
def test_merge_candidates_in_blocks(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(similarity, "PAIR_BLOCK", size)
    monkeypatch.setattr(positions, "_sides", None, raising=False)
    embeddings(tmp_path, zero=[5])
    mine, want = against_sql(spark, tmp_path, "merge_candidates")
    assert [x[:2] for x in mine] == [x[:2] for x in want] and np.allclose([x[2] for x in mine], [x[2] for x in want], atol=1.1e-6, equal_nan=True) and len(want) > 60


@pytest.mark.parametrize("planes, least", [(3, 0.6), (6, 0.9)])
def test_sign_hashing_stores_no_candidates(spark, monkeypatch, planes, least):
    asked = []
    monkeypatch.setattr(similarity, "all_pairs", lambda *a, f=similarity.all_pairs: (asked.append(a[3:]), f(*a))[1])
    v = np.random.default_rng(2).normal(size=(120, 8))
    v[60:] = v[:60] + np.random.default_rng(3).normal(size=(60, 8)) * 0.3
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if unit[i] @ unit[j] >= least}
    got = [(r["i"], r["j"]) for r in similarity.lsh_pairs(spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>"), "id", "v", least, planes).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= (0.9 if planes == 6 else 1) * len(want) > 20
    assert asked == [(least, "bucket") if planes == 6 else (least,)]


@pytest.mark.parametrize("size", [4096, 7])
def test_shared_substance_in_blocks(spark, tmp_path, monkeypatch, size):
    asked = []
    monkeypatch.setattr(similarity, "PAIR_BLOCK", size)
    monkeypatch.setattr(integrity, "all_pairs", lambda *a, f=similarity.all_pairs: (asked.append(a[4]), f(*a))[1], raising=False)
    embeddings(tmp_path, n=90, zero=[5])
    mine, want = against_sql(spark, tmp_path, "shared_substance")
    assert [x[:3] for x in mine] == [x[:3] for x in want] and np.allclose([x[3] for x in mine], [x[3] for x in want], atol=1.1e-6) and len(want) > 60
    assert asked == ["ref"]


def test_redundant_compares_titles_once(spark, monkeypatch):
    met = []
    monkeypatch.setattr(positions, "checkpointed", lambda d, f=positions.checkpointed: (met.append(d.count()), f(d))[1])
    titles = ["a b c", "C b a", "a b c d", "x y", "", None]
    rows = [(i, "t" if i % 11 else None, titles[i % 6], [i % 4, 9, i % 3]) for i in range(120)]
    words = {i: set((t or "").lower().split()) for i, _, t, _ in rows}
    want = set()
    for i, a, _, m in rows:
        for j, b, _, n in rows:
            if i < j and a and b and words[i] | words[j]:
                sim, over = len(words[i] & words[j]) / len(words[i] | words[j]), len({*m} & {*n}) / min(len({*m}), len({*n}))
                want |= {(i, j)} if sim >= 0.85 or sim >= 0.6 and over >= 0.5 else set()
    got = [(r["id_1"], r["id_2"]) for r in positions.redundant(spark.createDataFrame(rows, "id long, theme string, title string, m array<int>"), "id", "theme", "title", "m").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000 and met[0] <= 10


def test_large_groups_of_near_copies_store_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstvåø"), 6))
    texts = []
    for size, copies in ((60, 150), (200, 90), (90, 5), (40, 1), (40, 1)):
        base = [word() for _ in range(size)]
        for _ in range(copies):  # from alike to too different, so that many are linked through others only
            own = base[: size - int(rng.integers(0, size // 6 + 1))]
            for _ in range(int(rng.integers(0, 1 + size // 50))):
                own[int(rng.integers(0, len(own)))] = word()
            texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), texts[3].replace(" ", " ,of- "), f"{texts[7]} {texts[7]}", None, "short", "ab cd " * 40, "four words are here " + "x " * 90]
    rows = [*enumerate(texts), (None, texts[0]), (5, texts[160]), (900, texts[160])]
    grams = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9_æøå]{3,}", (t or "").lower())
        if i is not None and len(t or "") >= 100:
            grams.setdefault(frozenset(zip(w, w[1:], w[2:], w[3:])), set()).add(i)
    grams.pop(frozenset(), None)
    root = {i: i for i, _ in rows}

    def top(i):
        return i if root[i] == i else top(root[i])

    sets, met = list(grams), []
    for k, x in enumerate(sets):
        for y in sets[: k + 1]:
            if x is y or len(x & y) / len(x | y) >= 0.8:
                for i in grams[x] | grams[y]:
                    a, b = sorted((top(i), top(min(grams[x]))))
                    root[b] = a
    groups = {}
    for i in {i for ids in grams.values() for i in ids}:
        groups.setdefault(top(i), set()).add(i)
    want = {(i, g, len(m)) for g, m in groups.items() if len(m) > 1 for i in m}
    monkeypatch.setattr(dedupe, "checkpointed", lambda d, f=dedupe.checkpointed: (met.append((d.count(), d.schema.simpleString())), f(d))[1])
    d = spark.createDataFrame(rows, "id long, text string").repartition(3)
    assert {tuple(r) for r in dedupe.copy_groups(d, "id", "text").collect()} == want and max(n for *_, n in want) > 200
    assert max(n for n, _ in met) < 20 * len(rows) and not any("array" in kind for _, kind in met)


@pytest.mark.parametrize("n", range(1, 400, 7))
def test_prefixes_are_never_too_short(n):
    for least in (0.5, 0.6, 0.7, 0.8, 0.9):
        (part,) = dedupe._prefixes(np.zeros(dedupe.CELLS, np.uint32), 1, least)(iter([pa.RecordBatch.from_pydict({"lower": [" ".join(f"word{i}" for i in range(n + 3))]})]))
        assert len(np.frombuffer(part["packed"][0].as_py(), dedupe.POSTING)) == n - -(-n * round(10 * least) // 10) + 1


def test_no_texts_no_groups(spark):
    d = spark.createDataFrame([(1, None), (2, "short")], "id string, text string")
    assert dedupe.copy_groups(d, "id", "text").collect() == []
    long = "These are some words in a text that is long enough to count as an answer, written by one who was asked."
    both = d.union(spark.createDataFrame([("b", long), ("a", long + "!")], d.schema))
    assert {tuple(r) for r in dedupe.copy_groups(both, "id", "text").collect()} == {("a", "a", 2), ("b", "a", 2)}


@pytest.mark.parametrize("block, strip, share", [(2048, 2**18, 1 / 16), (7, 50, 0.3), (5, 20, 2.0)])
def test_redundant_in_blocks(spark, monkeypatch, block, strip, share):
    monkeypatch.setattr(positions, "BLOCK", block, raising=False)
    monkeypatch.setattr(positions, "STRIP", strip, raising=False)
    monkeypatch.setattr(positions, "COMMON_MEMBER", share, raising=False)
    monkeypatch.setattr(positions.T, "overlap", None)  # no pair is looked at on its own
    rng = np.random.default_rng(5)
    titles = ["a b c", "C b a", "a b c d", "a b c e", "x y", "x", None]
    rows = [(int(i), f"t{i % 2}", titles[rng.integers(7)], [[], None][i % 2] if i % 20 > 17 else [int(x) for x in [7, *rng.integers(0, 12, rng.integers(0, 6))]]) for i in rng.integers(0, 110, 130)]
    words, want = [frozenset((t or "").lower().split()) for _, _, t, _ in rows], []
    for (i, a, t, m), v in zip(rows, words):
        for (j, b, u, n), w in zip(rows, words):
            if i < j and a == b and t and u:
                sim, least = len(v & w) / len(v | w), min(len({*x}) for x in (m, n) if x is not None) if m is not None or n is not None else None
                over = 0.0 if least == 0 else None if m is None or n is None else len({*m} & {*n}) / least
                if sim >= 0.85 or sim >= 0.6 and over is not None and over >= 0.5:
                    want.append((i, j, float(np.floor(sim * 1e6 + 0.5) / 1e6), over if over is None else float(np.floor(over * 1e6 + 0.5) / 1e6)))
    got = positions.redundant(spark.createDataFrame(rows, "id long, theme string, title string, m array<int>"), "id", "theme", "title", "m", digits=6)
    order = lambda x: sorted(map(repr, x))
    assert order(map(tuple, got.collect())) == order(want) and {x[2] for x in want} == {0.6, 0.75, 1.0} and None in {x[3] for x in want}


def test_redundant_pairs_over_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK", 30, raising=False)
    monkeypatch.setattr(positions.T, "overlap", None)
    rng = np.random.default_rng(6)
    pd.DataFrame({"p_partkey": np.arange(240), "p_brand": [f"Brand#{k}" for k in np.arange(240) % 2], "p_type": rng.choice(["SMALL", "LARGE TIN", "tin large", "PROMO"], 240)}).to_parquet(tmp_path / "part.parquet", index=False)
    pd.DataFrame({"l_partkey": rng.integers(0, 235, 3000), "l_suppkey": rng.integers(0, 90, 3000)}).to_parquet(tmp_path / "lineitem.parquet", index=False)
    mine, want = against_sql(spark, tmp_path, "redundant_pairs")
    assert mine == want and len(want) > 4000
