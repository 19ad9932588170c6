"""Pairs in blocks, recall of sign hashing, tracking of members, edits that must not lose members, pages that must not vanish."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import editlog, graph, similarity
from loomspark.sources import jsonapi


def vectors(spark, n=300):
    v = np.random.default_rng(2).normal(size=(n, 12))
    v[n // 2 :] = v[: n - n // 2] + np.random.default_rng(3).normal(size=(n - n // 2, 12)) * 0.6
    d = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return d, {(i, j): s for i in range(n) for j in range(i + 1, n) if (s := float(unit[i] @ unit[j])) >= 0.6}


def test_all_pairs_in_blocks(spark, monkeypatch):
    d, want = vectors(spark)
    odd = spark.createDataFrame([(900, None), (901, [1.0, None]), (902, [1.0, 2.0]), (903, [2.0, 4.0]), (None, [1.0, 2.0])], "id long, v array<double>")
    for size in (1024, 40):
        monkeypatch.setattr(similarity, "PAIR_BLOCK", size)
        got = {(r["i"], r["j"]): r["sim"] for r in similarity.all_pairs(d.unionByName(odd), "id", "v", 0.6).collect()}
        assert got.keys() == want.keys() | {(902, 903)} and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert similarity.all_pairs(d.limit(0), "id", "v", 0.6).collect() == []


def test_sign_hashing_finds_nearly_all(spark):
    d, want = vectors(spark)
    got = {(r["i"], r["j"]) for r in similarity.lsh_pairs(d, "id", "v", 0.6).collect()}
    assert got <= want.keys() and len(got) >= 0.9 * len(want)


def test_rounds_that_do_not_end_are_an_error(spark):
    chain = spark.range(200)
    with pytest.raises(RuntimeError, match="still change"):
        graph.components(chain, chain.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("b < 200"), most_rounds=2)


STATE = {("t", "a"): [1, 2], ("t", "b"): [3]}
REFUSED = [
    ("CREATE_POSITION", {"theme": "t", "title": "a", "responses": [9]}), ("MOVE_CITATION", {"response": 1, "source": ["t", "a"], "target": ["t", "zz"]}),
    ("UPDATE_POSITION", {"key": ["t", "a"], "theme": "t", "title": "b"}), ("CREATE_THEME", {"theme": "t"}), ("DELETE_THEME", {"theme": "t"}), ("DELETE_THEME", {"theme": "zz"}),
]


@pytest.mark.parametrize("kind, data", REFUSED)
def test_edits_that_would_lose_members_are_refused(kind, data):
    with pytest.raises(ValueError):
        editlog.applied(STATE, kind, data)


def test_themes_come_and_go():
    made, back = editlog.applied(STATE, "CREATE_THEME", {"theme": "u"})
    assert ("u", editlog.EMPTY) in made and editlog.applied(made, *back)[0] == STATE
    gone, _ = editlog.applied(made, "DELETE_THEME", {"theme": "u"})
    assert gone == STATE
    filled, _ = editlog.applied(made, "CREATE_POSITION", {"theme": "u", "title": "x", "responses": [3]})
    assert filled == {("t", "a"): [1, 2], ("t", "b"): [], ("u", "x"): [3]}


def test_pages_fail_rather_than_vanish(tmp_path):
    for i in range(1, 4):
        (tmp_path / f"{i}.json").write_text('{"data": [1]}')
    pages = lambda n: jsonapi.Pages({"url": f"file://{tmp_path}/{{page}}.json", "pages": str(n)})
    read = lambda p: [row for part in p.partitions() for row in p.read(part)]
    assert [n for n, _ in read(pages(5))] == [1, 2, 3] == [n for n, _ in read(pages(3))]
    with pytest.raises(ValueError, match="more than 2 pages"):
        read(pages(2))
    with pytest.raises(OSError):
        list(jsonapi.Pages({"url": "http://127.0.0.1:9/{page}", "pages": "1"}).read(pages(1).partitions()[0]))
