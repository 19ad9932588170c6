"""The relational layer and the log: properties that the SQL comparison does not show."""

from pyspark.sql import functions as F

from loomspark.operators import editlog, graph, relational
from loomspark.sources.tables import Steps, content_key, overwrite_partitions


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    patch = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    once = relational.upsert(base, patch, ["id"])
    twice = relational.upsert(once, patch, ["id"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "B"), (3, "C")]


def test_patch_tells_absent_from_null(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, p string, q string")
    patch = spark.createDataFrame([(1, None, True, "z", False)], "id long, p string, has_p boolean, q string, has_q boolean")
    assert sorted(relational.patch_columns(base, patch, ["id"], ["p", "q"]).collect()) == [(1, None, "x"), (2, "b", "y")]


def test_undo_then_redo_is_identity(spark):
    log = spark.range(5).select(F.lit(1).alias("draft"), F.col("id").alias("sequence"), F.lit(None).cast("timestamp").alias("undone_at"))
    back = relational.redo(relational.undo(log, "draft", F.current_timestamp()), "draft")
    assert sorted(back.collect()) == sorted(log.collect())


def test_partition_overwrite_keeps_others(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).select("id", (F.col("id") % 2).alias("p")).write.partitionBy("p").parquet(path)
    overwrite_partitions(spark.createDataFrame([(9, 1)], "id long, p long"), path, ["p"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 2, 9]


def test_steps_are_found_copied_and_skipped(spark, tmp_path):
    store = Steps(spark, str(tmp_path))
    store.save(spark.range(3), "168", "load")
    assert store.load("168", "load", "other").count() == 3 and store.load("168", "none") is None
    assert store.copy("168", "default", "other", ["load", "none"]) == {"copied": ["load"], "skipped": [], "failed": ["none"]}
    assert store.copy("168", "default", "other", ["load"])["skipped"] == ["load"] and store.available("168", "other") == ["load"]


def test_keys_see_nested_content():
    assert content_key(a={"b": [1, 2]}) != content_key(a={"b": [1, 3]}) and content_key(a=1, b=2) == content_key(b=2, a=1)


def test_merge_chains(spark):
    merges = spark.createDataFrame([("C", "B"), ("B", "A"), ("x", "y"), ("y", "x")], "source string, target string")
    assert dict(graph.merge_targets(merges).collect()) == {"C": "A", "B": "A", "x": None, "y": None}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60)
    edges = spark.range(49).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = dict(graph.components(nodes, edges).collect())
    assert {found[i] for i in range(50)} == {0} and all(found[i] == i for i in range(50, 60))


STATE = {("t", "a"): [1, 2], ("t", "b"): [3]}
OPERATIONS = [
    ("MOVE_CITATION", {"response": 2, "source": ["t", "a"], "target": ["t", "b"]}), ("CREATE_POSITION", {"theme": "t", "title": "c", "responses": [3]}),
    ("MERGE_POSITIONS", {"keys": [["t", "a"], ["t", "b"]], "theme": "t", "title": "m"}), ("SPLIT_POSITION", {"key": ["t", "a"], "splits": [["x", [1]], ["y", [2]]]}),
    ("DELETE_POSITION", {"key": ["t", "b"]}), ("UPDATE_POSITION", {"key": ["t", "b"], "theme": "u", "title": "b"}), ("MARK_NO_OPINION", {"responses": [1]}),
]


def test_inverse_takes_each_operation_back():
    for kind, data in OPERATIONS:
        after, (k, d) = editlog.applied(STATE, kind, data)
        assert after != STATE and editlog.applied(after, k, d)[0] == STATE


def test_a_failing_batch_leaves_nothing():
    bad = [OPERATIONS[0], ("MOVE_CITATION", {"response": 77, "source": ["t", "a"], "target": ["t", "b"]})]
    try:
        editlog.all_applied(STATE, bad)
    except ValueError as e:
        assert "taken back" in str(e)
    else:
        raise AssertionError
    assert editlog.problem("MOVE_CITATION", {}) and editlog.problem("nothing", {})


def test_no_member_is_lost_in_a_merge():
    state = {("t", str(i)): m for i, m in enumerate([[24], [2, 9, 15], [3, 6], [5, 7, 10, 11, 23], [8]])}
    after, _ = editlog.applied(state, "MERGE_POSITIONS", {"keys": [["t", "1"], ["t", "3"]], "theme": "t", "title": "m"})
    assert sorted(m for v in after.values() for m in v) == sorted(m for v in state.values() for m in v)
