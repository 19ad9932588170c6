"""Sources, jobs and repairs of model output."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import labels, prose
from loomspark.operators import jobs, positions
from loomspark.sources import jsonapi, tables


@pytest.mark.parametrize(("text", "want"), [
    ('```json\n{"a": 1,}\n```', {"a": 1}), ('text {"a": [1, 2', {"a": [1, 2]}), ('{"a": 1, "b": "x', {"a": 1, "b": "x"}), ('{"a": 1} and more', {"a": 1}), ('{"a": 1, "b', {"a": 1}),
])
def test_json_repair(text, want):
    assert json.loads(prose.repair_json(text)) == want
    assert prose.repair_json("nothing") is None


def test_prose_rules():
    assert prose.unique_markers("a <<REF_1>> b <<REF_1>>. c <<REF_2>>") == "a <<REF_1>> b. c <<REF_2>>"
    assert prose.unescape_markdown(r"\*a\* `\*b\*`") == r"*a* `\*b\*`"
    assert prose.normalize_markdown("a\\n{>>x\\ny<<}\r\n") == "a\\n{>>x\ny<<}\n"
    assert prose.whole_sentences("One. Two is longer. Three.", 20) == "One. Two is longer."
    assert prose.ordered_labels("En borger siger ja. En borger siger nej. Andre. En borger ser.") == "En borger siger ja. En anden borger siger nej. Andre. En borger ser."
    assert prose.contents("# A\n## B\n#### C") == "- A\n  - B"
    assert prose.markdown_issues("x{>>a<<} {>> <<} {>>") == ["3 comments begin and 2 end", "empty comment", "no space before a comment"]


def test_json_api_pages(spark):
    item = lambda i, refs, user, gone=False: {"id": i, "type": "comment", "attributes": {"isDeleted": str(gone).lower()}, "relationships": {"contents": {"data": [{"id": r, "type": "content"} for r in refs]}, "user": {"data": {"id": user}}}}
    part = lambda i, t: {"id": i, "type": "content", "attributes": {"textContent": t}}
    page = {"data": [item("7", ["c2", "c1"], "u1"), item("8", ["c3"], "u1"), item("9", ["c1"], "u2", True)], "included": [part("c1", "first"), part("c2", "second"), part("c3", " "), {"id": "u1", "type": "user", "attributes": {"name": "Anna"}}]}
    rows = jsonapi.comments(spark.createDataFrame([(1, json.dumps(page))], "page int, body string")).collect()
    assert [tuple(r) for r in rows] == [(7, "second\n\nfirst", "Anna")]
    d = spark.createDataFrame([(" bÃ¸rn� ",)], "t string")
    assert d.select(jsonapi.fix_encoding("t")).first()[0] == "børn"


def test_files_by_kind(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.txt").write_text("text")
    (tmp_path / "c.bin").write_bytes(b"%PDF-1.4")
    assert {(r["kind"], r["text"]) for r in tables.read_files(spark, str(tmp_path)).collect()} == {("markdown", "# A"), ("text", "text"), ("pdf", None)}


def test_jobs(spark):
    e = spark.createDataFrame([("j", 1, 1, "running", "load", 10, None), ("j", 2, 2, None, "embed", None, None), ("j", 3, 3, "failed", None, None, "x")], "job_id string, at long, seq int, status string, step string, progress int, error string")
    assert tuple(jobs.job_state(e).first()) == ("j", "failed", "embed", 10, "x", 3)
    cache = spark.range(5).select(F.col("id").cast("string").alias("key"), F.col("id").alias("stored_at"))
    assert sorted(r["key"] for r in jobs.without_oldest(cache).collect()) == ["2", "3", "4"]
    changes = spark.createDataFrame([("responses", "new"), ("materials", "unchanged")], "kind string, change string")
    assert dict(jobs.reusable_steps(changes, {"summary": ["materials"], "mapping": ["materials", "responses"]}).collect()) == {"summary": True, "mapping": False}
    lines = spark.createDataFrame([("[load-data] completed in 1.5s",), ("noise",)], "line string")
    assert [tuple(r) for r in jobs.log_timings(lines).collect()] == [("load-data", 1.5)]


def test_labels_and_recovery(spark):
    d = spark.createDataFrame([("Tre borgere", [1, 2, 3]), ("To borgere", [1]), ("A og B", [1])], "label string, members array<int>")
    assert [r[0] for r in d.select(labels.label_matches("label", F.col("members"))).collect()] == [True, False, True]
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "g string, m long")
    after = spark.createDataFrame([("a", 1)], "g string, m long")
    targets = spark.createDataFrame([("b", "a"), ("c", None)], "source string, target string")
    assert sorted(positions.recovered(before, after, targets, "g", "m").collect()) == [("a", 1), ("a", 2)]
