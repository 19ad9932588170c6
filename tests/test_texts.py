"""Text functions, quotes, chunks, models and the stream."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chunking, dedupe, models, quotes, ranking, rules
from loomspark.plans.orchestrator import Run, consultation
from loomspark.sources.tables import Steps
from loomspark.streaming.drafts import event_counts, latest_table


def one(spark, column, **values):
    row = spark.createDataFrame(pd.DataFrame([values]))
    return row.select(column.alias("x")).first()["x"]


def test_numbers_as_ranges(spark):
    d = spark.createDataFrame([([5, 1, 2, 3, 9, 3],), ([],)], "n array<int>")
    assert [r[0] for r in d.select(T.compress_numbers(F.col("n"))).collect()] == ["1-3, 5, 9", ""]


def test_text_functions(spark):
    assert one(spark, T.tokenize("t"), t="Hej, Verden! på Ø") == ["hej", "verden", "på", "ø"]
    assert one(spark, T.fingerprint("t"), t="one two three") == []
    assert one(spark, T.balanced("t"), t="(a(b)c)") and not one(spark, T.balanced("t"), t=")(")
    assert one(spark, T.truncate("t", 10), t="abcdefgh. ijk") == "abcdefgh."
    assert one(spark, T.truncate_words("t", 10), t="abcdefg hijkl") == "abcdefg..."
    assert one(spark, T.joined_list(F.split("t", ",")), t="a,b,c") == "a, b og c"
    assert one(spark, T.headers("t"), t="# A\ntext\n## B\n# A") == ["A", "B"]
    assert one(spark, T.section_keys("t"), t="§ 3 og §12 og § 3") == "12+3"
    assert one(spark, T.clean_markup("t"), t="# A\n**b** [c](d)") == "A b c"
    assert one(spark, T.has_structure("t"), t="- item") and not one(spark, T.has_structure("t"), t="item")


def test_quote_cascade():
    source = "The council said:  We do not want\nmore cars, in the inner city at all."
    cases = {"We do not want": "exact", "We do not want more cars": "spaces", "we do not WANT": "case", "wedonotwant morecarsin": "letters", "want more cars in the outer city": "words"}
    for quote, method in cases.items():
        found = quotes.match(source, quote)
        assert found and found[0] == method, (quote, found)
    assert quotes.match(source, "nothing of the sort here") is None and quotes.match(None, "x") is None


def test_validated_citations(spark):
    docs = spark.createDataFrame([(1, "Some words, here")], "id long, text string")
    c = spark.createDataFrame([(1, "Some words"), (1, "some WORDS here"), (1, ""), (1, "other"), (2, "x")], "id long, quote string")
    assert sorted(r["status"] for r in quotes.validated(c, docs, "id", "quote", "text").collect()) == ["empty", "exact", "missing", "normalized", "not-found"]


def test_exact_places_of_short_and_long_quotes(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five six"), (2, "three")], "d long, text string")
    q = spark.createDataFrame([(1, "ne two three four fi"), (2, "three"), (3, "absent words that are not there")], "q long, text string")
    assert sorted(tuple(r) for r in quotes.exact_places(docs, q, "d", "text", "q", "text").collect()) == [(1, 1, 5), (1, 2, 12), (2, 2, 1)]


def test_chunks_cover_the_text():
    text = "\n\n".join(f"Paragraph {i}. " + "Some words stand here. " * (i % 9) for i in range(60))
    joined = " ".join(c["content"] for c in chunking.free_text(text, 100))
    assert joined.split() == text.split()
    assert all(chunking.tokens(c["content"]) <= 130 for c in chunking.free_text(text, 100))
    assert chunking.free_text("") == [] and len(chunking.free_text("short text", whole_below=800)) == 1
    assert chunking.free_text(text, 100, 20)[1]["content"].split()[0] in text


def test_sections_know_their_parents():
    found = chunking.sections("intro\n# A\na\n## B\nb\n#### C\nc\n## D\nd\n# E\n")
    assert [(s["title"], s["path"]) for s in found] == [(None, []), ("A", []), ("B", ["A"]), ("C", ["A", "B"]), ("D", ["A"]), ("E", [])]


def test_copies_in_groups(spark):
    base = "these are many different words in a long enough text that it counts as a real answer to the question asked by the city today"
    rows = [(1, base), (2, base), (3, base + " indeed"), (4, "something else entirely " * 8), (5, "short")]
    d = spark.createDataFrame(rows, "id long, text string")
    assert {(r["id"], r["group"], r["size"]) for r in dedupe.copy_groups(d, "id", "text").collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3)}


def test_stratified_sample_has_every_stratum(spark):
    d = spark.range(1000).select("id", F.when(F.col("id") < 990, "big").otherwise("small").alias("s"))
    found = ranking.stratified(d, [F.col("s")], [F.col("id")], 50).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in found} == {"big": 50, "small": 1}


def test_rules(spark):
    found = {k: one(spark, rules.direction("t"), t=k) for k in ("pro_change", "pro_status_quo", "x")}
    assert found == {"pro_change": "support", "pro_status_quo": "against", "x": "neutral"}
    assert one(spark, rules.cluster_count(F.col("n"), F.lit(1.0), F.lit(1.0), F.lit(1.0)), n=1000) == 38


def test_models_keep_order_and_survive_failures(spark):
    d = spark.createDataFrame([(i, f"text {i % 3}") for i in range(20)], "id long, text string")
    found = models.embedded(d, "text").collect()
    assert len(found) == 20 and all(len(r["embedding"]) == 16 for r in found)

    def fails(batch):
        raise RuntimeError

    lost = models.embedded(d, "text", fails, error="why").collect()
    assert lost and all(r["embedding"] == [] and "Error" in r["why"] for r in lost)
    with pytest.raises(Exception, match="the model failed 3 times"):
        models.embedded(d, "text", fails).collect()


def test_a_run_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"We want trees and less noise number {i}. The park is nice.", "t") for i in range(5)], "id long, text string, theme string")
    store = Steps(spark, str(tmp_path))
    first = Run(spark, consultation(rows, "trees and noise", 3), store, "1")
    assert first.run(stop_after="retrieve")["retrieve"].count() == 3
    second = Run(spark, consultation(rows, "trees and noise", 3), store, "1")
    assert set(second.run(resume_from="arguments")) == set(second.steps) and "load" not in second.seconds


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, f"2024-01-01 0{i % 5}:00:00", "view", 1.0) for i in range(30)], "event_id long, user_id long, t string, event_type string, value double")
    rows.select("event_id", "user_id", F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = event_counts(stream()).writeStream.outputMode("complete").format("memory").queryName("loom_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from loom_counts").first()[0] == 30
    q = latest_table(stream(), ["user_id"], ["ts", "event_id"], str(tmp_path / "out"), str(tmp_path / "cp"), lambda: None)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
