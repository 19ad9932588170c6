"""The mix against a plain version: per-shard counts, indexes, blocks and words."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.llm import mixing

BLOCK, SHARD = 8, 64


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(3 + i * 7 % 40)), ["big", "big", "a", "b", None][i % 5]) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="module")
def plan(docs):
    sizes = docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))
    return mixing.planned(sizes, BLOCK).cache()


def test_counts_of_each_shard(plan):
    slots = {r["source"]: r["slots"] for r in plan.collect()}
    total = sum(slots.values())
    counts = mixing.shard_counts(plan, SHARD).collect()
    by_shard, first = Counter(), defaultdict(int)
    for r in sorted(counts, key=lambda r: r["shard"]):
        by_shard[r["shard"]] += r["count"]
        assert r["first"] == first[r["source"]]
        first[r["source"]] += r["count"]
    assert dict(first) == {s: n for s, n in slots.items() if n}
    assert sorted(by_shard.values()) == sorted([SHARD] * (total // SHARD) + ([total % SHARD] if total % SHARD else []))
    # Hypergeometric: the mean of squared deviations over the variance is near 1, and counts do vary.
    full = [s for s, n in by_shard.items() if n == SHARD]
    got = {(r["shard"], r["source"]): r["count"] for r in counts}
    ratios = []
    for source, n in slots.items():
        p = n / total
        variance = SHARD * p * (1 - p) * (total - SHARD) / (total - 1)
        ratios += [(got.get((s, source), 0) - SHARD * p) ** 2 / variance for s in full]
    assert 0.6 < sum(ratios) / len(ratios) < 1.5


def test_slots_follow_the_counts(plan):
    want = {(r["shard"], r["source"]): r["count"] for r in mixing.shard_counts(plan, SHARD).collect()}
    slots = mixing.drawn(plan, SHARD).collect()
    assert Counter((r["shard"], r["source"]) for r in slots) == want
    by_shard = defaultdict(list)
    for r in slots:
        by_shard[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())
    blocks = {r["source"]: r["blocks"] for r in plan.collect()}
    times = Counter((r["source"], r["block"]) for r in slots)
    for source, n in blocks.items():
        own = [times[source, b] for b in range(n)]
        assert max(own) - min(own) <= 1  # none twice before each once
        if sum(own) % n:  # what is taken once more is spread over the stream, no prefix of it
            once_more = [b for b in range(n) if own[b] == max(own)]
            assert once_more != list(range(len(once_more)))


def test_words_taken_by_a_plain_version(docs, plan):
    times = Counter((r["source"], r["block"]) for r in mixing.drawn(plan).collect())
    starts = {r["doc_id"]: r["start"] for r in mixing._streams(docs, "doc_id", "text", "source").collect()}
    want = {}
    for r in docs.collect():
        at = starts[r["doc_id"]]
        want[r["doc_id"]] = sum(times[r["source"], (at + k) // BLOCK] for k in range(len(r["text"].split())))
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block_words=BLOCK).collect()} == want


def test_the_slots_come_from_the_stored_draw(plan):
    """The plan of the slots reads counts and first indexes of shards; the mix stores what it makes of them."""
    found = mixing.drawn(plan, SHARD)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"{c}#" in found for c in ("shard", "count", "first", "turn")) and "parquet" in found
