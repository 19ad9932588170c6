"""The pipeline's stages, one by one, against plain versions on a small table."""

import hashlib
import re

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as pipeline
from loomspark.llm import bpe, langid, mixing
from loomspark.llm.common import stored
from tests.llm.test_results import brute_classes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    rng = np.random.default_rng(6)
    words = {"en": ["the", "house", "with", "water", "green", "thing"], "fr": ["le", "maison", "avec", "où", "été", "chose"]}
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(f"{w}{'abcdefgh'[k]}" for w, k in zip(rng.choice(words[lang], 60), rng.integers(0, 8, 60))), lang, f"s{i % 4}"))
    near = rows[5][1].split()
    near[30] = "changed"
    rows += [(100, rows[3][1] + " \n", "en", "s1"), (101, " ".join(near), "en", "s2"), (102, None, "en", "s1"), (103, "123 456", None, None), (104, rows[7][1], "en", None), (105, "Привет как дела сегодня", "en", "s0")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows], COLUMNS).repartition(3)
    out, now = {}, stored(docs, "input")
    for name, stage in pipeline.STAGES:
        after = stored(stage(spark, now, ""), name)
        out[name] = now.toPandas(), after.toPandas(), now
        now = after
    return out


def test_columns(stages):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    assert [n for n, _ in pipeline.STAGES] == ["language", "exact", "near", "mix", "tokens"]
    assert all(list(after.columns) == names for name, (_, after, _) in stages.items() if name != "tokens")


def test_language_rejects_what_it_should(stages):
    before, after, frame = stages["language"]
    model = langid.fit(langid.training(frame))
    keep = {i for i, t in zip(before["doc_id"], before["text"]) if not model.predict([t or ""])[2][0]}
    assert set(after["doc_id"]) == keep and keep >= set(range(90)) and not keep & {102, 103}


def test_exact_leaves_the_longest_of_equals(stages):
    before, after, _ = stages["exact"]
    best = {}
    for i, t in zip(before["doc_id"], before["text"]):
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (0, 1e9)), (-len(t), i))
    assert sorted(after["doc_id"]) == sorted(i for _, i in best.values()) and 100 in set(after["doc_id"]) and 3 not in set(after["doc_id"])


def test_near_leaves_one_of_each_class(stages):
    before, after, _ = stages["near"]
    label = brute_classes(dict(zip(before["doc_id"], before["text"])))
    assert sorted(after["doc_id"]) == sorted(set(label.values())) and 101 not in set(after["doc_id"])


def test_mix_takes_the_targets(stages):
    before, after, _ = stages["mix"]
    size = lambda d: d.assign(n=d["text"].str.split().str.len()).groupby("source", dropna=False)["n"].sum()
    was, now = size(before), size(after)
    total, weights, target = was.sum(), dict(zip(sorted(k for k in was.index if isinstance(k, str)), [3, 1, 2, 3, 1, 2])), {}
    open_ = {k: weights.get(k, 2) for k in was.index}
    while True:
        level = (1.5 * total - sum(target.values())) / sum(open_.values())
        full = [k for k, w in open_.items() if w * level > 2 * was[k]]
        if not full:
            break
        for k in full:
            target[k] = 2 * was[k]
            del open_[k]
    target |= {k: w * level for k, w in open_.items()}
    assert all(abs(now[k] - target[k]) <= 1.5 * mixing.BLOCK_WORDS for k in was.index)
    assert (after.groupby("doc_id").size() <= 2).all()


def test_tokens_equal_the_library(stages):
    before, after, _ = stages["tokens"]
    path, pattern = bpe.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    digest = lambda t: hashlib.sha256(",".join(map(str, own.encode_ordinary(t))).encode()).hexdigest()
    assert sorted(zip(after["doc_id"], after["ids_sha256"])) == sorted((i, digest(t)) for i, t in zip(before["doc_id"], before["text"]))
