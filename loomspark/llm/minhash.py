"""Near-duplicate documents by ProbMinHash: signatures of weighted shingles, banding, verification, classes.

A document is a distribution over its shingles (five words; a shingle's weight is how often it occurs). Two documents
are near duplicates when their probability Jaccard similarity, sum over common shingles i of
1 / sum_j max(p_j / p_i, q_j / q_i), is 0.8 or more; for shingles that occur once each it is the Jaccard index.

1. Equal contents (the same words in order) become one row each.
2. Signatures: a shingle's arrivals form a Poisson process with its weight as rate; each arrival goes to a random
   register, which keeps its earliest. Processes are run side by side, arrival by arrival, and one ends as soon as its
   time passes the latest register (early termination). Two documents share a register with probability J_P.
3. Banding: ``BANDS`` bands of ``ROWS`` registers; a pair of similarity 0.8 misses all of them with probability 5e-8.
4. Stars: in each bucket every member is verified against one pivot, the content with most copies. A bucket of any
   size gives as many pairs as it has members.
5. Rest: a link may join two members that both differ from the pivot. So buckets that overlap are put together to
   families; the members of a family outside its largest class so far are compared with all members of other classes,
   in blocks of bounded size, and links between classes, not pairs, come out.
6. Classes are the components of all verified links.

Cases: a null text counts as empty; contents without words are equal to each other only; a content of fewer than five
words is one shingle; texts are read whole; rows that repeat, in whole or in id, are members each; a null id never
names a class unless all its members' are null; an empty table gives an empty result; the output has only the id and
the columns named here, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import bucketed, release, stored, table, text_of
from loomspark.llm.components import components

#: Words in a shingle, least similarity, registers, bands and registers in a band.
WORDS, LEAST, REGISTERS, BANDS, ROWS = 5, 0.8, 128, 32, 4
#: Rows of a family that one task compares: members outside the largest class, and members of all classes; bytes of text
#: that each of the two has, about (a longer text is a block of its own).
OPEN_BLOCK, MEMBER_BLOCK, BLOCK_BYTES = 2048, 1024, 1 << 23

_U = np.uint64
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's shingles, and how often each occurs. Words are parted by single spaces."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], gaps + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    # Each byte's value times a power for its place; places past the table begin it anew with another byte table value.
    value = _BYTE[raw] * _POWERS[place & 63] + mixed((place >> 6).astype(np.uint64))
    value[gaps] = 0
    word = mixed(np.add.reduceat(value, starts))
    n = max(1, len(word) - words + 1)
    found = np.zeros(n, np.uint64)
    for i in range(min(words, len(word))):
        found = found * _U(0x9E3779B97F4A7C15) + word[i : i + n]
    return np.unique(mixed(found), return_counts=True)


def signature(found: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that each register keeps."""
    time, rate = np.zeros(len(found)), weight / weight.sum()
    kept_time, kept = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    first, first_id = np.empty(registers), np.empty(registers, np.uint64)
    arrival = 0
    while len(found):
        arrival += 1
        draw = mixed(found + _U(arrival * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 1) / 2**53) / rate
        place = (draw & _U(registers - 1)).astype(np.intp)
        order = np.argsort(-time, kind="stable")
        first.fill(np.inf)
        first[place[order]] = time[order]
        first_id[place[order]] = found[order]
        better = first < kept_time
        kept_time[better], kept[better] = first[better], first_id[better]
        alive = time < kept_time.max()
        found, rate, time = found[alive], rate[alive], time[alive]
    return kept


def band_keys(kept: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    found = np.arange(1, bands + 1, dtype=np.uint64)
    for column in kept[: bands * rows].reshape(bands, rows).T:
        found = mixed(found * _U(0x9E3779B97F4A7C15) + column)
    return found.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> float:
    """Probability Jaccard similarity of two weighted shingle sets; 0 where the sum of the smaller probabilities, which it
    is at most, is under ``least``."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    p, q = a[1] / a[1].sum(), b[1] / b[1].sum()
    pi, qi = p[i], q[j]
    if not len(both) or np.minimum(pi, qi).sum() < least - 1e-9:
        return 0.0
    # For a common i: sum_j max(p_j / p_i, q_j / q_i). With r = q / p of the common ones in order, j counts by p where
    # r_j is below r_i and by q where it is above, so running sums give all of these in one go.
    ratio = qi / pi
    order = np.argsort(ratio, kind="stable")
    pi, qi = pi[order], qi[order]
    below = np.cumsum(pi)
    above = qi.sum() - np.cumsum(qi)
    only_p, only_q = p.sum() - pi.sum(), q.sum() - qi.sum()
    return float((1 / ((below + only_p) / pi + (above + only_q) / qi)).sum())


def content(text: Column) -> Column:
    """The text's words, single-spaced: what counts of it."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def key_of(text: Column) -> Column:
    """128 bits of the SHA-256 of a content: contents are taken for equal by it."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def contents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, text, first_id, copies: one row per different content, bucketed by key, so that later joins leave texts in place."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), content(text_of(text_col)).alias("text"))
    one = rows.withColumn("key", key_of(F.col("text"))).groupBy("key")
    return bucketed(one.agg(F.min("text").alias("text"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "contents", "key")


def banded(rows: DataFrame) -> DataFrame:
    """key, copies and bands (array) of each content that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            bands = [band_keys(signature(*shingles(t.as_py()))) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["copies"], pa.array(bands, pa.list_(pa.int64()))], ["key", "copies", "bands"])
        release()

    return rows.where("text <> ''").select("key", "copies", "text").mapInArrow(run, "key binary, copies long, bands array<long>")


def stars(bands: DataFrame) -> DataFrame:
    """a (pivot), b: each member of a bucket with the bucket's pivot."""
    rows = bands.select("key", "copies", F.explode("bands").alias("band"))
    pivot = rows.groupBy("band").agg(F.max(F.struct("copies", "key")).alias("top"), F.count("*").alias("members")).where("members > 1")
    return rows.join(pivot.select("band", F.col("top.key").alias("a")), "band").where("a <> key").select("a", F.col("key").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether their similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pivot = known = None
        for batch in batches:
            linked = []
            for a, x, y in zip(batch["a"].to_pylist(), batch["text_a"], batch["text_b"]):
                if a != pivot:  # pairs come in order of their pivots
                    pivot, known = a, shingles(x.as_py())
                linked.append(similarity(known, shingles(y.as_py()), least) >= least)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])
        known = None
        release()

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a binary, b binary, linked boolean")


def links_between(opened: pa.Table, members: pa.Table, least: float) -> set[tuple[bytes, bytes]]:
    """Pairs of classes of which one of ``opened`` and one of ``members`` are linked; both tables have component, text."""
    if not opened.num_rows or not members.num_rows:
        return set()
    parts = members.column("component").to_pylist()
    sets = [shingles(t.as_py()) for t in members.column("text")]
    sizes = np.array([len(s) for s, _ in sets])
    every = np.concatenate([s for s, _ in sets])
    share = np.concatenate([w / w.sum() if len(w) else w for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, share, owner = every[order], share[order], owner[order]
    found = set()
    for own, text in zip(opened.column("component").to_pylist(), opened.column("text")):
        s, w = shingles(text.as_py())
        if not len(s):
            continue
        lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        # J_P is at most the sum of the smaller probabilities.
        common = np.bincount(owner[at], np.minimum(share[at], np.repeat(w / w.sum(), n)), len(sets))
        for m in np.flatnonzero(common >= least - 1e-9):
            if parts[m] != own and (own, parts[m]) not in found and similarity((s, w), sets[m], least) >= least:
                found.add((own, parts[m]))
    return found


def _family_blocks(rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` (key, component, family): members outside their family's largest class, and all members, with text, by
    cell (family, i, j) of bounded rows and bytes."""
    rows = stored(rows.join(texts.select("key", "text"), "key").withColumn("bytes", F.octet_length("text").cast("long")), "families")
    sizes = rows.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    whole = sizes.groupBy("family").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "component", "bytes")).alias("top"))
    blocks = lambda n, size, most: F.ceil(F.greatest(n / most, size / BLOCK_BYTES)).cast("int")
    whole = whole.select("family", F.col("top.component").alias("largest"), blocks(F.col("n"), F.col("bytes"), MEMBER_BLOCK).alias("blocks"),
                         blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"), OPEN_BLOCK).alias("opens"))
    rows = rows.join(stored(whole, "families-open"), "family").withColumn("where", F.xxhash64("key"))
    cells = lambda mine, other: F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(mine)
    outside = rows.where("component <> largest").withColumn("i", F.pmod("where", F.greatest("opens", F.lit(1))).cast("int"))
    outside = outside.select("family", "i", cells("j", "blocks"), "component", "text")
    members = rows.withColumn("j", F.pmod("where", "blocks").cast("int")).select("family", cells("i", "opens"), "j", "component", "text")
    return outside.toDF(*outside.columns), members  # columns of its own, for both sides come from one frame


def classes(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """key, component (what tells the class), class_id (smallest id of the class), class_size (rows of it), for the contents
    of :func:`contents`."""
    tested = stored(stars(stored(banded(rows), "bands")), "pairs")
    wanted = tested.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = bucketed(rows.join(wanted, "key", "left_semi").select("key", "text"), "texts", "key")
    checked = stored(verified(tested, texts, least), "checked")
    found = components(checked.where("linked").select("a", "b"))
    # Buckets that did not verify join classes to families: only classes of one family may have links left.
    own = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"class_{side}"))
    apart = checked.where("not linked").select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left")
    apart = apart.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).where("a <> b")
    apart = stored(apart.distinct(), "apart")
    family = components(apart).select(F.col("node").alias("component"), F.col("component").alias("family"))
    alone = family.select(F.col("component").alias("node"), "component")  # a class's name is a member of it
    members = found.unionByName(alone).distinct().withColumnRenamed("node", "key").join(family, "component")

    def run(keys, opened: pa.Table, members: pa.Table) -> pa.Table:
        links = sorted(links_between(opened, members, least))
        if opened.nbytes + members.nbytes > BLOCK_BYTES // 4:
            release()
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    opened, members = _family_blocks(members, texts)
    links = opened.groupBy("family", "i", "j").cogroup(members.groupBy("family", "i", "j")).applyInArrow(run, "a binary, b binary")
    # Classes that these links join: components over classes, not over documents.
    joined = components(links).select(F.col("node").alias("class"), F.col("component").alias("whole"))
    labels = found.withColumnRenamed("component", "class").unionByName(family.select(F.col("component").alias("node"), F.col("component").alias("class"))).distinct()
    labels = labels.join(joined, "class", "left").select("node", F.coalesce("whole", "class").alias("component"))
    labelled = rows.drop("text").join(labels, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key")).drop("node")
    labelled = stored(labelled, "labelled")
    whole = labelled.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    return labelled.join(whole, "component").select("key", "first_id", "component", "class_id", "class_size")


def near_duplicates(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id of the class), class_size, kept (whether the id names the class) of every row."""
    found = stored(classes(contents(docs, id_col, text_col), least), "classes")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(content(text_of(text_col))).alias("key"))
    out = rows.join(found.drop("first_id"), "key")
    return out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each class, that of the smallest id, with all their columns."""
    found = stored(classes(contents(docs, id_col, text_col), least), "classes")
    # Classes are told by their component: null ids and ids that repeat make class_id the same for several.
    top = F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("top")
    first = found.groupBy("component").agg(top).select(F.struct(F.col("top.key").alias("key"), F.col("top.first_id").alias("id")).alias("__first"))
    # Content and id in one: a struct is never null, and structs are equal where their fields are, nulls included.
    mine = docs.withColumn("__own", F.struct(key_of(content(text_of(text_col))).alias("key"), F.col(id_col).cast("long").alias("id")))
    kept = mine.join(first, F.col("__own") == F.col("__first"), "left_semi")
    # Rows that repeat an id and a content are side by side after the join: one of them stays.
    number = F.row_number().over(Window.partitionBy("__own").orderBy("__own"))
    return kept.withColumn("__number", number).where("__number = 1").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
