"""Copies among short texts: n-gram fingerprints, verified links, groups.

Texts are read again for each step instead of being stored with their grams; what is stored are hashes of grams:

1. Texts with equal fingerprints are one set, told by 128 bits of a hash, and linked to its smallest id (``rep``).
2. Prefix filtering finds every pair of similar sets without comparing all: with grams in one order, two sets of
   similarity t have their first common gram among the first n - ceil(t n) + 1 of each. Any order will do; rare grams come
   first, by counts of ``CELLS`` cells of hashes. Only these grams are dealt out, packed, and a pair is a candidate
   only if the sizes, and the grams that are left after the common one, suffice for t, and if bit maps of the
   two sets, of about a bit a gram, do not tell more grams apart than t allows. Only the sets left are read again and compared.
3. Where a gram has more candidates than ``PAIRS`` a set, as in a large group of near copies, its sets are a crowd: each is
   compared with one pivot of the crowd. Sets that differ from their pivot may still be linked to others: crowds that
   overlap are put together to families, whose sets outside the largest class meet all sets, in blocks.

A gram counts as its 64-bit hash. Rows without an id take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.graph import components
from loomspark.sources.tables import checkpointed

#: Cells of hashes that grams are counted in, and rows that a task's counts are dealt to; slots that mark wanted ids; words
#: whose hashes a worker keeps.
CELLS, SLICES, SLOTS, KNOWN = 1 << 18, 16, 1 << 23, 1 << 19
#: Candidates for each set of a gram, from which they are a crowd; postings that one task sorts at once, or holds before it deals them out.
PAIRS, POSTINGS, HELD = 4, 1 << 20, 1 << 18
#: Sets of a family on either side of a block, and bytes of their grams, about.
BLOCK, BLOCK_BYTES = 1024, 1 << 23
#: A gram in a prefix: its set (the first 64 bits of the key), the set's size and the gram's place in it.
POSTING = np.dtype([("gram", "<u8"), ("set", "<i8"), ("n", "<u4"), ("at", "<u4")])

_U = np.uint64
_WORD = re.compile(r"[A-Za-z0-9_æøå]{3,}")  # the words of functions.text.fingerprint


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Hashes of words, of which a worker keeps ``KNOWN`` at most."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return found


_WORDS = _Words()


def gram_hashes(lower: str, n: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the grams of :func:`loomspark.functions.text.fingerprint` of a text in lower case."""
    words = _WORD.findall(lower)
    if len(words) < n:
        return np.empty(0, np.uint64)
    word = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    found = np.zeros(len(word) - n + 1, np.uint64)
    for i in range(n):
        found = found * _U(0x9E3779B97F4A7C15) + word[i : i + len(found)]
    return np.unique(_mixed(found))


def _key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _bits(grams: np.ndarray) -> bytes:
    """A bit map of grams by their last bits, with at least as many bits as grams."""
    found = np.zeros(max(8, 1 << (len(grams) - 1).bit_length()), bool)
    found[(grams & _U(len(found) - 1)).astype(np.int64)] = True
    return np.packbits(found).tobytes()


def _most_common(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> int:
    """What two sets have in common at most, by their bit maps: a bit that only one has is a gram of its own."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n_x - int(np.bitwise_count(x & ~y).sum()), n_y - int(np.bitwise_count(y & ~x).sum()))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row and grams of the texts that have any."""
    for i, lower in enumerate(batch["lower"]):
        grams = gram_hashes(lower.as_py())
        if len(grams):
            yield i, grams


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> _U(65 - CELLS.bit_length())).astype(np.int64)


def _keys_and_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key, set, size and bit map of each text; after them, with a slice each, how many grams of all these texts each cell has."""
    counts, names, kind = np.zeros(CELLS, np.int64), ["id", "key", "set", "n", "bits", "slice", "counts"], None
    for batch in batches:
        at, keys, sizes, bits, cells, kind = [], [], [], [], [], batch["id"].type
        for i, grams in _each(batch):
            at.append(i)
            keys.append(_key(grams))
            sizes.append(len(grams))
            bits.append(_bits(grams))
            cells.append(_cell(grams))
            if sum(map(len, cells[-64:])) > HELD or len(cells) == 1024:
                counts += np.bincount(np.concatenate(cells), minlength=CELLS)
                cells = []
        if cells:
            counts += np.bincount(np.concatenate(cells), minlength=CELLS)
        none = [pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), pa.array(keys, pa.binary()), pa.array(map(_short, keys), pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), *none], names)
    if kind is not None:
        packed = [x.tobytes() for x in np.split(np.minimum(counts, 2**32 - 1).astype("<u4"), SLICES)]
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, kind), pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names)


def _sum_of_slice(part: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // SLICES, np.int64)
    for x in part["counts"]:
        total += np.frombuffer(x.as_py(), "<u4")
    return pa.table({"slice": part["slice"][:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


def _prefixes(counts: np.ndarray, parts: int, least: float) -> Callable:
    """part, packed: postings of each different set's rarest grams, dealt out by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, many = set(), [], 0

        def dealt() -> pa.RecordBatch:
            rows = np.concatenate(held)
            part = (rows["gram"] % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows, ends = rows[order], np.cumsum(np.bincount(part, minlength=parts))
            own = np.flatnonzero(np.diff(ends, prepend=0))
            packed = [rows[(ends[p - 1] if p else 0) : ends[p]].tobytes() for p in own]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

        for batch in batches:
            for _, grams in _each(batch):
                key = _key(grams)
                if key in seen:
                    continue
                seen.add(key)
                n = len(grams)
                first = n - int(np.ceil(n * least - 1e-9)) + 1
                rows = np.empty(first, POSTING)
                rows["gram"] = grams[np.argsort(counts[_cell(grams)], kind="stable")[:first]]  # of equal counts by hash
                rows["set"], rows["n"], rows["at"] = _short(key), n, np.arange(first)
                held.append(rows)
                many += first
                if many >= HELD:
                    yield dealt()
                    held, many = [], 0
        if held:
            yield dealt()

    return run


def _meetings(rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of pairs of postings of one gram, in order of sizes, that sizes and places allow; None for a crowd."""
    n, left = rows["n"].astype(np.int64), (rows["n"] - rows["at"]).astype(np.int64)
    upto = np.searchsorted(n, n / least + 1e-6, side="right")  # sizes that suit a smaller one
    i_all, j_all, most, found = [], [], PAIRS * len(rows), 0
    for i in range(len(rows)):
        j = np.arange(i + 1, upto[i])
        j = j[np.minimum(left[i], left[j]) >= (n[i] + n[j]) * (least / (1 + least)) - 1e-6]
        found += len(j)
        if found > most:
            return None
        i_all.append(np.full(len(j), i))
        j_all.append(j)
    return np.concatenate(i_all), np.concatenate(j_all)


def _candidates(least: float) -> Callable:
    """a, b, crowd: sets that may be similar, each pair once in a part; in a crowd, each set with the pivot ``a``."""

    def run(part: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_py(), POSTING) for x in part["packed"]])
        rows = rows[np.argsort(rows["gram"], kind="stable")]
        same = rows["gram"][1:] == rows["gram"][:-1]
        rows = rows[np.append(same, False) | np.append(False, same)]  # grams of one posting meet none
        rows = rows[np.lexsort((rows["set"], rows["n"], rows["gram"]))]
        again = (rows["gram"][1:] == rows["gram"][:-1]) & (rows["set"][1:] == rows["set"][:-1]) & (rows["n"][1:] == rows["n"][:-1])
        rows = rows[np.append(True, ~again)[: len(rows)]]  # one set from several tasks
        # Postings of one gram whose sizes are too far apart do not meet.
        cuts = np.flatnonzero((rows["gram"][1:] != rows["gram"][:-1]) | (rows["n"][:-1] < least * rows["n"][1:] - 1e-6)) + 1
        pairs, crowds = set(), set()
        starts, ends = np.append(0, cuts), np.append(cuts, len(rows))
        two = starts[ends - starts == 2]
        x, y = rows[two], rows[two + 1]
        left = np.minimum(x["n"].astype(np.int64) - x["at"], y["n"].astype(np.int64) - y["at"])
        suit = left >= (x["n"].astype(np.int64) + y["n"]) * (least / (1 + least)) - 1e-6
        pairs.update(zip(np.minimum(x["set"], y["set"])[suit].tolist(), np.maximum(x["set"], y["set"])[suit].tolist()))
        many = ends - starts > 2
        for lo, hi in zip(starts[many], ends[many]):
            own = rows[lo:hi]
            met = _meetings(own, least)
            if met is None:
                pivot = int(own["set"].min())
                crowds.update((pivot, x) for x in own["set"].tolist() if x != pivot)
            else:
                i, j = (own["set"][x] for x in met)
                pairs.update(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
        pairs -= crowds
        found = [*((a, b, False) for a, b in sorted(pairs)), *((a, b, True) for a, b in sorted(crowds))]
        a, b, crowd = zip(*found) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "crowd": pa.array(crowd, pa.bool_())})

    return run


def _sifted(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """a, b (keys), crowd, maybe: pairs (a, b, sets) that bit maps leave, and all of crowds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = []
            for x, y, n, m in zip(batch["bits_a"], batch["bits_b"], batch["n_a"].to_pylist(), batch["n_b"].to_pylist()):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                maybe.append(_most_common(x, y, n, m) >= (n + m) * (least / (1 + least)) - 1e-6)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["crowd"], pa.array(maybe, pa.bool_())], ["a", "b", "crowd", "maybe"])

    side = lambda x: reps.select(F.col("set").alias(f"set_{x}"), F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    joined = pairs.toDF("set_a", "set_b", "crowd").join(side("b"), "set_b").join(side("a"), "set_a")
    found = joined.select("a", "b", "crowd", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a binary, b binary, crowd boolean, maybe boolean")
    return found.where("crowd or maybe")


def _wanted_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, grams (packed), once each, of the sets in ``wanted`` (key, rep).

    A bit map of ids tells texts that are not wanted, so that few others are hashed and dealt out.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot("rep") % 32)
    bits = np.zeros(SLOTS // 32, np.int64)
    for r in wanted.groupBy(F.call_function("shiftright", slot("rep"), F.lit(5)).alias("at")).agg(F.bit_or(bit).alias("bits")).collect():  # SLOTS / 32 rows at most
        bits[r["at"]] = r["bits"]
    bits = bits.astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            slots, found = batch["slot"].to_numpy(), []
            for _, grams in _each(batch.filter(pa.array((bits[slots >> 5] >> (slots & 31).astype(np.uint32) & 1).astype(bool)))):
                key = _key(grams)
                if key not in seen:
                    seen.add(key)
                    found.append((key, grams.tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.binary(), pa.binary()))], ["key", "grams"])

    kept = texts.select(slot("id").alias("slot"), "lower").mapInArrow(run, "key binary, grams binary").join(wanted, "key", "left_semi")
    return checkpointed(kept.dropDuplicates(["key"]))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b (keys), crowd, linked: whether a pair's similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["grams_a"], batch["grams_b"]):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both / (len(x) + len(y) - both) >= least)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["crowd"], pa.array(linked, pa.bool_())], ["a", "b", "crowd", "linked"])

    side = lambda n: sets.select(F.col("key").alias(n), F.col("grams").alias(f"grams_{n}"))
    joined = pairs.where("maybe").join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    found = joined.select("a", "b", "crowd", "grams_a", "grams_b").mapInArrow(run, "a binary, b binary, crowd boolean, linked boolean")
    return found.unionByName(pairs.where("not maybe").select("a", "b", "crowd", F.lit(False).alias("linked")))


def _links_between(opened: pa.Table, members: pa.Table, least: float) -> set[tuple[bytes, bytes]]:
    """Pairs of classes of which one of ``opened`` and one of ``members`` are linked; both have component, grams."""
    if not opened.num_rows or not members.num_rows:
        return set()
    parts = members["component"].to_pylist()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in members["grams"]]
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    found = set()
    for own, packed in zip(opened["component"].to_pylist(), opened["grams"]):
        s = np.frombuffer(packed.as_py(), np.uint64)
        lo = np.searchsorted(every, s, "left")
        n = np.searchsorted(every, s, "right") - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        found |= {(own, parts[m]) for m in np.flatnonzero(both / (len(s) + sizes - both) >= least) if parts[m] != own}
    return found


def _family_links(checked: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: links between classes of sets that differ from the pivots of their crowds."""
    linked = checked.where("linked").select("a", "b")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    crowd = checked.where("crowd").select("a", "b")
    found = checkpointed(components(ends(linked.unionByName(crowd)), linked, "key"))
    own = lambda side: found.select(F.col("key").alias(side), F.col("component").alias(f"class_{side}"))
    apart = checkpointed(crowd.join(own("a"), "a").join(own("b"), "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).where("a <> b").distinct())
    family = components(ends(apart), apart, "key").toDF("component", "family")
    rows = ends(crowd).join(found, "key").join(family, "component").join(sets, "key")
    rows = checkpointed(rows.withColumn("bytes", F.octet_length("grams").cast("long")))
    sizes = rows.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    whole = sizes.groupBy("family").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "component", "bytes")).alias("top"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    whole = whole.select("family", F.col("top.component").alias("largest"), blocks(F.col("n"), F.col("bytes")).alias("blocks"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("opens"))
    rows = rows.join(whole, "family").withColumn("where", F.xxhash64("key"))
    cells = lambda mine, other: F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(mine)
    outside = rows.where("component <> largest").withColumn("i", F.pmod("where", "opens").cast("int")).select("family", "i", cells("j", "blocks"), "component", "grams")
    members = rows.withColumn("j", F.pmod("where", "blocks").cast("int")).where("opens > 0").select("family", cells("i", "opens"), "j", "component", "grams")

    def run(opened: pa.Table, members: pa.Table) -> pa.Table:
        links = sorted(_links_between(opened, members, least))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    return outside.toDF(*outside.columns).groupBy("family", "i", "j").cogroup(members.groupBy("family", "i", "j")).applyInArrow(run, "a binary, b binary")


def copy_links(docs: DataFrame, id_col: str, text_col: str, least: float = 0.8, shortest: int = 100) -> DataFrame:
    """i < j: links of texts whose word 4-grams have at least that Jaccard similarity.

    They join just the texts that all such pairs join; not all pairs are among them: copies give a star, and so do large groups.
    """
    texts = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= shortest)).select(F.col(id_col).alias("id"), F.lower(text_col).alias("lower"))
    first = checkpointed(texts.mapInArrow(_keys_and_counts, f"id {docs.schema[id_col].dataType.simpleString()}, key binary, set long, n int, bits binary, slice int, counts binary"))
    rows = first.where("slice is null").select("id", "key", "set", "n", "bits")
    reps = checkpointed(rows.groupBy("key", "set", "n").agg(F.min("id").alias("rep"), F.first("bits").alias("bits")))
    copies = rows.select("id", "key").join(reps.select("key", "rep"), "key").where("id <> rep").select(F.least("id", "rep").alias("i"), F.greatest("id", "rep").alias("j"))
    counts = np.zeros(CELLS, np.uint32)
    for r in first.where("slice is not null").groupBy("slice").applyInArrow(_sum_of_slice, "slice int, counts binary").collect():
        counts.reshape(SLICES, -1)[r["slice"]] = np.frombuffer(r["counts"], "<u4")
    parts = int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.sum(dtype=np.int64) * (1 - least) / POSTINGS + 1))
    dealt = texts.select("lower").mapInArrow(_prefixes(counts, parts, least), "part int, packed binary")
    tested = dealt.groupBy("part").applyInArrow(_candidates(least), "a long, b long, crowd boolean")
    tested = checkpointed(_sifted(tested.groupBy("a", "b").agg(F.bool_or("crowd").alias("crowd")), reps, least))
    sets = _wanted_sets(texts, tested.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(reps.select("key", "rep"), "key"))
    checked = checkpointed(_verified(tested, sets, least))
    near = checked.where("linked").select("a", "b")
    if not checked.where("crowd and not linked").isEmpty():
        near = near.unionByName(checkpointed(_family_links(checked, sets, least)))
    rep = lambda side, name: reps.select(F.col("key").alias(side), F.col("rep").alias(name))
    near = near.join(rep("a", "x"), "a").join(rep("b", "y"), "b").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).where("i < j")
    return checkpointed(near.unionByName(copies).distinct())


def copy_groups(docs: DataFrame, id_col: str, text_col: str, least: float = 0.8) -> DataFrame:
    """id, group (smallest id), size, of the texts that have a copy."""
    pairs = copy_links(docs, id_col, text_col, least)
    nodes = pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct()
    found = components(nodes, pairs.select(F.col("i").alias("a"), F.col("j").alias("b")))
    size = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(size, "component").select(F.col("id").alias(id_col), F.col("component").alias("group"), "size")


def expanded(members: DataFrame, groups: DataFrame, key: str, theme: str) -> DataFrame:
    """``members`` (theme, key) with all copies of each member."""
    own = members.join(groups.select(key, "group"), key).select(theme, "group").distinct()
    more = own.join(groups.select(F.col(key), "group"), "group").select(theme, key)
    return members.select(theme, key).union(more).distinct()
