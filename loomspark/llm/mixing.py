"""Mixing sources to target weights: packed blocks of words, drawn per output shard, joined by index.

Each source's documents, in a fixed order, are one stream of words, cut into blocks of a fixed length. The mix has slots,
equally many in each output shard; each slot takes one block.

1. How many slots of a shard draw from each source is multinomial with the targets as probabilities, under the condition
   that the sums over all shards are the sources' numbers of slots (independent draws would miss the targets by several
   per cent on small inputs). That law is the one of a random permutation of all slots, so :func:`shard_counts` puts
   every slot to its permuted place and counts, without a draw of one shard waiting for another's. The counts, with the
   first index of each, are a stored table: shard, source, count, first.
2. From that table alone, :func:`drawn` makes the slots: a source's indexes run through a pseudorandom permutation of its
   blocks, then through another, so no block is taken twice before each is taken once.
3. Blocks are joined by (source, index).

Permutations are keyed Feistel networks of the index, so they are computed, not stored, and reruns agree.

All is DataFrame work. Offsets of documents in their streams are prefix sums in two levels (a source may hold a third
of all rows); blocks are joined by (source, index), which no source makes hot.

Cases: a null text has no words; a document without words takes no part (``taken`` 0); a null source is a source of its
own, after the others; null ids and rows that repeat are placed like any others (equal rows are interchangeable); an
empty table gives an empty result; the output has only the id and the columns named here, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import prefix_sums, stored, table

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
#: Weights of the sources in order, repeating; share of all words that the mix has; most times a source is repeated.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Words in a block, slots in an output shard, slots that one row of the draw unfolds to.
BLOCK_WORDS, SHARD_SLOTS, UNFOLD = 64, 4096, 8192
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, for use where columns cannot be named."""
    return F.element_at(F.transform(F.array(value), f), 1)


def with_permuted(df: DataFrame, index: Column, size: Column, key: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``, a keyed permutation of 0 to ``size`` - 1 at ``index``.

    Indexes are pairs of digits, of bases a and b with a * b at least ``size``. Each round adds to one digit a hash of the
    other, which can be undone, so the rounds permute the pairs; a value past the end is put in again until it is inside
    (fewer than a values are outside, which bounds the loop). Each half round is a column of its own: an expression
    that holds all of them would double with each.
    """
    a, b, high, low = (F.col(f"__{c}") for c in "abhl")
    turn = lambda digit, other, base, n: F.pmod(digit + F.pmod(F.xxhash64(F.lit(n), *key, other), base), base)

    def again(x: Column) -> Column:
        pair = F.struct(F.call_function("div", x, b).alias("h"), F.pmod(x, b).alias("l"))
        for n in range(6):
            pair = bound(pair, _half(n))
        return bound(pair, lambda p: p["h"] * b + p["l"])

    def _half(n: int):
        if n % 2 == 0:
            return lambda p: F.struct(turn(p["h"], p["l"], a, n).alias("h"), p["l"].alias("l"))
        return lambda p: F.struct(p["h"].alias("h"), turn(p["l"], p["h"], b, n).alias("l"))

    root = F.ceil(F.sqrt(F.col("__size").cast("double"))).cast("long")
    df = df.withColumns({"__size": size, "__index": index}).withColumn("__a", root)
    df = df.withColumn("__a", F.when(a * a < F.col("__size"), a + 1).otherwise(a))
    df = df.withColumn("__b", F.call_function("div", F.col("__size") + a - 1, a))
    df = df.withColumns({"__h": F.call_function("div", F.col("__index"), b), "__l": F.pmod("__index", b)})
    for n in range(6):
        df = df.withColumn("__h", turn(high, low, a, n)) if n % 2 == 0 else df.withColumn("__l", turn(low, high, b, n))
    df = df.withColumn("__x", high * b + low)
    walked = F.aggregate(F.sequence(F.lit(0).cast("long"), a), F.col("__x"), lambda x, _: F.when(x < F.col("__size"), x).otherwise(again(x)))
    df = df.withColumn(out, F.when(F.col("__x") < F.col("__size"), F.col("__x")).otherwise(walked))
    return df.drop("__a", "__b", "__h", "__l", "__x", "__size", "__index")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target: as many words as the weights say, a source at most repeated.

    Sources with least to give for their weight fill up first; what they cannot take is dealt to the others by weight.
    One row per source, so the windows over all sources are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight)
    most = F.lit(float(repeats)) * F.col("source_size")
    rows = rows.withColumn("most", most).withColumn("ratio", F.col("most") / F.col("weight"))
    every = Window.partitionBy(F.lit(1))
    filling = Window.partitionBy(F.lit(1)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(filling), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    rows = rows.withColumn("level", rest / heavy)
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(every)
    target = F.least(F.col("most"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def planned(sizes: DataFrame, block_words: int = BLOCK_WORDS, **mix) -> DataFrame:
    """``targets`` with blocks, slots, the first slot's number among all, and the number of all slots."""
    rows = targets(sizes, **mix).withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round((F.col("target") - rounds * F.col("source_size")) / block_words).cast("long")
    rows = rows.withColumn("slots", rounds * F.col("blocks") + F.least(rest, F.col("blocks")))
    before = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn(
        "all_slots", F.sum("slots").over(Window.partitionBy(F.lit(1)))
    )


def shard_counts(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The draw: for each output shard and source, ``count`` slots, and ``first``, the source's indexes that earlier shards take."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(UNFOLD).cast("long"))).alias("chunk")
    chunks = plan.where("slots > 0").select("source", "slots", "first_slot", "all_slots", chunk)
    inside = F.sequence(F.col("chunk"), F.least(F.col("chunk") + UNFOLD, F.col("slots")) - 1)
    # A fixed number of partitions: rows that unfold to so many must not be put together for being few now.
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = chunks.repartition(parts, F.col("source"), F.col("chunk")).withColumn("rank", F.explode(inside))
    slots = with_permuted(slots, F.col("first_slot") + F.col("rank"), F.col("all_slots"), [F.lit(seed)], "place")
    counts = slots.groupBy(F.call_function("div", F.col("place"), F.lit(shard_slots)).alias("shard"), "source").agg(F.count("*").alias("count"))
    counts = stored(counts, "mix-counts")
    return stored(prefix_sums(counts, ["source"], ["shard"], "count", F.call_function("div", F.col("shard"), F.lit(UNFOLD)), "first"), "mix-draw")


def drawn(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Every slot of the mix: shard, position, source, block."""
    counts = shard_counts(plan, shard_slots, seed)
    # At most as many rows in a shard as there are sources.
    before = Window.partitionBy("shard").orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__at": F.coalesce(F.sum("count").over(before), F.lit(0)), "__slots": F.sum("count").over(Window.partitionBy("shard"))})
    sources = plan.select(F.col("source").alias("__source"), "blocks")
    counts = counts.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = counts.repartition(parts, F.col("shard"), F.col("source")).withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    slots = slots.withColumns({"index": F.col("first") + F.col("rank"), "__at": F.col("__at") + F.col("rank")})
    slots = slots.withColumn("turn", F.call_function("div", F.col("index"), F.col("blocks")))
    slots = with_permuted(slots, F.pmod("index", "blocks"), F.col("blocks"), [F.lit(seed), F.coalesce("source", F.lit("\x00")), F.col("turn")], "block")
    slots = with_permuted(slots, F.col("__at"), F.col("__slots"), [F.lit(seed + 1), F.col("shard")], "position")
    return slots.select("shard", "position", "source", "block")


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Each document's id, source, size, text hash, and start in its source's stream of words."""
    text = F.col(text_col).cast("string")
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie")
        ),
        "mix-rows",
    )
    buckets = max(1, int(rows.count() ** 0.5))
    return prefix_sums(rows, ["source"], ["doc_id", "size", "tie"], "size", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)), "start")


def _plan(rows: DataFrame, block_words: int, weights: dict) -> DataFrame:
    """:func:`planned` for streams, as a table of a row for each source."""
    return stored(planned(rows.groupBy("source").agg(F.sum("size").alias("source_size")), block_words, **weights), "mix-plan")


def _segments(rows: DataFrame, block_words: int) -> DataFrame:
    """A row for each document and block that it has words in."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words).cast("long"), last)))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return cut.withColumn("begin", begin).withColumn("words", end - begin)


def _named(frame: DataFrame) -> DataFrame:
    """``source`` and ``block`` under other names, for a join."""
    return frame.withColumnsRenamed({"source": "__source", "block": "__block"})


def _same_block() -> Column:
    return F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block"))


def _taken(rows: DataFrame, plan: DataFrame, block_words: int, seed: int) -> DataFrame:
    """:func:`_segments` with ``times``, how often the mix takes their block (null for never)."""
    # A table of its own, so that the plan which handles texts holds no permutation.
    times = _named(stored(drawn(plan, seed=seed).groupBy("source", "block").agg(F.count("*").alias("times")), "mix-times"))
    # Slots grow with the input, and the planner takes what was unfolded for small: no broadcast.
    return _segments(rows, block_words).join(times.hint("merge"), _same_block(), "left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED, **weights) -> DataFrame:
    """One row per document: doc_id, source, size, tie, source_size, target, taken (words the mix takes of it)."""
    rows = stored(_streams(docs, id_col, text_col, source_col), "mix-streams")
    plan = _plan(rows, block_words, weights)
    took = _taken(rows, plan, block_words, seed)
    took = took.groupBy("doc_id", "source", "size", "tie", "start").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    took = took.drop("start").unionByName(rows.where("size = 0").select("doc_id", "source", "size", "tie", F.lit(0).cast("long").alias("taken")))
    sources = plan.select(F.col("source").alias("__source"), "source_size", "target")
    return took.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, **weights) -> DataFrame:
    """The mix itself: shard, position, source, block, text (the block's words, single-spaced)."""
    rows = stored(_streams(docs, id_col, text_col, source_col), "mix-streams")
    plan = _plan(rows, block_words, weights)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__tie"), text.alias("__text")).dropDuplicates(["__id", "__tie"])
    cut = _segments(rows, block_words).join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")))
    piece = F.array_join(F.slice(F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)), (F.col("begin") - F.col("start") + 1).cast("int"), F.col("words").cast("int")), " ")
    packed = cut.select("source", "block", "begin", piece.alias("piece")).groupBy("source", "block")
    packed = packed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return drawn(plan, shard_slots, seed).join(_named(packed).hint("merge"), _same_block()).drop("__source", "__block")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED, **weights) -> DataFrame:
    """``docs`` as the mix takes them, with their columns: the n-th copy of a document has the words of those of its blocks
    that are drawn n times or more, in their order and with the space after them; one that has all words is left as it is."""
    rows = stored(_streams(docs, id_col, text_col, source_col), "mix-streams")
    plan = _plan(rows, block_words, weights)
    piece = F.struct((F.col("block") - F.call_function("div", F.col("start"), F.lit(block_words))).cast("int").alias("at"), F.col("words").cast("int").alias("words"), "times")
    took = _taken(rows, plan, block_words, seed).where("times > 0").groupBy("doc_id", "source", "tie", "start", "size").agg(F.array_sort(F.collect_list(piece)).alias("__pieces"))
    # Rows equal in id, source and text have places of their own in the stream, and are dealt to them by number.
    same = Window.partitionBy("doc_id", "source", "tie").orderBy("start")
    repeated = not rows.groupBy("doc_id", "source", "tie").count().where("count > 1").isEmpty()
    if repeated:
        numbers = rows.where("size > 0").select("doc_id", "source", "tie", "start", F.row_number().over(same).alias("__number"))
        keys = ["doc_id", "source", "tie", "start"]
        on = [F.col(c).eqNullSafe(F.col(f"__n_{c}")) for c in keys]
        took = took.join(numbers.withColumnsRenamed({c: f"__n_{c}" for c in keys}), on).drop(*[f"__n_{c}" for c in keys])
    else:
        took = took.withColumn("__number", F.lit(1))
    # A struct is never null, and structs are equal where their fields are, nulls included.
    took = took.select(F.struct("doc_id", "source", "tie").alias("__own"), F.col("size").alias("__size"), F.col("start").alias("__start"), "__pieces", F.col("__number").alias("__place"))
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("tie"))
    marked = docs.withColumn("__key", key)
    others = [F.col(c).cast("string") for c in docs.columns if c != text_col]
    number = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*others))) if repeated else F.lit(1)
    joined = marked.withColumn("__number", number).join(took, (F.col("__key") == F.col("__own")) & (F.col("__number") == F.col("__place")))
    most = F.array_max(F.transform("__pieces", lambda x: x["times"])).cast("int")
    joined = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), most)))
    joined = joined.withColumn("__pieces", F.filter("__pieces", lambda x: x["times"] >= F.col("__copy")))
    # A text falls into the words that its first block has, then as many as a block each: never an array of single words.
    first = F.least(F.lit(block_words) - F.pmod("__start", F.lit(block_words)), F.col("__size"))
    head = F.call_function("regexp_extract", text, F.concat(F.lit(f"^{SPACE}+(?:{WORD}+{SPACE}+){{"), first.cast("string"), F.lit("}+")), F.lit(0))
    joined = joined.withColumn("__head", head)
    tail = F.regexp_extract_all(F.substr(text, F.length("__head") + 1), F.lit(f"(?:{WORD}+{SPACE}+){{1,{block_words}}}+"), F.lit(0))
    joined = joined.withColumn("__parts", F.concat(F.array(F.regexp_replace("__head", "^" + SPACE, "")), tail))
    cut = F.array_join(F.transform("__pieces", lambda x: F.element_at("__parts", x["at"] + 1)), "")
    left = F.aggregate("__pieces", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    out = joined.withColumn(text_col, F.when(left < F.col("__size"), F.regexp_replace(cut, SPACE + r"\z", "")).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
