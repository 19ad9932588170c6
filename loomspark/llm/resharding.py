"""Minimum-cost-flow resharding: from old shards to new capacities with the fewest bytes moved.

The old shards' sizes and the new shards' capacities make a transport network: a byte that stays in its shard costs
nothing, a byte that moves costs one. Its cheapest flow, found by successive shortest paths over shards (never over
rows), says how many bytes each shard sends to which. Documents carry the flow out: in each old shard they lie in order
of size, largest first, and the transfers cut that line into intervals. So the large documents stay, and cuts fall
among small ones, which keeps the new sizes near the capacities. Then only the files of shards that send or receive are
written.

Positions on that line, and slots in the new shards, are prefix sums in two levels, so no task sorts a shard.

Cases: a null text has no bytes (size 16 with the overhead, crc32 of the empty text); a null id is hashed as an empty
one; rows that repeat are placed each (equal rows are interchangeable); an empty table gives an empty result and no
transfers; the output has only the id and the columns named here, so others cannot clash. A document larger than a
whole shard's capacity is still put whole into one shard.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import prefix_sums, stored, table, text_of

#: Bytes that a document takes besides its text; shards before and after in the query.
OVERHEAD, OLD_SHARDS, NEW_SHARDS = 16, 32, 40


def cheapest_flow(supply: list[int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, bytes) of least cost, staying included; total capacity must reach total supply.

    Successive shortest paths on the residual network of shards. Costs are 0 (stay) and 1 (move), so a path is found by
    a search that puts free edges first. The work depends on the numbers of shards only.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards cannot hold the old ones")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost; the reverse of edge e is e ^ 1
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        at[a].append(len(edges))
        edges.append([b, room, cost])
        at[b].append(len(edges))
        edges.append([a, 0, -cost])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, int(i != j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    while True:
        cost: list[float] = [float("inf")] * (n + m + 2)
        by: list[int] = [-1] * (n + m + 2)
        cost[source], line = 0, deque([source])
        waiting = {source}
        while line:
            a = line.popleft()
            waiting.discard(a)
            for e in at[a]:
                b, room, price = edges[e]
                if room > 0 and cost[a] + price < cost[b]:
                    cost[b], by[b] = cost[a] + price, e
                    if b not in waiting:
                        waiting.add(b)
                        (line.append if price else line.appendleft)(b)
        if by[sink] < 0:
            break
        path, b = [], sink
        while b != source:
            path.append(by[b])
            b = edges[by[b] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    flows = []
    for i in range(n):
        for e in at[i]:
            to, _, _ = edges[e]
            if e % 2 == 0 and n <= to < n + m and edges[e ^ 1][1] > 0:
                flows.append((i, to - n, edges[e ^ 1][1]))
    return flows


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def size_band(size: Column) -> Column:
    """A number that falls as ``size`` grows: 16 bands for each doubling."""
    return -F.floor(F.log2(size.cast("double")) * 16).cast("long")


def _ordered(rows: DataFrame, group: list[str], amount: str, out: str, by_size: bool) -> DataFrame:
    """Prefix sums with buckets small enough for any number of rows."""
    parts = max(1, int((rows.count() / 64) ** 0.5))
    spread = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts))
    bucket = F.struct(size_band(F.col("size")).alias("band"), spread.alias("part")) if by_size else F.struct(spread.alias("part"))
    return prefix_sums(rows, group, [F.col("size").desc(), "doc_id", "text_crc32"] if by_size else ["doc_id", "text_crc32"], amount, bucket, out)


def reshard(rows: DataFrame, capacities: list[int] | None = None, shards: int = NEW_SHARDS) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``rows`` (doc_id, size, text_crc32, old_shard) with shard, and the flow; capacities are even unless given.

    ``old_shard`` counts from 0. Rows are read several times; give a stored table.
    """
    sizes = {r["old_shard"]: r["bytes"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
    supply = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    flow = cheapest_flow(supply, capacities or even_capacities(sum(supply), shards))
    # Staying bytes come first on each old shard's line: they take the largest documents.
    cuts: dict[int, list[tuple[int, int]]] = {}
    for i, j, amount in sorted(flow, key=lambda f: (f[0], f[0] != f[1], f[1])):
        line = cuts.setdefault(i, [])
        line.append(((line[-1][0] if line else 0) + amount, j))
    # By old shard, the ends of the intervals and the shards they go to: a table as long as the number of old shards.
    kind = "array<struct<upto: bigint, to: int>>"
    lines = F.create_map(*[x for i, line in cuts.items() for x in (F.lit(i), F.array(*[F.struct(F.lit(e).cast("long").alias("upto"), F.lit(j).alias("to")) for e, j in line]))]) if cuts else F.lit(None).cast(f"map<int, {kind}>")
    placed = _ordered(rows, ["old_shard"], "size", "offset", by_size=True)
    middle = F.col("offset") + F.floor(F.col("size") / 2).cast("long")
    line = F.element_at(lines, F.col("old_shard"))
    goes = F.coalesce(F.element_at(F.filter(line, lambda x: x["upto"] > middle), 1), F.element_at(line, -1))
    return placed.withColumn("shard", goes["to"]).drop("offset"), flow


def sized(docs: DataFrame, old_shard: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, old_shard of every row."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard")
    )


def assignment(docs: DataFrame, shards: int = NEW_SHARDS, old_shards: int = OLD_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard: documents that lie in ``old_shards`` shards by
    a hash of their id are dealt anew to ``shards`` of near equal bytes."""
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    rows = stored(sized(docs, F.pmod(F.crc32(id_text), F.lit(old_shards)), id_col, text_col), "reshard-rows")
    # Documents cannot be cut, so a shard may end half a document from its capacity. A second, small flow evens that out
    # with the smallest documents, which are last on each line.
    first = stored(reshard(rows, shards=shards)[0].withColumnRenamed("old_shard", "from_shard"), "reshard-first")
    placed = reshard(first.withColumnRenamed("shard", "old_shard"), shards=shards)[0].drop("old_shard").withColumnRenamed("from_shard", "old_shard")
    placed = stored(placed.withColumn("one", F.lit(1).cast("long")), "reshard-placed")
    slots = _ordered(placed, ["shard"], "one", "slot", by_size=False)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def rewrite(spark: SparkSession, old_path: str, new_path: str, capacities: list[int], id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> list[int]:
    """Reshard a Parquet dataset partitioned by ``shard_col``; the files of affected shards only are written to ``new_path``.

    Returns the shards written; those absent from it and from the new capacities' flow keep their old files as they are.
    """
    docs = spark.read.parquet(old_path)
    rows = stored(sized(docs, F.col(shard_col), id_col, text_col), "reshard-rows")
    placed, flow = reshard(rows, capacities)
    affected = sorted({x for i, j, _ in flow if i != j for x in (i, j)})
    place = placed.where(F.col("shard").isin(affected)).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("old_shard").alias("__old"), F.col("shard").alias("__to"))
    # Rows that are equal in these are interchangeable, but each goes to a place of its own: they are dealt by number.
    place = place.withColumn("__place", F.row_number().over(Window.partitionBy("__id", "__crc", "__old").orderBy("__to")))
    held = docs.where(F.col(shard_col).isin(affected)).withColumn("__text", F.crc32(text_of(text_col).cast("binary")))
    others = [F.col(c).cast("string") for c in docs.columns if c != text_col]
    held = held.withColumn("__number", F.row_number().over(Window.partitionBy(id_col, "__text", shard_col).orderBy(F.xxhash64(*others))))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__crc")) & (F.col(shard_col) == F.col("__old")) & (F.col("__number") == F.col("__place"))
    moved = held.join(place, same).drop("__id", "__crc", "__old", "__text", "__number", "__place", shard_col).withColumnRenamed("__to", shard_col)
    moved.repartition(shard_col, F.pmod(F.xxhash64(id_col), F.lit(8))).write.mode("overwrite").partitionBy(shard_col).parquet(new_path)
    return affected


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment(table(spark, sf_dir, "documents"))
