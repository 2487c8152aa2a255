"""Resharding that moves the fewest bytes (operator 3).

Old shards and new capacities form a flow network in which staying costs
nothing and moving costs a unit for each byte. Its cheapest flow says how many
bytes every old shard keeps and sends where. The documents of an old shard stand
in a fixed order; the flow cuts that order into blocks, one for each receiver.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, columns_of, running, sums_before

#: Bytes that a document counts beside its text.
OVERHEAD = 8


def cheapest_transfers(sizes: list[int], capacities: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at the least total cost.

    Shortest augmenting paths on a network of source, old shards, new shards and
    sink; it has a node per shard, whatever the number of documents.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards cannot hold all bytes")
    old, new = len(sizes), len(capacities)
    source, sink = old + new, old + new + 1
    room: dict[int, dict[int, int]] = {v: {} for v in range(old + new + 2)}
    price: dict[tuple[int, int], int] = {}

    def edge(u: int, v: int, capacity: int, unit: int) -> None:
        room[u][v], price[u, v] = capacity, unit
        room[v].setdefault(u, 0)
        price[v, u] = -unit

    for i, size in enumerate(sizes):
        edge(source, i, size, 0)
        for j in range(new):
            edge(i, old + j, size, cost(i, j))
    for j, capacity in enumerate(capacities):
        edge(old + j, sink, capacity, 0)
    while True:
        best, came, queue, waiting = {source: 0}, {}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for v, left in room[u].items():
                if left and best[u] + price[u, v] < best.get(v, float("inf")):
                    best[v], came[v] = best[u] + price[u, v], u
                    if v not in waiting:
                        waiting.add(v)
                        queue.append(v)
        if sink not in came:
            break
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        amount = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= amount
            room[v][u] += amount
    return {(i, j): room[old + j][i] for i in range(old) for j in range(new) if room[old + j][i]}


def equal_capacities(total: int, shards: int) -> list[int]:
    """`total` in parts that differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text and OVERHEAD; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def old_shard(text: Column, shards: int) -> Column:
    """Where a document lay before: by its text, so that equal texts lay together."""
    return F.pmod(F.xxhash64(text), F.lit(shards)).cast("int")


def place(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", old: Column | None = None, old_shards: int = 16, carry: bool = False) -> DataFrame:
    """New place of every row: doc_id, size, text_crc32, old, shard, slot.

    `old` names the shard from 0 to `old_shards` - 1 in which a row lies now.
    Shards get equal sizes, but for the document at each cut; `slot` counts
    from 0 in each shard. Equal texts stand together in the order that is cut.
    Null ids, repeated rows, null and empty texts are rows like others; ties in
    order are between equal rows. An empty table gives an empty table. With
    `carry`, all columns of `docs` follow in a struct `row`.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    old = old_shard(text, old_shards) if old is None else old
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("__h"), old.cast("int").alias("old"), *whole)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "old", "__h", "doc_id").sortWithinPartitions("old", "__h", "doc_id")
    placed = running(ordered, "old", "size", "resharding")

    sizes = [0] * old_shards
    for r in placed.groupBy("old").agg(F.sum("size").alias("bytes")).collect():  # a row per old shard
        sizes[r["old"]] = r["bytes"]
    flow = cheapest_transfers(sizes, equal_capacities(sum(sizes), shards))
    cuts = []
    for i in range(old_shards):
        own = sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j))
        starts = [sum(flow[i, x] for x in own[:n]) for n in range(len(own))]
        cuts.append((i, starts, own))
    table = spark.createDataFrame(cuts, "old int, starts array<long>, shards array<int>")
    shard = F.element_at("shards", F.size(F.filter("starts", lambda s: s <= F.col("__before"))))
    moved = checkpointed(placed.join(F.broadcast(table), "old").withColumn("shard", shard).drop("starts", "shards"))  # a row per old shard

    counts = moved.groupBy("shard", "old", "__part").agg(F.count(F.lit(1)).alias("n"))
    base = sums_before(counts, ["shard"], ["old", "__part"], "n", "__base").drop("n")
    inside = Window.partitionBy("shard", "old", "__part").orderBy("__before")
    numbered = moved.withColumn("__n", F.row_number().over(inside) - 1).join(base, ["shard", "old", "__part"])
    return numbered.select("doc_id", "size", "text_crc32", "old", "shard", (F.col("__base") + F.col("__n")).alias("slot"), *(["row"] if carry else []))


def rewrite_affected(docs: DataFrame, folder: str, shards: int, old: Column, old_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards whose rows change, as ``folder/shard=j``, in the order of their slots.

    Returns shard, `rows`, `bytes` and `rewritten`; a shard that keeps exactly its rows is not written again.
    """
    placed = place(docs, shards, id_col, text_col, old, old_shards, carry=True)
    came = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.max(F.when(F.col("old") != F.col("shard"), 1).otherwise(0)).alias("came"))
    left = placed.where("old <> shard").select(F.col("old").alias("shard")).distinct().withColumn("left", F.lit(1))
    state = checkpointed(came.join(left, "shard", "full").select(
        "shard", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.coalesce("came", F.lit(0)) + F.coalesce("left", F.lit(0)) > 0).alias("rewritten")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written_rows = placed.join(state.where("rewritten").select("shard"), "shard", "left_semi")
    ordered = written_rows.repartitionByRange(max(parts, shards), "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("shard", "slot", "row.*").write.partitionBy("shard").mode("overwrite").parquet(folder)
    return state


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """What the query returns, under the law `bytes`."""
    placed = place(columns_of(docs, "doc_id", "text"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old")
