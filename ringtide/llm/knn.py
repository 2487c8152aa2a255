"""Exact top-k by inner product with a KD-tree in every shard (operator 1).

A shard's rows are split at the median of the widest coordinate until leaves are
small; every node keeps the tight box of its rows. A query visits nodes in the
order of the largest score that their boxes allow and stops at a node that cannot
reach its k-th best score. That score is first found in one shard and then
carried to all others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, written

#: Rows of a shard, of a leaf, and queries that visit a shard together.
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 16_384, 256, 4096
SCALE = 1024


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T: in doubles while every partial sum is below 2**53, else in Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


class Tree:
    """A KD-tree over integer rows: leaves are slices of the rows in `order`."""

    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        self.low, self.high, self.children, self.span = [], [], [], []
        self.split(rows, 0, len(rows))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def split(self, rows: np.ndarray, start: int, stop: int) -> int:
        node, own = len(self.span), rows[self.order[start:stop]]
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.span.append((start, stop))
        self.children.append(None)
        if stop - start > LEAF_ROWS:
            widest = int(np.argmax(self.high[node] - self.low[node]))
            middle = (stop - start) // 2  # by place, not by value: equal rows are split as well
            self.order[start:stop] = self.order[start:stop][np.argpartition(own[:, widest], middle)]
            self.children[node] = (self.split(rows, start, start + middle), self.split(rows, start + middle, stop))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the largest product with a point of the node's box."""
        return products(np.maximum(queries, 0), self.high) + products(np.minimum(queries, 0), self.low)


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: list, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query its best rows here, as (score, id), of those that reach `least` (None: no bound); never its own id."""
    tree = Tree(rows)
    sorted_rows, sorted_ids = rows[tree.order], ids[tree.order]
    bounds = tree.bounds(queries)
    for n, (own, query) in enumerate(zip(query_ids, queries, strict=True)):
        bound = bounds[n]
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        kth = least[n]
        todo = [(-bound[0], 0)]
        while todo:
            top, node = heapq.heappop(todo)
            if kth is not None and -top < kth:
                break
            if tree.children[node]:
                for child in tree.children[node]:
                    if kth is None or bound[child] >= kth:
                        heapq.heappush(todo, (-bound[child], child))
                continue
            start, stop = tree.span[node]
            scores = products(query[None, :], sorted_rows[start:stop])[0]
            near = np.arange(len(scores)) if kth is None else np.flatnonzero(scores >= kth)
            for at in near:
                score, vec = int(scores[at]), int(sorted_ids[start + at])
                if vec == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -vec))
                elif (score, -vec) > best[0]:
                    heapq.heapreplace(best, (score, -vec))
            if len(best) == k and (kth is None or best[0][0] > kth):
                kth = best[0][0]
        yield n, [(s, -v) for s, v in best]


def usable(vector: Column) -> Column:
    """Vectors without null and non-finite components, of one component or more."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_k(rows: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `k` best other rows for every row where `query` holds: query_id, rank (from 1), vec_id, score.

    Components are floor(1024 * x) as integers; ties go to the smaller id. Null
    ids and unusable vectors take no part; a vector meets only those of its own
    length. Rows with the id of a query never answer it, and an id given twice
    asks once with each of its different vectors. Fewer than `k` others give fewer rows, an empty
    table none. Every row is in a tree, and every query visits every shard.
    """
    found = columns_of(rows, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), query.alias("asks"))
    found = found.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", "asks", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE)))).alias("v"))
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    held = written(found.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int")), "vectors")
    asking = held.where("asks").dropDuplicates(["id", "v"])
    blocks = max(1, math.ceil(asking.count() / QUERY_ROWS))
    asking = written(asking.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("row", F.xxhash64("id", "v")), "queries")

    def work(here: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if len(here) and len(queries):
            matrix, asked = np.array(here["v"].tolist(), np.int64), np.array(queries["v"].tolist(), np.int64)
            least = [None if pd.isna(x) else int(x) for x in queries["least"]]
            for n, best in search(here["id"].to_numpy(), matrix, queries["id"].to_numpy(), asked, least, k):
                for score, vec in best:
                    for name, value in zip(out, (queries["row"].iloc[n], queries["id"].iloc[n], vec, score), strict=True):
                        out[name].append(value)
        return pd.DataFrame(out).astype("int64")

    def visit(queries: DataFrame) -> DataFrame:
        """Queries (with `shard`, `block`, `least`) against the rows of that shard: a task for every shard and block."""
        here = held.select("id", "dim", "v", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).groupBy("shard", "block", "dim")
        there = queries.select("id", "row", "dim", "v", "shard", "block", "least").groupBy("shard", "block", "dim")
        return here.cogroup(there).applyInPandas(work, "row long, query_id long, vec_id long, score long")

    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    first = written(visit(asking.withColumn("shard", home).withColumn("least", F.lit(None).cast("long"))), "first-visit")
    kth = first.groupBy("row", F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select("row", "id", F.when(F.col("n") >= k, F.col("s")).alias("least"))
    others = asking.join(kth, ["row", "id"], "left").withColumn("home", home)
    others = others.select("id", "row", "dim", "v", "block", "least", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))).alias("shard")) if shards > 1 else None
    partial = first if others is None else first.union(visit(others))
    order = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
