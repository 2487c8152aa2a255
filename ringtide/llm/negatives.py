"""Hard negatives by cover trees over norm-augmented vectors (operator 11).

A shard's vectors get one more component that lifts all of them to the same norm, so
they lie on a sphere and a larger inner product is a smaller angle. The tree's nodes
are balls: the centres of a level are chosen farthest first, so they are apart by at
least the radius that they cover, and a parent's centre is a centre again below it.
An anchor's angle to a centre and the angle of the ball bound all inner products
inside from both sides. The descent goes best first and skips balls outside every
window; the rows of a leaf are scored in whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, written
from .knn import products, usable

#: Rows for which a shard is meant, rows of a leaf, and children of a ball at most.
SHARD_ROWS, LEAF_ROWS, FAN = 16_384, 256, 32
#: A ball is split until its children have at most this share of its radius, or FAN of them are made.
SHRINK = 0.5
SCALE = 256
#: What rounding can do to a bound, as a share of the two norms' product; a double holds 1e-16 of it.
SLACK = 1e-7
#: Anchors that descend a tree together.
BATCH_ROWS = 256
#: Scores below and above all others.
NONE, ANY = -(2**63 - 1), 2**63 - 1


class Cover:
    """Balls over rows: `centre` (a row), `radius`, `children` or `span` of rows in `order`, and the `pure` label or None."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        plain = rows.astype(np.float64)
        norms = (plain**2).sum(axis=1)
        self.norm = math.sqrt(norms.max()) if len(rows) else 0.0
        unit = self.norm or 1.0
        self.points = np.column_stack([plain, np.sqrt(np.maximum(norms.max() - norms, 0.0))]) / unit
        self.labels, self.order, self.nodes, self.placed = labels, [], [], 0
        self.add(np.arange(len(rows)), 0)
        self.order = np.concatenate(self.order)

    def add(self, members: np.ndarray, centre_at: int) -> int:
        """A ball around members[centre_at] and all below it; its number."""
        node = len(self.nodes)
        chord = np.sqrt(((self.points[members] - self.points[members[centre_at]])**2).sum(axis=1))
        here = self.labels[members]
        radius = float(chord.max())
        self.nodes.append({"centre": int(members[centre_at]), "radius": radius, "pure": int(here[0]) if (here == here[0]).all() else None, "children": None, "span": None})
        if len(members) <= LEAF_ROWS or radius == 0.0:
            self.order.append(members)
            self.nodes[node]["span"] = (self.placed, self.placed + len(members))
            self.placed += len(members)
            return node
        near, owner, chosen = chord.copy(), np.zeros(len(members), np.int64), [centre_at]
        while len(chosen) < FAN and near.max() > SHRINK * radius:
            far = int(np.argmax(near))
            distance = np.sqrt(((self.points[members] - self.points[members[far]])**2).sum(axis=1))
            closer = distance < near
            near[closer], owner[closer] = distance[closer], len(chosen)
            chosen.append(far)
        children = []
        for c, at in enumerate(chosen):
            mine = np.flatnonzero(owner == c)
            children.append(self.add(members[mine], int(np.searchsorted(mine, at))))
        self.nodes[node]["children"] = children
        return node


def tree_row(table: pa.Table) -> dict:
    """One shard as one row: its rows in the order of the leaves, and the arrays of its tree."""
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    order = np.lexsort((ids,))
    dim = table.column("dim")[0].as_py()
    rows = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, dim)[order]
    ids, labels = ids[order], labels[order]
    tree = Cover(rows, labels)
    nodes, none = tree.nodes, (0, 0)
    pack = {
        "rows": rows[tree.order], "ids": ids[tree.order], "labels": labels[tree.order],
        "centres": tree.points[[n["centre"] for n in nodes]][:, :dim], "radius": np.array([n["radius"] for n in nodes]),
        "mixed": np.array([n["pure"] is None for n in nodes]), "pure": np.array([n["pure"] or 0 for n in nodes], np.int64),
        "spans": np.array([n["span"] or none for n in nodes], np.int64), "norm": np.array([tree.norm]),
        "kids": np.array([c for n in nodes for c in n["children"] or []], np.int64), "n_kids": np.array([len(n["children"] or []) for n in nodes], np.int64),
    }
    return {name: np.ascontiguousarray(x).tobytes() for name, x in pack.items()}


KINDS = {"rows": np.int64, "ids": np.int64, "labels": np.int64, "centres": np.float64, "radius": np.float64, "mixed": np.bool_, "pure": np.int64,
         "spans": np.int64, "norm": np.float64, "kids": np.int64, "n_kids": np.int64}


class Searcher:
    """A shard's tree as it is read back."""

    def __init__(self, row: dict, dim: int):
        for name, kind in KINDS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.rows, self.centres, self.spans = self.rows.reshape(-1, dim), self.centres.reshape(-1, dim), self.spans.reshape(-1, 2)
        self.first_kid = np.concatenate([[0], np.cumsum(self.n_kids)])
        # the angle of a ball on the sphere: a chord of length r spans twice the arc sine of r / 2
        self.angle = 2.0 * np.arcsin(np.clip(self.radius / 2.0, 0.0, 1.0))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and ball the least and the largest inner product that a row inside can have."""
        plain = anchors.astype(np.float64)
        size = np.sqrt((plain**2).sum(axis=1))[:, None]
        turn = np.arccos(np.clip((plain @ self.centres.T) / np.where(size > 0, size, 1.0), -1.0, 1.0))
        span, slack = size * self.norm[0], SLACK * size * self.norm[0] + SLACK
        high = span * np.cos(np.maximum(turn - self.angle - SLACK, 0.0)) + slack
        low = span * np.cos(np.minimum(turn + self.angle + SLACK, np.pi)) - slack
        return low, high

    def search(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, same: bool, floors: np.ndarray, ceilings: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `k` rows of the same (or of other) labels for each anchor and window: scores (NONE: fewer) and ids.

        The anchors of a batch descend together, best first by the largest bound
        that any of them has; at every ball only those go on for which it is not
        outside all their windows, whose lower ends rise to the k-th score.
        """
        low, high = self.bounds(vectors)
        count, windows = floors.shape
        best, found = np.full((count, windows, k), NONE), np.zeros((count, windows, k), np.int64)
        floors, top = floors.copy(), ceilings.max(axis=1)
        todo = [(0.0, 0)]
        while todo:
            node = heapq.heappop(todo)[1]
            inside = ((high[:, node, None] >= floors) & (low[:, node, None] <= ceilings)).any(axis=1)
            if not self.mixed[node]:
                inside &= (labels == self.pure[node]) == same
            who = np.flatnonzero(inside)
            if not who.size:
                continue
            if self.n_kids[node]:
                kids = self.kids[self.first_kid[node]:self.first_kid[node + 1]]
                for bound, kid in zip(np.minimum(high[np.ix_(who, kids)], top[who, None]).max(axis=0).tolist(), kids.tolist(), strict=True):
                    heapq.heappush(todo, (-bound, kid))
                continue
            start, stop = self.spans[node]
            scores, rows = products(vectors[who], self.rows[start:stop]), self.ids[start:stop]
            fits = ((self.labels[None, start:stop] == labels[who, None]) == same) & (rows[None, :] != ids[who, None])
            for w in range(windows):
                good = fits & (scores >= floors[who, w, None]) & (scores <= ceilings[who, w, None])
                some = np.flatnonzero(good.any(axis=1))
                if not some.size:
                    continue
                mine, here = who[some], np.where(good[some], scores[some], NONE)
                first = np.argsort(-here, axis=1, kind="stable")[:, :k]  # the rows of a leaf ascend by id
                all_scores = np.concatenate([best[mine, w], np.take_along_axis(here, first, axis=1)], axis=1)
                all_ids = np.concatenate([found[mine, w], rows[first]], axis=1)
                order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                best[mine, w], found[mine, w] = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)
                floors[mine, w] = np.maximum(floors[mine, w], best[mine, w, k - 1])
        return best, found


def shard_of(label: Column, dim: Column, salt: Column, shards: Column) -> Column:
    """The shard of a label's `salt`-th part."""
    return F.pmod(F.xxhash64(label, dim, salt), shards).cast("int")


def hard_negatives(rows: DataFrame, asks: Column, positives: int = 5, negatives: int = 5, least: int = 80, percent: int = 100,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For every row where `asks` holds and each of its first positives, the first rows of other labels in the window.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. Components are floor(256 * x) as integers, a score is their
    product, ties go to the smaller id. Positives are the anchor's first
    `positives` other rows of its label; a negative's score lies between `least`
    and `percent` hundredths of the positive's (so a positive below zero has
    none). Null ids and labels and vectors that are null, empty or hold a null
    or non-finite component take no part. A vector meets only those of its own
    length. Rows that share an id are one row, that with the least label and
    then the least vector. An empty table, or one of one label, gives an empty
    table. Scores of 64 bits are exact; larger ones are refused. Only the named
    columns and the condition are looked at.
    """
    v = F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE))))
    found = columns_of(rows.withColumn("__asks", F.coalesce(asks, F.lit(False))), id_col, vector_col, label_col, "__asks").select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.col("__asks").alias("asks"))
    found = found.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).select("id", "label", v.alias("v"), "asks")
    found = found.groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r")).select("id", "r.*", F.size("r.v").alias("dim"))
    held = written(found, "vectors")
    # labels of many rows are cut into parts, and parts of all labels are dealt to shards: a label of any size is spread evenly
    labels = held.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / SHARD_ROWS).cast("int"))
    shards = labels.groupBy("dim").agg(F.ceil(F.sum("n") / SHARD_ROWS).cast("int").alias("shards"))
    plan = written(labels.join(shards, "dim").select("dim", "label", "parts", "shards"), "labels")
    salt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = held.join(plan, ["dim", "label"]).withColumn("shard", shard_of(F.col("label"), F.col("dim"), salt, F.col("shards")))
    names = list(KINDS)

    def build(table: pa.Table) -> pa.Table:
        row = tree_row(table)
        first = {"dim": pa.array([table.column("dim")[0].as_py()], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                 "only": pa.array([table.column("label")[0].as_py() if len(set(table.column("label").to_pylist())) == 1 else None], pa.int64())}
        return pa.table(first | {n: pa.array([row[n]], pa.binary()) for n in names})

    schema = "dim int, shard int, only long, " + ", ".join(f"{n} binary" for n in names)
    trees = written(dealt.select("dim", "shard", "id", "label", "v").groupBy("dim", "shard").applyInArrow(build, schema), "trees")
    anchors = written(held.where("asks").join(plan, ["dim", "label"]).select("id", "label", "v", "dim", "parts", "shards"), "anchors")

    def visit(queries: DataFrame, same: bool, k: int) -> DataFrame:
        """`queries` (id, label, v, dim, shard, floors, ceilings) against the trees of their shards.

        The rows of a shard stream through one task behind its tree, so a task
        holds one tree and one batch of anchors, however many there are.
        """
        blank = [F.lit(None).cast("binary").alias(n) for n in names]
        empty = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<long>").alias("v"),
                 F.lit(None).cast("array<long>").alias("floors"), F.lit(None).cast("array<long>").alias("ceilings")]
        both = trees.select("dim", "shard", F.lit(0).alias("turn"), *empty, *names).union(
            queries.select("dim", "shard", F.lit(1).alias("turn"), "id", "label", "v", "floors", "ceilings", *blank))
        sorted_rows = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "turn")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, at = None, None
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH_ROWS):
                    out: dict[str, list] = {"id": [], "window": [], "found": [], "score": []}
                    waiting: list[dict] = []
                    piece = batch.slice(start, BATCH_ROWS)
                    turns, dims, places = (piece.column(c).to_pylist() for c in ("turn", "dim", "shard"))
                    for i, turn in enumerate(turns):
                        if turn == 0:
                            answer(tree, waiting, out)
                            tree, at = Searcher({n: piece.column(n)[i].as_buffer() for n in names}, dims[i]), (dims[i], places[i])
                        elif at == (dims[i], places[i]):
                            waiting.append({c: piece.column(c)[i].as_py() for c in ("id", "label", "v", "floors", "ceilings")})
                    answer(tree, waiting, out)
                    yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["window"], pa.int32()), pa.array(out["found"], pa.int64()), pa.array(out["score"], pa.int64())], names=list(out))

        def answer(tree: Searcher | None, waiting: list[dict], out: dict[str, list]) -> None:
            if not waiting:
                return
            ids, labels = (np.array([q[c] for q in waiting], np.int64) for c in ("id", "label"))
            width = max(len(q["floors"]) if q["floors"] is not None else 1 for q in waiting)
            floors, ceilings = np.full((len(waiting), width), ANY), np.full((len(waiting), width), NONE)  # what is not set is an empty window
            for i, q in enumerate(waiting):
                if q["floors"] is None:
                    floors[i, 0], ceilings[i, 0] = NONE + 1, ANY
                else:
                    floors[i, :len(q["floors"])], ceilings[i, :len(q["ceilings"])] = q["floors"], q["ceilings"]
            best, found = tree.search(ids, np.array([q["v"] for q in waiting], np.int64), labels, same, floors, ceilings, k)
            at, window, place = np.nonzero(best > NONE)
            for name, values in zip(out, (ids[at], window, found[at, window, place], best[at, window, place]), strict=True):
                out[name] += values.tolist()
            waiting.clear()

        return sorted_rows.mapInArrow(task, "id long, window int, found long, score long")

    def first(partial: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("id", "window").orderBy(F.desc("score"), "found")
        return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    none = F.lit(None).cast("array<long>")
    parts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: shard_of(F.col("label"), F.col("dim"), s, F.col("shards"))))
    own = anchors.select("id", "label", "v", "dim", none.alias("floors"), none.alias("ceilings"), F.explode(parts).alias("shard"))
    near = written(first(visit(own, True, positives), positives).select("id", F.col("found").alias("positive"), F.col("score").alias("positive_score"), "rank"), "positives")
    # the windows of an anchor in the order of its positives: whole-number bounds of least <= 100 * score / positive <= percent
    window = F.struct("rank", F.expr(f"({least} * positive_score + 99) div 100").alias("floor"), F.expr(f"({percent} * positive_score) div 100").alias("ceiling"))
    windows = near.where("positive_score >= 0").groupBy("id").agg(F.sort_array(F.collect_list(window)).alias("w"))
    windows = windows.select("id", F.transform("w", lambda x: x["floor"]).alias("floors"), F.transform("w", lambda x: x["ceiling"]).alias("ceilings"), F.transform("w", lambda x: x["rank"]).alias("ranks"))
    asking = written(anchors.join(windows, "id"), "windows")
    everywhere = trees.select("dim", "shard", "only")
    other = asking.select("id", "label", "v", "dim", "floors", "ceilings", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    # shards that hold the anchor's label alone have no negatives
    other = other.join(F.broadcast(everywhere.where("only IS NOT NULL")) if everywhere.count() <= 1_000_000 else everywhere.where("only IS NOT NULL"),
                       ["dim", "shard"], "left").where("only IS NULL OR only <> label").drop("only")
    far = first(visit(other, False, negatives), negatives)
    named = far.join(asking.select("id", "ranks"), "id").withColumn("place", F.col("ranks")[F.col("window")]).select("id", "place", "rank", "found", "score")
    joined = named.join(near.select(F.col("id"), F.col("rank").alias("place"), "positive", "positive_score"), ["id", "place"])
    return joined.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"),
                         "positive_score", F.col("score").alias("negative_score"))
