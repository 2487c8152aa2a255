"""Exact Jaccard join of documents by their n-grams, as a blocked sparse product (operator 12).

Documents are the rows and n-grams the columns of an incidence matrix A; A times its
transpose holds the overlaps. Sizes bound what must be multiplied: two sets of sizes
m <= n are linked only if m >= 0.8 n and if they share a column among the first
n - ceil(0.8 n) + 1 of each, in one order of all columns. Frequent columns come last
in that order. The product over these columns adds up overlaps pair by pair, and a
pair that cannot reach its bound with what is left of its sets is discarded; the rest
is counted on the full sets. Columns of many documents are not multiplied pair by
pair: every document is first compared with one of them, which joins groups of copies.
What is still apart is multiplied pair by pair in columns of bounded size, and in larger
ones in dense blocks of documents, column block by column block, until no pair of the
block can reach its bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, columns_of, written
from .components import components, merged
from .neardup import few, labelled, sets_of, shingle_set

#: The least similarity in hundredths.
PERCENT = 80
#: Share of the columns, by hash, from which prefixes are taken first; documents with too few of them go on with the others.
SHARE = 0.3
RANGE = np.uint64(int(SHARE * 2**64))
#: A column of more documents than this is frequent; of at most so many columns it is kept which ones they are
#: (the most frequent ones). Both move columns to the end of the order and change no result.
FREQUENT, MOST_FREQUENT = 32, 1 << 18
#: Documents of a column up to which those of different components are multiplied pair by pair; beyond, block by block.
MEDIUM = 512
#: Documents of a block at most, entries of a block's sets in all, and columns that a block multiplies at a time.
BLOCK, ENTRIES, COLUMNS = 1024, 1 << 18, 2048
#: Earlier regions that are tried as the one that holds all documents of a region.
EARLIER = 4
#: Documents that a worker turns into sets or postings at a time.
SLICE = 512


def need(m, n):
    """The least overlap of two sets of sizes m and n that links them."""
    return -(-PERCENT * (m + n) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    """Columns of a set of n, first in the order, of which every linked set holds one among its own."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def first_columns(shingles: np.ndarray) -> np.ndarray:
    """The columns of a set that can be in its prefix: all below RANGE, and what a prefix needs beyond."""
    return shingles[:max(int(np.searchsorted(shingles, RANGE)), prefix_length(len(shingles)))]


def sliced_task(df: DataFrame, schema: str, work) -> DataFrame:
    """`work` on slices of SLICE rows, which bound what a worker holds."""

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                out = work(batch.slice(start, SLICE))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return df.mapInArrow(task, schema)


def incidence(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, `same` (hash of the set; null if empty), `cols` (its first columns)."""

    def work(batch: pa.RecordBatch) -> dict:
        sizes, same, cols = [], [], []
        for text in batch.column(1):  # one text and one set at a time
            found = shingle_set(text.as_py())
            sizes.append(len(found))
            same.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            cols.append(first_columns(found).view(np.int64).copy())
        return {"doc_id": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "same": pa.array(same, pa.binary()), "cols": pa.array(cols, pa.list_(pa.int64()))}

    return sliced_task(docs.select(id_col, text_col), "doc_id long, n_shingles long, same binary, cols array<long>", work)


def frequent_columns(nodes: DataFrame) -> np.ndarray:
    """The columns of more than FREQUENT documents, the most frequent ones if there are too many; sorted."""
    counts = nodes.select(F.explode("cols").alias("col")).groupBy("col").count().where(F.col("count") > FREQUENT)
    counts = checkpointed(counts.select("col", F.floor(F.log2("count")).cast("int").alias("power")))
    least, total = math.inf, 0
    for power, n in sorted(((r["power"], r["n"]) for r in counts.groupBy("power").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if total + n > MOST_FREQUENT:
            break
        least, total = power, total + n
    found = counts.where(F.col("power") >= least).select("col").toPandas() if total else None
    return np.sort(found["col"].to_numpy(np.int64)) if found is not None else np.zeros(0, np.int64)


def postings(nodes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """`col`, `node`, `n` (size of its set) and `hot` (the column is frequent) for the prefix of every node (`node`, `n`, `cols`)."""

    def work(batch: pa.RecordBatch) -> dict:
        lists, n = batch.column(2), batch.column(1).to_numpy()
        lengths = lists.value_lengths().to_numpy()
        col = np.asarray(lists.flatten())
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.minimum(np.searchsorted(frequent, col), max(len(frequent) - 1, 0))
        hot = frequent[at] == col if len(frequent) else np.zeros(len(col), bool)
        beyond = col.view(np.uint64) >= RANGE
        order = np.lexsort((col.view(np.uint64), np.where(beyond, 2, hot), row))
        place = np.arange(len(col)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        kept = order[place < np.array([prefix_length(int(x)) for x in n])[row]]
        return {"col": pa.array(col[kept]), "node": pa.array(batch.column(0).to_numpy()[row[kept]]), "n": pa.array(n[row[kept]].astype(np.int32)), "hot": pa.array(hot[kept])}

    return sliced_task(nodes.select("node", "n", "cols"), "col long, node long, n int, hot boolean", work)


def partial_products(columns: DataFrame, apart: str = "true") -> DataFrame:
    """Pairs (`a`, `b`) that share columns of `columns` and can reach their bound, with the `overlap` inside these columns.

    What a set has outside its prefix can be shared as well, and no more. A pair
    that also shares a larger column is met there, so the sum need not know of it.
    `apart` is a condition on the two documents (`x`, `y`).
    """
    pairs = columns.alias("x").join(columns.alias("y"), "col").where(
        f"x.node < y.node AND 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) AND {apart}")
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("m"), F.col("y.n").alias("n"))
    overlap = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"), F.first("m").alias("m"), F.first("n").alias("n"))
    beyond = f"greatest(({PERCENT} * m + 99) div 100, ({PERCENT} * n + 99) div 100) - 1"
    return overlap.where(f"overlap + {beyond} >= ({PERCENT} * (m + n) + {99 + PERCENT}) div {100 + PERCENT}").select("a", "b", "overlap")


def only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of `nodes`; the others, most of them after the first links, need not be shuffled."""
    return sets.join(few(checkpointed(nodes.distinct())), "node", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (`a`, `b`) whose full sets overlap enough."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = only(sets, pairs.select(F.col("b").alias("node"))).select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = x.join(few(pairs.select("a", "b")), "a").join(y, "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("s"))
    return checkpointed(counted.where(f"{100 + PERCENT} * o >= {PERCENT} * s").select("a", "b").distinct())


def block_product():
    """Links between two blocks of documents (or inside one), as a function of an Arrow table: the dense product of their sparse rows."""
    percent, width = PERCENT, COLUMNS

    def work(table: pa.Table) -> pa.Table:
        node, comp, left, right = (table.column(c).to_numpy() for c in ("node", "comp", "left", "right"))
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lengths, flat = lists.value_lengths().to_numpy().astype(np.int64), np.asarray(lists.flatten())
        owner = np.repeat(np.arange(len(node)), lengths)
        x, y = np.flatnonzero(left), np.flatnonzero(right)
        place_x, place_y = np.full(len(node), -1), np.full(len(node), -1)
        place_x[x], place_y[y] = np.arange(len(x)), np.arange(len(y))
        bound = -(-percent * (lengths[x][:, None] + lengths[y][None, :]) // (100 + percent))
        alive = (comp[x][:, None] != comp[y][None, :]) & (100 * np.minimum(lengths[x][:, None], lengths[y][None, :]) >= percent * np.maximum(lengths[x][:, None], lengths[y][None, :]))
        overlap = np.zeros(alive.shape, np.float32)
        # columns that both sides hold, numbered from the most frequent one: pairs of little overlap fall early
        cols, number, size = np.unique(flat, return_inverse=True, return_counts=True)
        both = np.zeros(len(cols), bool)
        both[np.intersect1d(number[place_x[owner] >= 0], number[place_y[owner] >= 0])] = True
        both &= size > 1
        rank = np.full(len(cols), -1)
        order = np.flatnonzero(both)[np.argsort(-size[both], kind="stable")]
        rank[order] = np.arange(len(order))
        at = rank[number]
        by_rank = np.argsort(at, kind="stable")
        by_rank = by_rank[np.searchsorted(at[by_rank], 0):]
        left_x, left_y = np.bincount(place_x[owner[by_rank]][place_x[owner[by_rank]] >= 0], minlength=len(x)), np.bincount(place_y[owner[by_rank]][place_y[owner[by_rank]] >= 0], minlength=len(y))
        for start in range(0, len(order), width):
            alive &= overlap + np.minimum(left_x[:, None], left_y[None, :]) >= bound
            if not alive.any():
                break
            here = by_rank[slice(*np.searchsorted(at[by_rank], (start, start + width)))]
            matrices = []
            for place, rest in ((place_x, left_x), (place_y, left_y)):
                rows, own = place[owner[here]], place[owner[here]] >= 0
                dense = np.zeros((len(rest), width), np.float32)
                dense[rows[own], at[here[own]] - start] = 1.0
                rest -= np.bincount(rows[own], minlength=len(rest))
                matrices.append(dense)
            overlap += matrices[0] @ matrices[1].T
        alive &= overlap >= bound
        # a link for each two components here, not for each pair
        links, parent = [], {}

        def top(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        for p, q in zip(*(i.tolist() for i in np.nonzero(alive)), strict=True):
            u, v = top(int(comp[x[p]])), top(int(comp[y[q]]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                links.append((int(node[x[p]]), int(node[y[q]])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return work


def block_links(members: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (`a`, `b`) between the components of every region (`col`, `class`) of `members` (with `node`); none is lost.

    Documents outside a region's largest component are dealt to blocks and meet
    all blocks; those of the largest component are linked already and meet only
    the others. A task holds two blocks, whose sets have a bounded number of entries.
    """
    now = labelled(members, comp, "node").withColumnRenamed("node_comp", "comp")
    sizes = now.groupBy("col", "class", "comp").agg(F.count(F.lit(1)).alias("n"))
    chief = sizes.groupBy("col", "class").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("chief"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most < all")
    held = F.greatest(F.least(F.floor(ENTRIES / F.pow(F.lit(100 / PERCENT), F.col("class") + 2)), F.lit(BLOCK)), F.lit(1))  # by the largest size of the class
    blocks = chief.select("col", "class", "chief", F.ceil((F.col("all") - F.col("most")) / held).cast("int").alias("outer"), F.ceil(F.col("most") / held).cast("int").alias("inner"))
    dealt = now.join(blocks, ["col", "class"]).withColumn("main", F.col("comp") == F.col("chief"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    # a meeting is a block i of the others (left) with a block j of the others, or with a block -1 - j of the largest component
    others, largest = F.sequence(F.lit(0), F.col("outer") - 1), F.sequence(F.lit(0), F.col("inner") - 1)
    met = F.struct
    as_main = F.transform(others, lambda i: met(i.alias("i"), (-1 - F.col("block")).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    as_other = F.concat(
        F.transform(others, lambda o: met(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"), (F.col("block") <= o).alias("left"), (F.col("block") >= o).alias("right"))),
        F.transform(largest, lambda m: met(F.col("block").alias("i"), (-1 - m).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))))
    spread = dealt.select("col", "class", "node", "comp", F.explode(F.when(F.col("main"), as_main).otherwise(as_other)).alias("m")).select("*", "m.*").drop("m")
    full = spread.join(only(sets, dealt.select("node")), "node")
    return full.groupBy("col", "class", "i", "j").applyInArrow(block_product(), "a long, b long")


def needed(members: DataFrame) -> DataFrame:
    """`members` (`col`, `class`, `node`, `leader`, `size`) without the regions all of whose documents are in one earlier region.

    A pair of such a region meets in the earlier one. Documents of a shared
    passage lie in nested regions, of which one is left. An earlier region is
    looked for among the first ones of the leader.
    """
    order = F.struct((F.col("col") < 0).alias("beyond"), "col")
    firsts = members.groupBy("node", "class").agg(F.slice(F.sort_array(F.collect_set(order)), 1, EARLIER).alias("firsts"))
    regions = members.select("col", "class", F.col("leader").alias("node"), "size", order.alias("own")).distinct()
    tried = regions.join(firsts, ["node", "class"]).select("col", "class", "size", F.explode(F.filter("firsts", lambda f: f < F.col("own"))["col"]).alias("other"))
    inside = members.select("col", "class", "node").join(tried, ["col", "class"]).join(members.select(F.col("col").alias("other"), "class", "node"), ["other", "class", "node"])
    covered = inside.groupBy("col", "class", "other").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("n = size").select("col", "class").distinct()
    return members.join(covered, ["col", "class"], "left_anti")


def node_links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Components (`node`, `comp`) of the nodes that have links. `nodes`: node, n, cols."""
    posted = postings(nodes, frequent_columns(nodes))
    # columns known to be frequent are counted in parts and never gathered; the others are gathered by column
    of_column = Window.partitionBy("col")
    rare = posted.where("NOT hot").select("col", "node", "n", F.count(F.lit(1)).over(of_column).alias("size")).where("size > 1")
    hot = written(posted.where("hot"), "postings", compression="zstd")
    hot_sizes = hot.groupBy("col").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = checkpointed(rare.union(hot.join(few(checkpointed(hot_sizes)), "col").select("col", "node", "n", "size")))
    # first one pair for each node, that of the largest overlap, which joins what is alike
    large = shared.where(F.col("size") > FREQUENT)
    stars = large.join(large.groupBy("col").agg(F.min("node").alias("a")), "col").where("a <> node").select("a", F.col("node").alias("b"), F.lit(0).cast("long").alias("overlap"))
    pairs = partial_products(shared.where(F.col("size") <= FREQUENT)).union(stars.distinct())
    first = checkpointed(pairs.groupBy("b").agg(F.max_by("a", F.struct("overlap", -F.col("a"))).alias("a")).select("a", "b"))
    sets = None

    def known(nodes: DataFrame) -> DataFrame:
        """The full sets that were made so far, and those of `nodes`."""
        nonlocal sets
        fresh = checkpointed(nodes.distinct() if sets is None else nodes.distinct().join(sets.select("node"), "node", "left_anti"))
        made = written(sets_of(docs, fresh, id_col, text_col), "shingles", compression="none")
        sets = made if sets is None else sets.union(made)
        return sets

    def confirmed(pairs: DataFrame) -> DataFrame:
        return linked(pairs, known(pairs.select(F.explode(F.array("a", "b")).alias("node"))))

    comp = checkpointed(components(confirmed(first)))

    def add(links: DataFrame) -> None:
        nonlocal comp
        ends = labelled(links, comp, "a", "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
        if not ends.isEmpty():
            comp = merged(comp, ends)

    # then all pairs of different components that share a column of bounded size
    columns = labelled(shared.where(F.col("size") <= MEDIUM), few(comp), "node")
    columns = columns.select("*", F.min("node_comp").over(of_column).alias("lo"), F.max("node_comp").over(of_column).alias("hi")).where("lo < hi").drop("lo", "hi")
    cross = partial_products(checkpointed(columns), "x.node_comp <> y.node_comp").select("a", "b")
    add(confirmed(checkpointed(cross.join(first, ["a", "b"], "left_anti"))))
    # and in blocks those of the others. Two sets that can be linked are in one class of sizes or in two neighbouring ones:
    # a region is a column and two classes, and a pair belongs to the lower class of its documents
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int")
    wide = shared.where(F.col("size") > MEDIUM).select("col", "node", level.alias("level"), F.explode(F.array(level - 1, level)).alias("class")).distinct()
    regions = wide.groupBy("col", "class").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader"), F.min("level").alias("least")).where("size > 1 AND least = class")
    members = checkpointed(wide.join(regions, ["col", "class"]).select("col", "class", "node", "leader", "size"))
    if not members.isEmpty():
        members = checkpointed(needed(members)).select("col", "class", "node")
        add(checkpointed(block_links(members, comp, known(members.select("node")))))
    return comp


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's class: doc_id, n_shingles, component_id (the smallest id reachable over links of 0.80 or more).

    No link is lost. A null or empty text, or one without words, has no shingles
    and is linked with nothing; texts of any length are taken whole. A row with
    a null id takes no part: its component is null. Rows that share an id are
    one document, with the shingle sets of all its texts. Equal sets are one
    node. Only the two columns are looked at. An empty table gives an empty table.
    """
    docs = columns_of(docs, id_col, text_col).withColumn(id_col, F.col(id_col).cast("long"))
    rows = written(incidence(docs, id_col, text_col), "incidence", compression="none")
    usable = rows.where("doc_id IS NOT NULL AND same IS NOT NULL")
    # one document for each set; copies are dropped before the shuffle
    alone = usable.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("cols").alias("cols"))
    nodes = written(alone, "nodes", compression="none")
    comp = node_links(nodes, docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    place = labelled(nodes.select("same", "node"), comp, "node").select("same", F.col("node_comp").alias("component_id"))
    found = rows.select("doc_id", "n_shingles", "same").join(place, "same", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
