"""Near-duplicates by an LSH forest over MinHash signatures (operator 8).

A document is the set of its five-word shingles. Equal sets are one node. Every
tree of the forest reads the signature in its own order; nodes with a common
prefix form a region. Candidates are a region's smallest node with every other
(which joins large groups with few tests) and all pairs of different components. A
region that holds too many nodes is first split by longer prefixes, which joins what
is most alike; then all its pairs of different components are compared in blocks. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_task, checkpointed, columns_of, holds, written
from .components import components, merged

#: Words of a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 75
#: Values of a signature, and where the trees begin to read it.
VALUES, TREES, STRIDE = 64, 16, 4
#: Prefix lengths of the regions. At similarity 0.75 all trees miss a prefix of 3 once in 6000 pairs.
DEPTHS = (3, 6, 12)
#: A region of at most so many nodes is compared pair by pair.
SMALL = 32
#: Nodes of a block of a large region; blocks are compared two by two, each pair of them in a group of its own.
BLOCK = 512
#: Equal signature values below which a pair is not tested: 5 standard deviations under the expectation at 0.75.
LEAST_EQUAL = 31
#: Rows up to which a table of ids or pairs is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Word hashes that a worker keeps; bytes of a text that are split into words at a time.
KEPT, CHUNK = 150_000, 1 << 22

_MIX = np.random.default_rng(20_011)
MULTIPLIERS = _MIX.integers(1 << 62, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
MASKS = _MIX.integers(1, 1 << 63, VALUES, dtype=np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text, A to Z in lower case; words end at U+0020 and U+0009 to U+000D."""
    holds("shingles", _HASHES.clear)
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(_HASHES) > KEPT:
        _HASHES.clear()
    parts, start = [], 0
    while start < len(raw):
        stop = start + CHUNK
        while stop < len(raw) and raw[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        words = raw[start:stop].split()
        parts.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
        start = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    size = min(n, WORDS)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total = total * FACTOR + words[i:n - size + 1 + i]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function, as 32 bits."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        block = (shingles[None, start:start + 4096] ^ MASKS[:, None]) * MULTIPLIERS[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, `same` (hash of the set; null if empty), `sig`."""

    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "same": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "sig": pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int32()))}

    return arrow_task(docs.select(id_col, text_col), "doc_id long, n_shingles long, same binary, sig array<int>", work, sliced=True)


def few(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`node` and `shingles` of the documents in `nodes`, made from their texts again."""

    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t).view(np.int64) for t in batch.column(1).to_pylist()]
        return {"node": batch.column(0), "shingles": pa.array(sets, pa.list_(pa.int64()))}

    some = docs.select(F.col(id_col).alias("node"), text_col).join(few(nodes), "node", "left_semi")
    return arrow_task(some, "node long, shingles array<long>", work, sliced=True)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (`a`, `b`) whose full sets are similar enough."""
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    pairs = few(pairs.select("a", "b"))
    both = a.join(pairs, "a").join(b, "b")
    meet = F.size(F.array_intersect("x", "y"))
    counted = both.select("a", "b", meet.alias("meet"), (F.size("x") + F.size("y")).alias("sizes"))
    return checkpointed(counted.where(100 * F.col("meet") >= PERCENT * (F.col("sizes") - F.col("meet"))).select("a", "b").distinct())


def prefixes(nodes: DataFrame, depth: int) -> DataFrame:
    """`node`, `tree` and `key`, the hash of the first `depth` values in the order of the tree."""
    twice = F.concat("sig", "sig")
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.slice(twice, t * STRIDE + 1, depth)))
    return nodes.select("node", F.posexplode(keys).alias("tree", "key"))


def equal_values(x: str, y: str) -> Column:
    """Number of equal values of two signatures."""
    same = F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, e: n + e)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs whose signatures agree often enough to be tested, with the number of equal values."""
    x, y = nodes.select(F.col("node").alias("a"), F.col("sig").alias("x")), nodes.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().join(x, "a").join(y, "b")
    return found.select("a", "b", equal_values("x", "y").alias("equal")).where(F.col("equal") >= LEAST_EQUAL).distinct()


def labelled(df: DataFrame, comp: DataFrame, *columns: str) -> DataFrame:
    """`df` with the component of each named node column in `<column>_comp`; a node without links is its own."""
    for c in columns:
        names = comp.select(F.col("node").alias(c), F.col("comp").alias("__comp"))
        df = df.join(names, c, "left").withColumn(f"{c}_comp", F.coalesce("__comp", c)).drop("__comp")
    return df


def block_links():
    """Links between components of two blocks of a region (or inside one), as a function of its Arrow table.

    All likely pairs of different components are confirmed on the full sets,
    but for those that links found before have joined; so there are fewer links
    than nodes. A pair is left to the first tree in which it shares a region.
    """
    first, stride, values, least, percent = DEPTHS[0], STRIDE, VALUES, LEAST_EQUAL, PERCENT

    def work(table: pa.Table) -> pa.Table:
        _HASHES.clear()  # a worker that has made shingles before
        table = table.combine_chunks()
        node, comp, block, main = (table.column(c).to_numpy() for c in ("node", "comp", "block", "main"))
        sig = np.asarray(table.column("sig").combine_chunks().flatten()).reshape(-1, values)
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64)])
        tree, i, j, with_main = (table.column(c)[0].as_py() for c in ("tree", "i", "j", "with_main"))
        x = np.flatnonzero(~main & (block == i))
        y = np.flatnonzero(main & (block == j)) if with_main else np.flatnonzero(~main & (block == j))
        inside, links, parent = not with_main and i == j, [], {}

        def top(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        for start in range(0, len(x), 64):
            for at in range(0, len(y), 512):
                rows, cols = x[start:start + 64], y[at:at + 512]
                same = sig[rows].T[:, :, None] == sig[cols].T[:, None, :]
                equal = same.sum(axis=0, dtype=np.uint8)
                met = (equal >= least) & (comp[rows][:, None] != comp[cols][None, :])
                if inside:
                    met &= rows[:, None] < cols[None, :]
                for t in range(tree):
                    met &= ~same[[(t * stride + k) % values for k in range(first)]].all(axis=0)
                r, c = np.nonzero(met)
                order = np.argsort(-equal[r, c].astype(np.int64), kind="stable")
                for p, q in zip(rows[r[order]].tolist(), cols[c[order]].tolist(), strict=True):
                    u, v = top(int(comp[p])), top(int(comp[q]))
                    n, m = ends[p + 1] - ends[p], ends[q + 1] - ends[q]
                    if u == v or 100 * min(n, m) < percent * max(n, m):
                        continue
                    both = np.concatenate([flat[ends[p]:ends[p + 1]], flat[ends[q]:ends[q + 1]]])
                    both.sort(kind="stable")
                    meet = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * meet >= percent * (n + m - meet):
                        parent[max(u, v)] = min(u, v)
                        links.append((int(node[p]), int(node[q])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return work


def region_links(wide: DataFrame, comp: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (`a`, `b`) that join the components in the large regions `wide` (node, tree, key); no pair is left out.

    Nodes outside a region's main component are dealt to blocks and meet all
    blocks; the main component's nodes, which are linked already, meet only
    those. No task holds more than two blocks at a time.
    """
    now = labelled(wide, comp, "node").withColumnRenamed("node_comp", "comp")
    sizes = now.groupBy("tree", "key", "comp").agg(F.count(F.lit(1)).alias("n"))
    chief = sizes.groupBy("tree", "key").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("chief"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most < all")
    blocks = chief.select("tree", "key", "chief", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("most") / BLOCK).cast("int").alias("inner"))
    dealt = now.join(blocks, ["tree", "key"]).withColumn("main", F.col("comp") == F.col("chief"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    dealt = dealt.withColumn("block", block)
    outer, inner = F.sequence(F.lit(0), F.col("outer") - 1), F.sequence(F.lit(0), F.col("inner") - 1)

    def meeting(i: Column, j: Column, with_main: bool) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(with_main).alias("with_main"))

    own = F.concat(F.transform(outer, lambda o: meeting(F.least(o, "block"), F.greatest(o, "block"), False)), F.transform(inner, lambda m: meeting(F.col("block"), m, True)))
    meets = F.when(F.col("main"), F.transform(outer, lambda o: meeting(o, F.col("block"), True))).otherwise(own)
    spread = dealt.select("node", "comp", "tree", "key", "main", "block", F.explode(meets).alias("m")).select("*", "m.*").drop("m")
    full = spread.join(nodes.select("node", "sig"), "node").join(sets, "node")
    return full.groupBy("tree", "key", "i", "j", "with_main").applyInArrow(block_links(), "a long, b long")


def node_links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Components (`node`, `comp`) of the nodes that have links. `nodes`: node, sig."""
    stars, small, large, wide, active = [], [], None, None, nodes
    for depth in DEPTHS:
        keys = prefixes(active, depth)
        if large is not None:
            keys = keys.join(large, ["node", "tree"], "left_semi")
        regions = keys.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).where("size > 1")
        members = checkpointed(keys.join(regions, ["tree", "key"]).withColumn("depth", F.lit(depth)))
        stars.append(members.select(F.col("leader").alias("a"), F.col("node").alias("b")))
        small.append(members.where(F.col("size") <= SMALL))
        large = members.where(F.col("size") > SMALL).select("node", "tree")
        if large.isEmpty():
            break
        wide = members.where(F.col("size") > SMALL).select("node", "tree", "key") if wide is None else wide
        active = nodes.join(large.select("node").distinct(), "node", "left_semi")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    small_regions = union(small)
    candidates = checkpointed(likely(union(stars), nodes))
    # the sets of every node that shares a region with another: they alone can have links
    shared = checkpointed(union([s.select(F.col("b").alias("node")) for s in stars] + [s.select(F.col("a").alias("node")) for s in stars]).distinct())
    sets = written(sets_of(docs, shared, id_col, text_col), "shingles", compression="none")
    # first one pair for each node, the likeliest; then what still joins two components
    first = checkpointed(candidates.groupBy("b").agg(F.max_by("a", F.struct("equal", -F.col("a"))).alias("a")).select("a", "b"))
    comp = checkpointed(components(confirmed(first, sets)))
    tested = first

    def add(pairs: DataFrame) -> bool:
        """Test the pairs of different components that were not tested before."""
        nonlocal comp, tested
        new = checkpointed(labelled(pairs.join(tested, ["a", "b"], "left_anti"), comp, "a", "b").where("a_comp <> b_comp").select("a", "b"))
        if new.isEmpty():
            return False
        tested = tested.union(new)
        found = labelled(confirmed(new, sets), comp, "a", "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
        if not found.isEmpty():
            comp = merged(comp, found)
        return True

    inside = labelled(small_regions.select("node", "tree", "key", "depth"), comp, "node")
    several = inside.groupBy("tree", "depth", "key").agg(F.collect_list(F.struct("node", "node_comp")).alias("m"), F.min("node_comp").alias("lo"), F.max("node_comp").alias("hi")).where("lo <> hi")
    left = several.select(F.explode("m").alias("x"), "m")
    cross = left.select(F.col("x.node").alias("a"), "x.node_comp", F.explode("m").alias("y")).where("a < y.node AND node_comp <> y.node_comp").select("a", F.col("y.node").alias("b"))
    add(candidates.select("a", "b").union(likely(checkpointed(cross.distinct()), nodes).select("a", "b")).distinct())

    if wide is not None:
        found = labelled(checkpointed(region_links(wide, comp, nodes, sets)), comp, "a", "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
        if not found.isEmpty():
            comp = merged(comp, found)
    return comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's class: doc_id, n_shingles, component_id (the smallest id reachable over links), kept.

    A null or empty text, or one without words, has no shingles, is linked with
    nothing and is kept. A row with a null id takes no part: its component and
    `kept` are null. Rows that share an id are one document and are in one
    component. Only the two columns are looked at. An empty table gives an empty table.
    """
    docs = columns_of(docs, id_col, text_col).withColumn(id_col, F.col(id_col).cast("long"))
    rows = written(signed(docs, id_col, text_col), "signatures")
    usable = rows.where("doc_id IS NOT NULL AND same IS NOT NULL")
    first = usable.groupBy("same").agg(F.min("doc_id").alias("node"))
    nodes = checkpointed(usable.join(first, "same").where("doc_id = node").select("node", "sig", "same").dropDuplicates(["node", "same"]).select("node", "sig"))
    comp = node_links(nodes, docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    place = labelled(first, comp, "node").select("same", F.col("node_comp").alias("component_id"))
    found = rows.select("doc_id", "n_shingles", "same").join(place, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without those that `near_duplicates` does not keep; rows with a null id stay."""
    dropped = checkpointed(near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__dropped")).distinct())
    return docs.join(few(dropped), docs[id_col] == dropped["__dropped"], "left_anti")
