"""Merkle manifest of a data set: roots by language, proofs, and their check (operator 13).

Leaves are numbered in every language and cut into superblocks of 8**4. A superblock
is reduced in a task of its own to one node; the nodes of all superblocks are
numbered again and reduced in the same way, tier upon tier, until every language has
one root, and the roots of the languages are one more group. On the way back the
outer nodes that a superblock's proofs need (one row for it) are cogrouped with its
leaves, and one task joins the proofs and folds them.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, running, sums_before, written

#: Nodes of a run, and levels that are reduced in one task: a superblock holds FAN ** LEVELS nodes.
FAN, LEVELS = 8, 4
#: Letters that tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    """H: the lowercase hex sha256 of all parts together."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(size: int) -> int:
    """Levels above a group of `size` nodes."""
    levels, reach = 0, 1
    while reach < size:
        levels, reach = levels + 1, reach * FAN
    return levels


def reduced(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, from `hashes` up."""
    found = [hashes]
    for _ in range(levels):
        below = found[-1]
        found.append([digest(*below[i:i + FAN]) for i in range(0, len(below), FAN)])
    return found


def path_of(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """The siblings of node `at` on every level below the last: those to the left and to the right, joined."""
    path = []
    for nodes in tree[:-1]:
        first = at - at % FAN
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + FAN])))
        at //= FAN
    return path


def fold(node: str, left: list[str], right: list[str]) -> str:
    """The root that `node` gives with the siblings of its path."""
    for before, after in zip(left, right, strict=True):
        node = digest(before, node, after)
    return node


def field(value: Column) -> Column:
    """A value as the leaf holds it: its length in bytes and itself, or a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """H of a row's fields, with `text` as its text."""
    return F.sha2(F.concat(*[field(F.col(f"`{c}`")) for c in FIELDS[:-1]], field(text)).cast("binary"), 256)


def tops(nodes: DataFrame) -> DataFrame:
    """One node for every superblock (`grp`, `block`, `size`) of `nodes` (`grp`, `idx`, `size`, `hash`): its local root."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        size = int(rows["size"].iloc[0])
        tree = reduced(rows["hash"].tolist(), min(LEVELS, levels_of(size)))
        return pd.DataFrame({"grp": rows["grp"].iloc[:1], "idx": rows["block"].iloc[:1], "size": [-(-size // FAN**LEVELS)], "hash": tree[-1]})

    return blocked(nodes).groupBy("grp", "block").applyInPandas(work, "grp long, idx long, size long, hash string")


def blocked(nodes: DataFrame) -> DataFrame:
    return nodes.select("grp", "idx", "size", "hash", F.floor(F.col("idx") / FAN**LEVELS).cast("long").alias("block"))


def join_proofs(nodes: DataFrame, outer: DataFrame, columns: str, finish) -> DataFrame:
    """`nodes` and `outer` (one row for a superblock: `grp`, `block`, `left`, `right`, `root`) cogrouped by superblock.

    `finish` makes the output rows of a superblock from its rows, ordered, and
    the whole path (left, right) of each and the root.
    """

    def work(here: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        here = here.sort_values("idx").reset_index(drop=True)
        tree = reduced(here["hash"].tolist(), min(LEVELS, levels_of(int(here["size"].iloc[0]))))
        left, right, root = list(above["left"].iloc[0]), list(above["right"].iloc[0]), above["root"].iloc[0]
        paths = [path_of(tree, i) for i in range(len(here))]
        return finish(here, [([b for b, _ in p] + left, [a for _, a in p] + right) for p in paths], above)

    return nodes.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(work, columns)


PATHS = "grp long, block long, left array<string>, right array<string>, subroot string, root string"


def paths(nodes: DataFrame, purpose: str) -> DataFrame:
    """For every node (`grp`, `idx`; one row each, of superblocks' local roots) its path up to its group's root and `root`.

    As long as a group has several superblocks the next tier is built first, so
    no task holds more than one superblock, however large a group is.
    """

    def finish(here: pd.DataFrame, found: list, above: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"grp": here["grp"], "block": here["idx"], "left": [a for a, _ in found], "right": [b for _, b in found],
                             "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})

    if nodes.where("size > 1").isEmpty():  # these are the roots of their groups
        none = F.array().cast("array<string>")
        return nodes.select("grp", F.col("idx").alias("block"), none.alias("left"), none.alias("right"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    upper = paths(written(tops(nodes), purpose), purpose)
    return written(join_proofs(blocked(nodes), upper, PATHS, finish), purpose)


def numbered(leaves: DataFrame) -> DataFrame:
    """`leaves` with `grp` (the place of their language), `idx` inside it and its `size`; by id, then by leaf.

    The table is sorted by ranges and each task counts its own part, so a
    language that holds most rows is spread over many tasks; equal rows as well.
    """
    parts = max(1, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("__tie")]
    spread = leaves.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = running(spread.drop("__tie").withColumn("__one", F.lit(1).cast("long")), "lang", "__one", "leaves")
    sizes = leaves.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    # few rows a task: languages are numbered as the leaves are
    sorted_sizes = sizes.repartitionByRange(parts, F.asc_nulls_first("lang")).sortWithinPartitions(F.asc_nulls_first("lang"))
    one = running(sorted_sizes.withColumn("__all", F.lit("all")).withColumn("__one", F.lit(1).cast("long")), "__all", "__one", "languages")
    groups = written(one.select(F.col("lang").alias("__lang"), F.col("__before").alias("grp"), "size"), "groups")
    joined = placed.join(groups, placed["lang"].eqNullSafe(groups["__lang"]))
    return joined.select("grp", F.col("__before").alias("idx"), "size", F.col("leaf").alias("hash"), F.col("doc_id").cast("string").alias("doc_id"), "tampered")


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """Every row's leaf, roots and proof: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows of a language (null is one) ascend by doc_id, a null id first, then by
    leaf, so that repeated ids have a place; equal rows have equal leaves and the
    proofs of their several places. `tampered` tells for which rows the folded
    leaf has a text with A to Z in lower case (null: not). Null fields are a dash in the leaf and
    an empty text has no bytes. Texts of any length are hashed in their own row
    and do not travel. Only the five columns are looked at, and the condition. An empty table gives
    an empty table.
    """
    fields = docs.select(*[F.col(f"`{c}`") for c in FIELDS], F.coalesce(tampered, F.lit(False)).alias("__changed"))
    text = F.col("text")
    leaves = fields.select("lang", "doc_id", leaf(text).alias("leaf"), F.when(F.col("__changed"), leaf(F.translate(text, UPPER, LOWER))).alias("tampered"))
    leaves = written(leaves, "hashed")
    nodes = written(numbered(leaves), "numbered")
    below = written(tops(nodes), "superblocks")
    inner = paths(below, "paths")
    # the languages' roots are one more group, reduced in the same way
    roots = inner.select("grp", "subroot").distinct()
    count = nodes.select("grp").distinct().count()
    many = written(roots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.lit(count).cast("long").alias("size"), F.col("subroot").alias("hash")), "roots")
    above = paths(many, "root-paths").select(F.col("block").alias("grp"), F.col("left").alias("__left"), F.col("right").alias("__right"), F.col("root").alias("__root"))
    outer = inner.drop("root").join(above, "grp").select("grp", "block", F.concat("left", "__left").alias("left"), F.concat("right", "__right").alias("right"), "subroot", F.col("__root").alias("root"))

    def finish(here: pd.DataFrame, found: list, above: pd.DataFrame) -> pd.DataFrame:
        root, changed = above["root"].iloc[0], here["tampered"].where(here["tampered"].notna(), here["hash"])
        folded = [fold(x, left, right) for x, (left, right) in zip(changed, found, strict=True)]
        proofs = [digest(*[s for pair in zip(left, right, strict=True) for s in pair]) for left, right in found]
        return pd.DataFrame({"doc_id": here["doc_id"], "leaf": here["hash"], "subroot": above["subroot"].iloc[0], "root": root,
                             "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    rows = nodes.withColumn("block", F.floor(F.col("idx") / FAN**LEVELS).cast("long"))
    # ids travel as texts: pandas would make doubles of a column with nulls
    columns = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return join_proofs(rows, outer, columns, finish).withColumn("doc_id", F.col("doc_id").cast("long"))


def third(id_col: str = "doc_id") -> Column:
    """Rows whose id, as a decimal text, has a CRC-32 that three divides."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
