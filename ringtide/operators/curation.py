"""Labels of several tools beside each other, agreement, merge groups, manual calls."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import number_rows

# Each tool's label with a quality equivalent.
TO_QUALITY = {
    "GOOD": "good", "MUA": "MUA", "NOISE": "noise", "good": "good", "noise": "noise", "sua": "good", "mua": "MUA",
}
# Names of the manual calls.
MANUAL_NAMES = {0: "noise", 1: "good", 2: "MUA", 3: "non-somatic"}


def _lookup(table: dict, value: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[value]


def to_quality(label) -> Column:
    """Quality of a tool's label, null where it has none."""
    return _lookup(TO_QUALITY, F.col(label) if isinstance(label, str) else label)


def automated_labels(units: DataFrame, first: DataFrame, second: DataFrame,
                     manual: DataFrame | None = None) -> DataFrame:
    """Both tools' calls per unit and the label they agree on, '' where they do not.

    `first` has ``unit_id, label``; `second` ``unit_id, label, prob``; `manual`
    ``unit_id, code``, whose call stands in for the first tool's where set.
    """
    out = units.join(first.select("unit_id", F.col("label").alias("a_label")), "unit_id", "left")
    out = out.join(second.select("unit_id", F.col("label").alias("b_label"), F.col("prob").alias("b_prob")), "unit_id", "left")
    call = F.coalesce("a_label", F.lit(""))
    if manual is not None:
        out = out.join(manual.select("unit_id", _lookup(MANUAL_NAMES, F.col("code")).alias("a_manual")), "unit_id", "left")
        call = F.coalesce("a_manual", call)
    ours, theirs = to_quality(call), to_quality(F.coalesce("b_label", F.lit("")))
    agreed = F.coalesce(F.when(ours == theirs, ours), F.lit(""))
    columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("a_label", "a_manual", "b_label") if c in out.columns]
    return out.select(*units.columns, agreed.alias("auto_label"), *columns, "b_prob")


def require_overlap(units: DataFrame, other: DataFrame, what: str) -> None:
    """Refuse two unit lists with nothing in common."""
    if units.join(other, "unit_id", "left_semi").isEmpty():
        raise ValueError(f"{what} shares no unit with the sorting")


def final_unit_labels(calls: DataFrame) -> DataFrame:
    """Manual code where the source says manual, else the automatic one, by name; NA if unknown."""
    code = F.when(F.col("source") == "manual", F.col("manual_code")).otherwise(F.col("auto_code"))
    name = F.coalesce(_lookup(MANUAL_NAMES, code), F.lit("NA"))
    return calls.select("unit_id", name.alias("label"))


def merge_groups(members: DataFrame) -> DataFrame:
    """Members of each merge group in order, one row each with its place in the group."""
    return number_rows(members.select("group_id", "unit_id"), ["group_id"], ["unit_id"], "position")


def scored_partners(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored pairs whose two units are in the same group, from the sparse score table."""
    a = members.select(F.col("unit_id").alias("i"), "group_id")
    c = members.select(F.col("unit_id").alias("j"), F.col("group_id").alias("__g"))
    return scores.join(a, "i").join(c, "j").where("group_id = __g AND i <> j").drop("__g")


def partner_scores(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Per unit its group, the number of scored partners and the best score to one of them."""
    pairs = scored_partners(members, scores)
    both = pairs.select(F.col("i").alias("unit_id"), F.col("j").alias("p"), "score").unionByName(
        pairs.select(F.col("j").alias("unit_id"), F.col("i").alias("p"), "score"))
    best = both.groupBy("unit_id").agg(
        F.max("score").alias("best_score"), F.count_distinct("p").cast("bigint").alias("n_partners"))
    return members.join(best, "unit_id", "left").withColumn("n_partners", F.coalesce("n_partners", F.lit(0)).cast("bigint"))


def curation_result(automated: DataFrame, manual: DataFrame, removed: DataFrame, merged: DataFrame,
                    split: DataFrame) -> DataFrame:
    """Automated table with manual labels, removed and split flags, and merge groups (-1 if none)."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("unit_id", F.lit(True).alias(name)).distinct()

    out = automated.join(manual, "unit_id", "left").join(flag(removed, "removed"), "unit_id", "left")
    out = out.join(merged.select("unit_id", F.col("group_id").alias("merge_group")), "unit_id", "left")
    out = out.join(flag(split, "split"), "unit_id", "left")
    return out.withColumns({
        "removed": F.coalesce("removed", F.lit(False)), "split": F.coalesce("split", F.lit(False)),
        "merge_group": F.coalesce("merge_group", F.lit(-1))})


def sorting_fingerprint(spikes: DataFrame, unit: str) -> DataFrame:
    """Spike count per unit, the part of a sorting's identity that a table can show."""
    return spikes.groupBy(unit).agg(F.count("*").cast("bigint").alias("n_spikes"))


def fingerprint_changes(old: DataFrame, new: DataFrame, unit: str, tolerance: float = 0.0,
                        least: int = 0) -> DataFrame:
    """Units gained, lost, or changed by more than the tolerance."""
    a = old.select(unit, F.col("n_spikes").alias("n_old"))
    c = new.select(unit, F.col("n_spikes").alias("n_new"))
    both = a.join(c, unit, "full_outer")
    allowed = F.greatest(F.lit(float(least)), F.col("n_old") * tolerance)
    status = (F.when(F.col("n_old").isNull(), "extra").when(F.col("n_new").isNull(), "missing")
              .when(F.abs(F.col("n_new") - F.col("n_old")) > allowed, "stale").otherwise("ok"))
    return both.withColumn("status", status)


def sheet_properties(table: DataFrame) -> DataFrame:
    """Text columns with nulls as '', for viewers that take no null."""
    text = [f.name for f in table.schema if f.dataType.simpleString() == "string"]
    return table.withColumns({c: F.coalesce(c, F.lit("")) for c in text})


def initial_curation(labels: DataFrame, unit: str = "unit_id", label: str = "auto_label") -> DataFrame:
    """One JSON object per unit carrying its starting quality label, if it has one."""
    given = F.when(F.col(label) != "", F.col(label))
    body = F.to_json(F.struct(F.col(unit).alias("unit_id"), F.struct(given.alias("quality")).alias("labels")))
    return labels.select(unit, body.alias("curation"))
