"""Quality rules whose cutoffs are certified on labelled documents (operator 6), in DataFrame functions only.

A rule rejects a text when one of its ratios exceeds a cutoff. The cutoffs of a
stratum are the strictest for which labelled good documents prove, with exact
binomial tests, that no more than a given share of good documents is rejected.
Every stratum and ratio is a chain of hypotheses, tested from the mildest cutoff
on until one fails; the chains share the error by Bonferroni's rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, checkpointed, columns_of, let, written

#: White space as characters, for trimming.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Words of a window that counts as repeated.
WINDOW = 8
#: Terms of a binomial tail that are added; the rest is bounded from above by a geometric series.
TAIL_TERMS = 2000

#: Ratios and their cutoffs, from the mildest to the strictest that a rule may use.
RATIOS = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "repeats": [0.3, 0.27, 0.24, 0.2],
}


@dataclass(frozen=True)
class Risk:
    """At most `share` of the good documents of a stratum is rejected, for all strata at once with the given `confidence`."""

    share: float = 0.05
    confidence: float = 0.95


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the array, the first occurrence included.

    Windows meet by hash after sorting and are then compared word by word.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(pairs: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            return F.coalesce((x["h"] == other["h"]) & (F.slice(words, x["i"] + 1, WINDOW) == F.slice(words, other["i"] + 1, WINDOW)), F.lit(False))

        found = F.transform(pairs, lambda x, k: F.when(same(x, F.get(pairs, k - 1)) | same(x, F.get(pairs, k + 1)), x["i"]))
        return F.sort_array(F.filter(found, lambda x: x.isNotNull()))

    def from_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long"))
                .otherwise(let(pairs, lambda p: let(places(p), covered))))

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, from_hashes))


def measured(text: Column) -> Column:
    """Counts of a whole text as a struct; a null text has none of anything.

    n_words, word_chars (code points in words), n_symbols, n_lines (with a word),
    n_dup_lines (equal to an earlier one), n_repeat_words: all long.
    """
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    from_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    from_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")
    return F.struct(from_words.alias("w"), from_lines.alias("l"), symbols.alias("n_symbols"))


def with_counts(df: DataFrame, text_col: str = "text", name: str = "__counts") -> DataFrame:
    """`df` and the struct of `measured` in a column of this name."""
    return df.withColumn(name, measured(F.col(f"`{text_col}`")))


def flat(counts: str = "__counts") -> list[Column]:
    """The struct of `with_counts` as columns."""
    c = F.col(counts)
    return [c["w"]["n_words"].alias("n_words"), c["w"]["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            c["l"]["n_dup_lines"].alias("n_dup_lines"), c["w"]["n_repeat_words"].alias("n_repeat_words"), c["l"]["n_lines"].alias("n_lines")]


def base_failed() -> Column:
    """The fixed rule: under 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratio(name: str) -> Column:
    """A ratio of RATIOS; without words or lines it is 0."""
    part, whole = {"symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}[name]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def log_factorial(n: Column) -> Column:
    """ln n!: exactly up to 20, then by Stirling's series, whose error there is below 1e-12."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * F.lit(3.141592653589793) * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) for X of n trials with probability `share`: the p-value of "the true share is `share` or more".

    1 where k / n is not below `share`. Terms beyond TAIL_TERMS are bounded from above, which keeps the guarantee.
    """
    odds = (1 - share) / share
    log_top = (log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(share)) + (n - k) * F.log(F.lit(1 - share)))

    def step(state: Column, j: Column) -> Column:
        term = state["term"] * (k - j) * odds / (n - k + j + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    steps = F.sequence(F.lit(0).cast("long"), F.least(k, F.lit(TAIL_TERMS)).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    sums = F.aggregate(steps, start, step)
    slope = k * odds / (n - k + 1)
    rest = F.when(k > TAIL_TERMS, sums["term"] * slope / (1 - slope)).otherwise(F.lit(0.0))
    return F.when((n > 0) & (k < n * share), F.least(F.lit(1.0), F.exp(log_top) * (sums["total"] + rest))).otherwise(F.lit(1.0))


def certified(good: DataFrame, stratum: str, risk: Risk) -> DataFrame:
    """Cutoffs per stratum from the counts of labelled good documents: `stratum` and `cut_<ratio>` (null: none certified).

    One pass with partial sums; what follows has a row for each stratum and cutoff.
    """
    share = risk.share / len(RATIOS)
    sums = [F.sum(F.when(ratio(name) > cut, 1).otherwise(0)).cast("long").alias(f"{name}_{i}") for name, cuts in RATIOS.items() for i, cut in enumerate(cuts)]
    counts = good.groupBy(F.col(f"`{stratum}`").alias("__stratum")).agg(F.count(F.lit(1)).alias("n"), *sums)
    tests = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).select(
        "__stratum", "n", "strata", F.explode(F.array(*[
            F.struct(F.lit(name).alias("ratio"), F.lit(i).alias("step"), F.lit(cut).alias("cut"), F.col(f"{name}_{i}").alias("k"))
            for name, cuts in RATIOS.items() for i, cut in enumerate(cuts)])).alias("t")).select("__stratum", "n", "strata", "t.*")
    level = (1 - risk.confidence) / (F.col("strata") * len(RATIOS))
    passed = binomial_tail(F.col("k"), F.col("n"), share) <= level
    chain = Window.partitionBy("__stratum", "ratio").orderBy("step")
    held = tests.withColumn("held", passed).withColumn("held", F.min("held").over(chain)).where("held")
    return held.groupBy("__stratum").agg(*[F.min(F.when(F.col("ratio") == name, F.col("cut"))).alias(f"cut_{name}") for name in RATIOS])


def good_documents(counts: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Rows of documents labelled good: all labels of the id say so. Null labels say nothing."""
    said = columns_of(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    good = said.groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q")).where("__q = 1")
    return counts.join(good, counts[id_col] == good["__id"], "left_semi").where(~base_failed())


def judged(counts: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """`counts` with `base_failed`, `kept` and the cutoffs of its stratum. A stratum without labels has no cutoffs."""
    over = F.lit(False)
    for name in RATIOS:
        over = over | F.coalesce(ratio(name) > F.col(f"cut_{name}"), F.lit(False))
    joined = counts.join(cuts, counts[stratum].eqNullSafe(cuts["__stratum"]), "left").drop("__stratum")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | over))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdict on every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cut_*.

    A null or empty text has no words and fails the base rule. A null stratum is
    a stratum. Repeated rows each get their row. Empty labels certify nothing,
    so that only the base rule rejects. The strata must be few: their cutoffs
    are one small table.
    """
    rows = with_counts(columns_of(docs, id_col, text_col, stratum), text_col)
    counts = checkpointed(rows.select(F.col(f"`{id_col}`"), F.col(f"`{stratum}`").alias("__s"), *flat()))
    cuts = certified(good_documents(counts, labels, id_col), "__s", risk)
    return judged(counts, cuts, "__s").drop("__s", "n_lines")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `judge` keeps, with their own columns.

    Texts and counts are written once; the fit reads the counts alone.
    """
    if id_col not in docs.columns or any(c.startswith("__") for c in docs.columns):
        raise ValueError("columns of docs may not begin with two underscores")
    table = written(with_counts(docs, text_col), "quality", compression="zstd")
    counts = table.select(id_col, F.col(f"`{stratum}`").alias("__s"), *flat())
    cuts = checkpointed(certified(good_documents(counts, labels, id_col), "__s", risk))
    own = table.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{stratum}`").alias("__s"), *flat())
    return judged(own, cuts, "__s").where("kept").select("__row.*")
