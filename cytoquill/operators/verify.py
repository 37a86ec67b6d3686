"""Comparing call sets: variant presence, precision and recall, methylation levels.

Presence in several sets is one union and one hash aggregate on the variant key, not a chain of outer
joins, so a key repeated in a set cannot multiply and the partial aggregation absorbs it before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["contig", "pos", "ref", "alt"]
CATEGORIES = ["CpG", "DeNovo", "Other", "Insertion", "Deletion"]
DENSITY_BINS = 200
HISTOGRAM_BINS = 80


def comparable(variants: DataFrame) -> DataFrame:
    """PASS records spelled in A, C, G and T, with their category. `variants` has one row per alt."""
    spelled = variants.where(
        (F.col("filter") == "PASS") & F.col("ref").rlike("^[ACGT]+$") & F.col("alt").rlike("^[ACGT]+$")
    )
    n_ref, n_alt = F.length("ref"), F.length("alt")
    category = (
        F.when((n_ref == 1) & (n_alt == 1), F.when(F.col("is_denovo"), "DeNovo").when(F.col("is_cpg"), "CpG").otherwise("Other"))
        .when(n_ref == 1, "Insertion")
        .when(n_alt == 1, "Deletion")
        .otherwise("Other")
    )
    return spelled.withColumn("category", category)


def presence(**sets: DataFrame) -> DataFrame:
    """One row per variant key with `in_<name>` and `cat_<name>` for every given set."""
    names = list(sets)
    tagged = [
        s.select(
            *KEY,
            *[F.lit(n == name).alias(f"in_{n}") for n in names],
            *[(F.col("category") if n == name else F.lit(None).cast("string")).alias(f"cat_{n}") for n in names],
        )
        for name, s in sets.items()
    ]
    union = reduce(DataFrame.unionByName, tagged)
    # A later record of the same key replaces an earlier one; here the greatest category stands, which
    # does not depend on the order of the input.
    return union.groupBy(*KEY).agg(
        *[F.bool_or(f"in_{n}").alias(f"in_{n}") for n in names], *[F.max(f"cat_{n}").alias(f"cat_{n}") for n in names]
    )


def venn_cells(present: DataFrame) -> DataFrame:
    """Counts of the seven cells of predictions, truth and competitor."""
    t, p, c = F.col("in_truth"), F.col("in_pred"), F.col("in_comp")
    return present.agg(
        F.count_if(t & ~p & ~c).alias("truth_only"),
        F.count_if(~t & p & ~c).alias("predictions_only"),
        F.count_if(~t & ~p & c).alias("competitor_only"),
        F.count_if(t & p & ~c).alias("truth_and_predictions"),
        F.count_if(t & ~p & c).alias("truth_and_competitor"),
        F.count_if(~t & p & c).alias("predictions_and_competitor"),
        F.count_if(t & p & c).alias("all_three"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))


def accuracy(present: DataFrame, callers: Iterable[str] = ("pred", "comp")) -> DataFrame:
    """True and false positives, false negatives and the ratios made of them, one row per caller."""
    per_caller = present.select(
        "in_truth", F.explode(F.array(*[F.struct(F.lit(c).alias("caller"), F.col(f"in_{c}").alias("called")) for c in callers])).alias("s")
    )
    counts = per_caller.groupBy(F.col("s.caller").alias("caller")).agg(
        F.count_if(F.col("s.called") & F.col("in_truth")).alias("tp"),
        F.count_if(F.col("s.called") & ~F.col("in_truth")).alias("fp"),
        F.count_if(~F.col("s.called") & F.col("in_truth")).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "fn_rate": _ratio(fn, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", _ratio(2.0 * p * r, p + r))


def category_report(present: DataFrame) -> DataFrame:
    """Per category: precision of both callers against the whole truth set, and their overlap.

    A caller's category holds the keys that caller itself put there.
    """
    sides = F.array(
        F.struct(F.lit("pred").alias("caller"), F.col("cat_pred").alias("category")),
        F.struct(F.lit("comp").alias("caller"), F.col("cat_comp").alias("category")),
    )
    same = F.coalesce(F.col("cat_pred") == F.col("cat_comp"), F.lit(False))
    rows = present.select("in_truth", same.alias("same"), F.explode(sides).alias("s")).where("s.category is not null")
    pred, comp = F.col("s.caller") == "pred", F.col("s.caller") == "comp"
    out = rows.groupBy(F.col("s.category").alias("category")).agg(
        F.count_if(pred).alias("pred_n"),
        F.count_if(pred & F.col("in_truth")).alias("pred_tp"),
        F.count_if(comp).alias("comp_n"),
        F.count_if(comp & F.col("in_truth")).alias("comp_tp"),
        F.count_if(pred & F.col("same")).alias("pred_and_comp"),
        F.count_if(pred & ~F.col("same")).alias("pred_only"),
        F.count_if(comp & ~F.col("same")).alias("comp_only"),
    )
    return out.withColumns(
        {"pred_precision": _ratio(F.col("pred_tp"), F.col("pred_n")), "comp_precision": _ratio(F.col("comp_tp"), F.col("comp_n"))}
    )


def compare_levels(pred: DataFrame, comp: DataFrame) -> DataFrame:
    """One-row summary of two sets of methylation levels (contig, pos, beta)."""
    joined = pred.select("contig", "pos", F.col("beta").alias("x")).join(
        comp.select("contig", "pos", F.col("beta").alias("y")), ["contig", "pos"], "full_outer"
    )
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    summary = joined.agg(
        F.count_if(both).alias("n_compared"),
        F.count_if(F.col("x").isNotNull() & F.col("y").isNull()).alias("n_predictions_only"),
        F.count_if(F.col("x").isNull() & F.col("y").isNotNull()).alias("n_competitor_only"),
        F.corr(F.when(both, F.col("x")), F.when(both, F.col("y"))).alias("r"),
        F.avg(F.when(both, F.abs(F.col("x") - F.col("y")))).alias("d"),
    )
    r = F.coalesce(F.nanvl(F.col("r"), F.lit(0.0)), F.lit(0.0))
    return summary.select(
        "n_compared", "n_predictions_only", "n_competitor_only", r.alias("pearson_r"), (r * r).alias("r_squared"),
        F.coalesce("d", F.lit(0.0)).alias("mean_abs_diff"),
    )


def paired_levels(pred: DataFrame, comp: DataFrame) -> DataFrame:
    """Levels found in both sets; flags are the prediction's."""
    return pred.select("contig", "pos", F.col("beta").alias("x"), "is_cpg", "is_denovo", "has_variant").join(
        comp.select("contig", "pos", F.col("beta").alias("y")), ["contig", "pos"]
    )


def density_grids(pairs: DataFrame, bins: int = DENSITY_BINS) -> DataFrame:
    """Non-empty cells of the seven density grids: all, and CpG / de-novo each whole and by variant."""
    cell = lambda v: F.least(F.floor(F.col(v) * bins), F.lit(bins - 1)).cast("bigint")
    kind = F.when(F.col("is_denovo"), F.lit("denovo")).when(F.col("is_cpg"), F.lit("cpg"))
    with_variant = F.when(F.col("has_variant"), F.lit("_variant")).otherwise(F.lit("_no_variant"))
    grids = F.filter(F.array(F.lit("all"), kind, F.concat(kind, with_variant)), lambda g: g.isNotNull())
    cells = pairs.select(F.explode(grids).alias("grid"), cell("x").alias("bin_x"), cell("y").alias("bin_y"))
    return cells.groupBy("grid", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"))


def difference_histogram(pairs: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts of absolute differences scaled by the largest; all in the first bin if none differ."""
    diff = pairs.select(F.abs(F.col("x") - F.col("y")).alias("d"))
    # Rows become bins before they are shuffled; the largest difference is one aggregate of its own.
    scaled = diff.withColumn("max_diff", diff.agg(F.max("d")).scalar())
    index = F.when(F.col("max_diff") > 0, F.least(F.floor(F.col("d") / F.nullif(F.col("max_diff"), F.lit(0.0)) * bins), F.lit(bins - 1))).otherwise(0)
    return scaled.groupBy(index.cast("bigint").alias("bin"), "max_diff").agg(F.count(F.lit(1)).alias("n"))


def truth_snps(truth: DataFrame) -> DataFrame:
    """Distinct single-base substitutions of PASS records, padding of multi-allelic records removed."""
    known = "^[ACGT]"
    return (
        truth.where(
            (F.col("filter") == "PASS")
            & F.col("ref").rlike(known)
            & F.col("alt").rlike(known)
            & (F.expr("substr(ref, 2)") == F.expr("substr(alt, 2)"))
            & (F.expr("substr(ref, 1, 1)") != F.expr("substr(alt, 1, 1)"))
        )
        .select("contig", "pos", F.expr("substr(ref, 1, 1)").alias("ref"), F.expr("substr(alt, 1, 1)").alias("alt"))
        .distinct()
    )


def label_candidates(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Add `label`: 1 where a candidate (contig, pos, ref, alt) is a true substitution."""
    hits = truth_snps(truth).withColumn("_hit", F.lit(1))
    return candidates.join(hits, KEY, "left").withColumn("label", F.coalesce("_hit", F.lit(0)).cast("bigint")).drop("_hit")
