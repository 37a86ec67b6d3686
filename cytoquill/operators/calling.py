"""Which alts are called, and which records come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquill.functions.bases import is_conversion, known, taken_side
from cytoquill.params import CallParams


def worth_scoring(depth: Column, mapq: Column, ref: Column, alt: Column) -> Column:
    return (depth > 1) & (mapq > 5) & known(ref) & known(alt)


def usable_row(features: Column) -> Column:
    """A feature row with a NaN or infinite entry is left unscored."""
    return F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def alt_filter(params: CallParams = CallParams(), alt: Column | None = None, score: Column | None = None) -> Column:
    """PASS or the reason an alt is rejected. Columns: depth, mapq, ref, before, after, and unless given alt and score."""
    alt = F.col("alt") if alt is None else alt
    score = F.col("score") if score is None else score
    side = taken_side(F.col("ref"), F.col("before"), F.col("after"))
    too_deep = is_conversion(side, alt["base"]) & (alt["depth"] > params.m_max_coverage)
    return (
        F.when(~worth_scoring(F.col("depth"), F.col("mapq"), F.col("ref"), alt["base"]), F.lit("pre_ml"))
        .when(too_deep, F.lit("m_highDp"))
        .when(score >= params.ml_threshold, F.lit("PASS"))
        .otherwise(F.lit("low_ml_score"))
    )


def keeps_record(params: CallParams) -> Column:
    """The four output modes over `covered`, `in_cpg` and `is_variant`."""
    if params.all_positions:
        return F.col("in_cpg") if params.cpgs_only else F.lit(True)
    wanted = F.col("in_cpg") if params.cpgs_only else F.col("in_cpg") | F.col("is_variant")
    return F.col("covered") & wanted


def makes_cpg(alt: Column) -> Column:
    """Whether an alt base takes a CpG side beside the reference neighbours or called alts next door."""
    c_side = (alt == "C") & (F.coalesce(F.col("after") == "G", F.lit(False)) | F.col("g_after"))
    g_side = (alt == "G") & (F.coalesce(F.col("before") == "C", F.lit(False)) | F.col("c_before"))
    return c_side | g_side


def is_variant() -> Column:
    """A called alt that makes no CpG, or a called indel."""
    plain = F.exists("called", lambda b: ~makes_cpg(b))
    return plain | F.coalesce(F.col("has_called_indel"), F.lit(False))


def call_alts(cols: DataFrame, score: Callable[[Column], Column], params: CallParams = CallParams()) -> DataFrame:
    """Add `alt_calls` (all alts in order, with verdict and score) and `called` (bases of those that pass).

    Works inside the column's own alt array, so columns are neither exploded nor joined to themselves.
    """
    judged = F.transform(
        "alts",
        lambda a, i: F.struct(
            i.alias("alt_rank"), a.base.alias("base"), alt_filter(params, a, score(a)).alias("filter"), score(a).cast("double").alias("score")
        ),
    )
    return cols.withColumn("alt_calls", judged).withColumn(
        "called", F.transform(F.filter("alt_calls", lambda a: a["filter"] == "PASS"), lambda a: a.base)
    )


def with_scores(cols: DataFrame, scores: DataFrame) -> DataFrame:
    """Add `scores`, a map from alt base to score, from a table of (contig, pos, alt, score)."""
    packed = scores.where("score is not null").groupBy("contig", "pos").agg(F.map_from_entries(F.collect_list(F.struct("alt", "score"))).alias("scores"))
    return cols.join(packed, ["contig", "pos"], "left")


def split_by_model(alts: DataFrame) -> DataFrame:
    """Add `model`: cpg for a conversion-like alt, denovo for one making a CpG with a reference neighbour, else other."""
    side = taken_side(F.col("ref"), F.col("before"), F.col("after"))
    makes = taken_side(F.col("alt.base"), F.col("before"), F.col("after"))
    return alts.withColumn(
        "model",
        F.when(is_conversion(side, F.col("alt.base")), F.lit("cpg")).when(makes.isNotNull(), F.lit("denovo")).otherwise(F.lit("other")),
    )
