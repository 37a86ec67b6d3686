"""Queries that compare call sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import verify
from cytoquill.queries import derived
from cytoquill.queries.derived import with_ctes
from cytoquill.queries.registry import query, r6

KEYED = {
    "keyed": """SELECT contig, pos, ref, alt, in_pred, in_truth, in_comp, CASE WHEN length(alt) = 1 THEN
    CASE WHEN is_denovo THEN 'DeNovo' WHEN is_cpg THEN 'CpG' ELSE 'Other' END ELSE 'Insertion' END AS category
  FROM variants WHERE filter = 'PASS' AND (in_pred OR in_truth OR in_comp)"""
}


def call_sets(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    rows = verify.comparable(derived.variants(spark, sf))
    return {name: rows.where(f"in_{name}").select("contig", "pos", "ref", "alt", "category") for name in ("pred", "truth", "comp")}


def present(spark: SparkSession, sf: str) -> DataFrame:
    return verify.presence(**call_sets(spark, sf))


def level_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = derived.variants(spark, sf)
    pred = rows.where("in_pred").select(
        "contig", "pos", F.col("beta_pred").alias("beta"), "is_cpg", "is_denovo", (F.col("filter") == "PASS").alias("has_variant")
    )
    comp = rows.where("in_comp").select("contig", "pos", F.col("beta_comp").alias("beta"))
    return pred, comp


@query(
    "verify_venn",
    with_ctes(
        """SELECT count(*) FILTER (in_truth AND NOT in_pred AND NOT in_comp) AS truth_only,
  count(*) FILTER (NOT in_truth AND in_pred AND NOT in_comp) AS predictions_only, count(*) FILTER (NOT in_truth AND NOT in_pred AND in_comp) AS competitor_only,
  count(*) FILTER (in_truth AND in_pred AND NOT in_comp) AS truth_and_predictions, count(*) FILTER (in_truth AND NOT in_pred AND in_comp) AS truth_and_competitor,
  count(*) FILTER (NOT in_truth AND in_pred AND in_comp) AS predictions_and_competitor, count(*) FILTER (in_truth AND in_pred AND in_comp) AS all_three FROM keyed""",
        "variants", extra=KEYED,
    ),
)
def verify_venn(spark: SparkSession, sf: str) -> DataFrame:
    return verify.venn_cells(present(spark, sf))


_ACC = """SELECT '{c}' AS caller, tp, fp, fn, round(tp/(tp + fp), 6) AS precision, round(tp/(tp + fn), 6) AS recall, round(fn/(tp + fn), 6) AS fn_rate,
  round(2*(tp/(tp + fp))*(tp/(tp + fn))/((tp/(tp + fp)) + (tp/(tp + fn))), 6) AS f1 FROM (SELECT count(*) FILTER (in_{c} AND in_truth) AS tp,
  count(*) FILTER (in_{c} AND NOT in_truth) AS fp, count(*) FILTER (NOT in_{c} AND in_truth) AS fn FROM keyed)"""


@query("verify_metrics", with_ctes(_ACC.format(c="pred") + " UNION ALL " + _ACC.format(c="comp"), "variants", extra=KEYED))
def verify_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return verify.accuracy(present(spark, sf)).withColumns({c: r6(c) for c in ("precision", "recall", "fn_rate", "f1")})


@query(
    "verify_categories",
    with_ctes(
        """SELECT category, pred_n, pred_tp, comp_n, comp_tp, pred_and_comp, pred_n - pred_and_comp AS pred_only, comp_n - pred_and_comp AS comp_only,
  round(pred_tp/pred_n, 6) AS pred_precision, round(comp_tp/comp_n, 6) AS comp_precision FROM (
  SELECT category, count(*) FILTER (in_pred) AS pred_n, count(*) FILTER (in_pred AND in_truth) AS pred_tp, count(*) FILTER (in_comp) AS comp_n,
    count(*) FILTER (in_comp AND in_truth) AS comp_tp, count(*) FILTER (in_comp AND in_pred) AS pred_and_comp FROM keyed WHERE in_pred OR in_comp GROUP BY category)""",
        "variants", extra=KEYED,
    ),
)
def verify_categories(spark: SparkSession, sf: str) -> DataFrame:
    return verify.category_report(present(spark, sf)).withColumns({c: r6(c) for c in ("pred_precision", "comp_precision")})


@query(
    "beta_compare",
    with_ctes(
        """SELECT n_compared, n_predictions_only, n_competitor_only, round(r, 6) AS pearson_r, round(r*r, 6) AS r_squared, round(d, 6) AS mean_abs_diff FROM (
  SELECT count(*) FILTER (in_pred AND in_comp) AS n_compared, count(*) FILTER (in_pred AND NOT in_comp) AS n_predictions_only,
    count(*) FILTER (in_comp AND NOT in_pred) AS n_competitor_only, corr(CAST(beta_pred AS DOUBLE), CAST(beta_comp AS DOUBLE)) FILTER (in_pred AND in_comp) AS r,
    avg(abs(CAST(beta_pred AS DOUBLE) - CAST(beta_comp AS DOUBLE))) FILTER (in_pred AND in_comp) AS d FROM variants)""",
        "variants",
    ),
)
def beta_compare(spark: SparkSession, sf: str) -> DataFrame:
    pred, comp = level_pairs(spark, sf)
    return verify.compare_levels(pred, comp).withColumns({c: r6(c) for c in ("pearson_r", "r_squared", "mean_abs_diff")})


@query(
    "beta_density",
    with_ctes(
        """SELECT grid, bin_x, bin_y, count(*) AS n FROM (
  SELECT unnest(['all', CASE WHEN is_denovo THEN 'denovo' WHEN is_cpg THEN 'cpg' END,
      CASE WHEN is_denovo OR is_cpg THEN (CASE WHEN is_denovo THEN 'denovo' ELSE 'cpg' END) || (CASE WHEN filter = 'PASS' THEN '_variant' ELSE '_no_variant' END) END]) AS grid,
    CAST(least(floor(CAST(beta_pred AS DOUBLE)*200), 199) AS BIGINT) AS bin_x, CAST(least(floor(CAST(beta_comp AS DOUBLE)*200), 199) AS BIGINT) AS bin_y
  FROM variants WHERE in_pred AND in_comp) WHERE grid IS NOT NULL GROUP BY ALL""",
        "variants",
    ),
)
def beta_density(spark: SparkSession, sf: str) -> DataFrame:
    return verify.density_grids(verify.paired_levels(*level_pairs(spark, sf)))


@query(
    "beta_diff_hist",
    with_ctes(
        """SELECT CAST(least(floor(d/m*80), 79) AS BIGINT) AS bin, round(m, 6) AS max_diff, count(*) AS n FROM (
  SELECT d, max(d) OVER () AS m FROM (SELECT abs(CAST(beta_pred AS DOUBLE) - CAST(beta_comp AS DOUBLE)) AS d FROM variants WHERE in_pred AND in_comp)) GROUP BY 1, 2""",
        "variants",
    ),
)
def beta_diff_hist(spark: SparkSession, sf: str) -> DataFrame:
    return verify.difference_histogram(verify.paired_levels(*level_pairs(spark, sf))).withColumn("max_diff", r6("max_diff"))


@query(
    "truth_labels",
    with_ctes(
        """SELECT a.contig, a.pos, a.ref, a.alt, CAST(t.alt IS NOT NULL AS BIGINT) AS label FROM altrows a LEFT JOIN
(SELECT DISTINCT contig, pos, ref, alt FROM variants WHERE in_truth AND filter = 'PASS' AND length(alt) = 1) t
ON a.contig = t.contig AND a.pos = t.pos AND a.ref = t.ref AND a.alt = t.alt""",
        "altrows", "variants",
    ),
)
def truth_labels(spark: SparkSession, sf: str) -> DataFrame:
    from cytoquill.operators import pileup
    from cytoquill.queries.columns import columns

    candidates = pileup.alt_rows(columns(spark, sf)).select("contig", "pos", "ref", F.col("alt.base").alias("alt"))
    truth = derived.variants(spark, sf).where("in_truth")
    return verify.label_candidates(candidates, truth).select("contig", "pos", "ref", "alt", "label")
