"""Queries over features, sampling and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.functions.mixing import RANGE, mix
from cytoquill.operators import features, forest, pileup, sampling
from cytoquill.queries import derived
from cytoquill.queries.columns import columns
from cytoquill.queries.derived import with_ctes
from cytoquill.queries.registry import query, r6


def columns_with_entropy(spark: SparkSession, sf: str) -> DataFrame:
    entropy = pileup.sequence_entropy(derived.reference(spark, sf)).select("contig", "pos", "entropy")
    return columns(spark, sf).join(entropy, ["contig", "pos"])


def _means(prefix: str) -> str:
    n = {"": "depth", "_ot": "n_ot", "_ob": "n_ob"}
    parts = [f"coalesce(sqrt({k}2{s}/nullif({d}, 0)), 0) AS {name}{s}" for s, d in n.items() for k, name in (("bq", "baseq"), ("mq", "mapq"))]
    parts += ["sqrt(al2/depth) AS aligned", "sqrt(in2/depth) AS indels", "sqrt(pir2/depth) AS pos_in_read"]
    return ", ".join(parts)


def _allele(alias: str, field: str) -> str:
    return f"coalesce({alias}.{field}, 0)"


def _score_sql(alt: str, ref: str, n: str, q: str) -> str:
    return f"(log2({_allele(alt, n)}*{_allele(alt, q)} + 1) - log2({_allele(ref, n)}*{_allele(ref, q)} + 1))"


def _level_sql(a: str, b: str) -> str:
    return f"log2(coalesce({a}/nullif({a} + {b}, 0), 0) + 1)"


def _feature_sql(model: str) -> dict[str, str]:
    depth = "greatest(c.depth, 1)"
    out: dict[str, str] = {f"ref_{b}": f"CASE WHEN c.ref = '{b}' THEN 1.0 ELSE 0.0 END" for b in "ACGT"}
    out |= {f"alt_{b}": f"CASE WHEN a.base = '{b}' THEN 1.0 ELSE 0.0 END" for b in "ACGT"}
    out |= {"pos_mapq": "c.mapq", "pos_mapq0": "c.mapq0", "region_entropy": "e.entropy"}
    out |= {
        f"ctx_{k}_{b}": f"CASE WHEN c.{col} = '{b}' THEN 1.0 ELSE 0.0 END"
        for k, col in (("before_2", "before2"), ("before_1", "before"), ("after_1", "after"), ("after_2", "after2")) for b in "ACGT"
    }
    for who, t in (("ref", "r"), ("alt", "a")):
        out[f"depth_ratio_{who}"] = f"{_allele(t, 'depth')}/{depth}"
        for s in ("ot", "ob"):
            out[f"depth_ratio_{who}_{s}"] = f"{_allele(t, 'n_' + s)}/{depth}"
            out[f"baseq_{who}_{s}"], out[f"mapq_{who}_{s}"] = _allele(t, f"baseq_{s}"), _allele(t, f"mapq_{s}")
        for f, c in (("baseq", "baseq"), ("mapq", "mapq"), ("pos_in_read", "pos_in_read"), ("num_aligned", "aligned"), ("num_indels", "indels")):
            out[f"{f}_{who}"] = _allele(t, c)
    out |= {n: "0.0" for n in features.ENGINE}
    out["sb_alt"] = f"({_allele('a', 'n_ot')} + 1.0)/({_allele('a', 'n_ob')} + 1.0)"
    out["sb_ref"] = f"({_allele('r', 'n_ot')} + 1.0)/({_allele('r', 'n_ob')} + 1.0)"
    if model == "other":
        out["alt_score"] = _score_sql("a", "r", "depth", "baseq")
        return out
    c_side = "c.ref = 'C'" if model == "cpg" else "a.base = 'C'"
    out["alt_score"] = f"CASE WHEN {c_side} THEN {_score_sql('a', 'r', 'n_ob', 'baseq_ob')} ELSE {_score_sql('a', 'r', 'n_ot', 'baseq_ot')} END"
    if model == "cpg":
        centre = f"CASE WHEN {c_side} THEN {_level_sql('a.n_ot', _allele('r', 'n_ot'))} ELSE {_level_sql('a.n_ob', _allele('r', 'n_ob'))} END"
        missing = f"CASE WHEN ({c_side} AND nc.pos IS NULL) OR (NOT ({c_side}) AND pc.pos IS NULL) THEN 0.0 ELSE {centre} END"
    else:
        centre = f"CASE WHEN {c_side} THEN {_level_sql(_allele('bt', 'n_ot'), _allele('bc', 'n_ot'))} ELSE {_level_sql(_allele('ba', 'n_ob'), _allele('bg', 'n_ob'))} END"
        missing = centre
    seen_c, seen_g = f"{c_side} AND na.base IS NOT NULL", f"NOT ({c_side}) AND pt.base IS NOT NULL"
    out["beta_ratio"] = (
        f"CASE WHEN {seen_c} THEN {centre} - {_level_sql('na.n_ob', _allele('nr', 'n_ob'))} "
        f"WHEN {seen_g} THEN {centre} - {_level_sql('pt.n_ot', _allele('pr', 'n_ot'))} ELSE {missing} END"
    )
    out["alt_ad_adj"] = f"CASE WHEN {seen_c} THEN na.depth/nc.depth WHEN {seen_g} THEN pt.depth/pc.depth ELSE 0.0 END"
    out["alt_score_adj"] = f"CASE WHEN {seen_c} THEN {_score_sql('na', 'nr', 'n_ot', 'baseq_ot')} WHEN {seen_g} THEN {_score_sql('pt', 'pr', 'n_ob', 'baseq_ob')} ELSE 0.0 END"
    out["sb_adj"] = f"CASE WHEN {seen_c} THEN (na.n_ob + 1.0)/(na.n_ot + 1.0) WHEN {seen_g} THEN (pt.n_ot + 1.0)/(pt.n_ob + 1.0) ELSE 0.0 END"
    return out


ENTROPY_SQL = """SELECT contig, pos, -(CASE WHEN c > 0 THEN c/n*log2(c/n) ELSE 0 END) - (CASE WHEN t > 0 THEN t/n*log2(t/n) ELSE 0 END)
  - (CASE WHEN a > 0 THEN a/n*log2(a/n) ELSE 0 END) - (CASE WHEN g > 0 THEN g/n*log2(g/n) ELSE 0 END) AS entropy FROM (
  SELECT contig, pos, count(*) FILTER (base = 'C') OVER w AS c, count(*) FILTER (base = 'T') OVER w AS t,
    count(*) FILTER (base = 'A') OVER w AS a, count(*) FILTER (base = 'G') OVER w AS g, count(*) OVER w AS n FROM refb
  WINDOW w AS (PARTITION BY contig ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING))"""
CONVERSION = "((c.ref = 'C' AND c.after = 'G' AND a.base = 'T') OR (c.ref = 'G' AND c.before = 'C' AND a.base = 'A'))"
NOVEL = "((a.base = 'C' AND c.after = 'G') OR (a.base = 'G' AND c.before = 'C'))"
PICK = {"cpg": CONVERSION, "denovo": f"NOT coalesce({CONVERSION}, false) AND {NOVEL}", "other": f"NOT coalesce({CONVERSION}, false) AND NOT coalesce({NOVEL}, false)"}


def _oracle(model: str) -> str:
    exprs = _feature_sql(model)
    cols = ", ".join(f"round(CAST({exprs[n]} AS DOUBLE), 6) + 0.0 AS {n}" for n in features.LAYOUTS[model])
    at = lambda t, c, b: f"LEFT JOIN al {t} ON {t}.contig = c.contig AND {t}.pos = {c} AND {t}.base = {b}"
    joins = [
        "LEFT JOIN covered nc ON nc.contig = c.contig AND nc.pos = c.pos + 1", "LEFT JOIN covered pc ON pc.contig = c.contig AND pc.pos = c.pos - 1",
        at("r", "c.pos", "c.ref"), at("na", "c.pos + 1", "'A'"), at("nr", "c.pos + 1", "nc.ref"), at("pt", "c.pos - 1", "'T'"), at("pr", "c.pos - 1", "pc.ref"),
        at("bc", "c.pos", "'C'"), at("bt", "c.pos", "'T'"), at("bg", "c.pos", "'G'"), at("ba", "c.pos", "'A'"),
    ]
    body = (
        f"SELECT c.contig, c.pos, a.base AS alt, {cols} FROM covered c JOIN al a ON a.contig = c.contig AND a.pos = c.pos AND a.base <> c.ref AND a.base IN ('A', 'C', 'G', 'T') "
        + " ".join(joins)
        + f" JOIN ent e ON e.contig = c.contig AND e.pos = c.pos WHERE c.depth > 1 AND c.mapq > 5 AND c.ref IN ('A', 'C', 'G', 'T') AND {PICK[model]}"
    )
    return with_ctes(body, "covered", "alleles", "refb", extra={"al": f"SELECT contig, pos, base, depth, n_ot, n_ob, {_means('')} FROM alleles", "ent": ENTROPY_SQL})


def _feature_query(model: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = features.model_rows(features.feature_table(columns_with_entropy(spark, sf)), model)
        return rows.select(
            "contig", "pos", "alt", *[(r6(F.get("features", F.lit(i))) + F.lit(0.0)).alias(n) for i, n in enumerate(features.LAYOUTS[model])]
        )

    return run


for _model in forest.MODELS:
    query(f"ml_features_{_model}", _oracle(_model))(_feature_query(_model))


@query(
    "reservoir_sample",
    with_ctes(
        f"""SELECT contig, pos, alt, model, sample_key FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY sample_key, contig, pos, alt) AS k FROM (
  SELECT c.contig, c.pos, c.alt, CASE WHEN alt_depth > 2 THEN 'deep' ELSE 'thin' END AS model, {mix("c.pos*31 + ascii(c.alt)*7 + ascii(substr(c.contig, 4, 1))")} AS sample_key FROM altrows c))
WHERE k <= CASE model WHEN 'deep' THEN 120 ELSE 250 END""",
        "altrows",
    ),
)
def reservoir_sample(spark: SparkSession, sf: str) -> DataFrame:
    alts = pileup.alt_rows(columns(spark, sf)).select(
        "contig", "pos", F.col("alt.base").alias("alt"), F.when(F.col("alt.depth") > 2, F.lit("deep")).otherwise(F.lit("thin")).alias("model")
    )
    key = F.expr(mix("pos*31 + ascii(alt)*7 + ascii(substr(contig, 4, 1))"))
    caps = F.when(F.col("model") == "deep", 120).otherwise(250)
    return sampling.smallest_keys(alts, ["model"], key, caps, RANGE)


@query(
    "platt_apply",
    with_ctes("SELECT contig, pos, alt, round(score, 6) AS score, round(1/(1 + exp(-4.0*score + 1.5)), 6) AS calibrated FROM verdicts", "verdicts"),
)
def platt_apply(spark: SparkSession, sf: str) -> DataFrame:
    from cytoquill.queries.columns import scored_alts

    rows = scored_alts(columns(spark, sf))
    return rows.select("contig", "pos", F.col("alt.base").alias("alt"), r6("score").alias("score"), r6(forest.Platt(-4.0, 1.5).apply(F.col("score"))).alias("calibrated"))


def planted_truth(spark: SparkSession, sf: str) -> DataFrame:
    """The substitutions planted into the derived genome."""
    ref = derived._project(derived.table(spark, sf, "part"), {**derived.REF_COLUMNS, "p": "p_partkey"})
    alt = F.expr(derived.planted("base", "p", "1"))
    return ref.select("contig", "pos", F.col("base").alias("ref"), alt.alias("alt"), F.lit("PASS").alias("filter")).where("ref <> alt")


def small_forests(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, forest.AltModel]]:
    from cytoquill.session import cut_lineage

    cols = cut_lineage(columns_with_entropy(spark, sf))
    params = forest.TrainParams(trees=24, depth=8, min_leaf=2, positives=4000, negatives=20000)
    return cols, forest.train(cols, planted_truth(spark, sf), params)


@query("rf_scores")
def rf_scores(spark: SparkSession, sf: str) -> DataFrame:
    cols, models = small_forests(spark, sf)
    return forest.score(cols, models).withColumn("score", r6("score"))


@query("platt_fit")
def platt_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration of a plain allele share against the planted truth, applied to every alt."""
    from cytoquill.operators.verify import label_candidates
    from cytoquill.queries.columns import scored_alts
    from cytoquill.session import cut_lineage

    alts = scored_alts(columns(spark, sf)).select("contig", "pos", "ref", F.col("alt.base").alias("alt"), "score")
    labelled = cut_lineage(label_candidates(alts, planted_truth(spark, sf)))
    fitted = forest.fit_platt(labelled)
    return labelled.select("contig", "pos", "alt", r6("score").alias("score"), "label", r6(fitted.apply(F.col("score"))).alias("calibrated"))
