"""Queries over written records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import genotype, methylation, records, verify
from cytoquill.params import CallParams, error_rate
from cytoquill.queries import derived
from cytoquill.queries.columns import CALLED, called_columns
from cytoquill.queries.derived import with_ctes
from cytoquill.queries.registry import as_long, query
from cytoquill.session import cut_lineage

_E = error_rate()
RECORDS = {
    **CALLED,
    "gqs": f"""SELECT *, CASE WHEN nr + na > 0 THEN -10*log10(o/(1 + o)) END AS hgq FROM (SELECT *,
    pow(10.0, least((nr + na)*log10(0.5) - (na*log10({_E}) + nr*log10(1 - {_E})), 300.0)) + pow(10.0, least(nr*log10({_E}) + na*log10(1 - {_E}) - (na*log10({_E}) + nr*log10(1 - {_E})), 300.0)) AS o FROM (
    SELECT m.*, CASE WHEN in_cpg THEN no_snp ELSE coalesce(r.n_ot + r.n_ob, 0) END AS nr, CASE WHEN in_cpg THEN snp ELSE coalesce(x.n, 0) END AS na FROM methyl m
      LEFT JOIN alleles r ON r.contig = m.contig AND r.pos = m.pos AND r.base = m.ref
      LEFT JOIN (SELECT contig, pos, CAST(sum(n_ot + n_ob) AS BIGINT) AS n FROM altrows GROUP BY ALL) x ON x.contig = m.contig AND x.pos = m.pos))""",
}


def written_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Main records, stored, as a reader of the file would get them."""
    return cut_lineage(records.variant_lines(record_columns(spark, sf)))


def record_columns(spark: SparkSession, sf: str) -> DataFrame:
    return genotype.add_hom_ref_quality(methylation.methylation(called_columns(spark, sf)))


@query(
    "vcf_records",
    with_ctes(
        """SELECT contig, pos, ref, CASE WHEN called = '' THEN '.' ELSE array_to_string(string_split(called, ''), ',') END AS alt, depth AS dp, unmod, mod, no_snp, snp,
  CASE WHEN called = '' THEN CASE WHEN hgq IS NULL THEN './.' ELSE '0/0' END WHEN g1 = g2 THEN '1/1' ELSE '0/1' END AS gt,
  CAST(reference_cpg AS BIGINT) AS cpg FROM gqs WHERE called <> '' OR in_cpg""",
        "covered", "verdicts", "alleles", "altrows", extra=RECORDS,
    ),
)
def vcf_records(spark: SparkSession, sf: str) -> DataFrame:
    """Main records as text lines, read back field by field."""
    lines = written_lines(spark, sf)
    strands = F.split(F.regexp_extract("info", "M5mC_Strands=([^;]*)", 1), ",")
    counts = {n: F.get(strands, F.lit(i)).cast("bigint") for i, n in enumerate(("unmod", "mod", "no_snp", "snp"))}
    return lines.select(
        "contig", "pos", F.col("ref_text").alias("ref"), F.col("alt_text").alias("alt"), F.regexp_extract("info", ";DP=([0-9]+)", 1).cast("bigint").alias("dp"),
        *[c.alias(n) for n, c in counts.items()], records.sample_value("GT").alias("gt"), as_long(records.has_flag("CPG")).alias("cpg"),
    )


@query("vcf_all_lines")
def vcf_all_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of every record, rejected alts included."""
    return records.variant_lines(record_columns(spark, sf), CallParams(all_positions=True), everything=True).withColumn("kind", as_long("kind"))


@query(
    "vcf_to_bed",
    with_ctes(
        """SELECT contig AS chr, pos AS start, pos + 1 AS stop, unmod, mod, no_snp, snp, depth AS coverage,
  CASE WHEN called = '' THEN ref || '/' || ref ELSE g1 || '/' || g2 END AS genotype,
  CASE WHEN called = '' THEN CASE WHEN hgq IS NULL THEN 0 ELSE least(CAST(floor(hgq + 0.5) AS BIGINT), 99) END ELSE 0 END AS gt_conf_score,
  CASE WHEN reference_cpg THEN CASE ref WHEN 'C' THEN '+' ELSE '-' END WHEN contains(called, 'C') THEN '+' WHEN contains(called, 'G') THEN '-' WHEN ref = 'G' THEN '-' ELSE '+' END AS strand,
  CASE WHEN reference_cpg THEN 'REF' ELSE 'NEW' END AS cpg FROM gqs WHERE in_cpg""",
        "covered", "verdicts", "alleles", "altrows", extra=RECORDS,
    ),
)
def vcf_to_bed(spark: SparkSession, sf: str) -> DataFrame:
    rows = records.lines_to_bed(written_lines(spark, sf))
    return rows.select("chr", "start", F.col("end").alias("stop"), "unmod", "mod", "no_snp", "snp", "coverage", "genotype", "gt_conf_score", "strand", "cpg")


@query(
    "bed_calls",
    with_ctes(
        """SELECT call, count(*) AS n, count(*) FILTER (methylated) AS n_methylated FROM (SELECT
  CASE WHEN NOT (coalesce(g1, ref) = s OR coalesce(g2, ref) = s) THEN 'snp' WHEN NOT reference_cpg THEN 'denovo' ELSE 'cpg' END AS call,
  coalesce(CAST(printf('%.2f', beta) AS DOUBLE) > 0.5, false) AS methylated FROM (SELECT *, evidence AS s FROM methyl WHERE evidence IS NOT NULL)) GROUP BY call""",
        "covered", "verdicts", "alleles", extra=CALLED,
    ),
)
def bed_calls(spark: SparkSession, sf: str) -> DataFrame:
    calls = records.bed_calls(records.bed_rows(record_columns(spark, sf)))
    return calls.groupBy("call").agg(F.count(F.lit(1)).alias("n"), F.count_if("methylated").alias("n_methylated"))


_LEVELS = {
    "own": "SELECT contig, pos, coalesce(original_beta, denovo_beta) AS x FROM methyl WHERE in_cpg AND (original_beta IS NOT NULL OR denovo_beta IS NOT NULL)",
    "both_levels": """SELECT x, y FROM (SELECT contig, pos, CAST(printf('%.6g', x) AS DOUBLE) AS x FROM own WHERE pos % 7 <> 0) a
  FULL JOIN (SELECT contig, pos, beta_comp AS y FROM variants WHERE in_comp) b USING (contig, pos)""",
}


@query(
    "verify_written_levels",
    with_ctes(
        """SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_compared, count(*) FILTER (y IS NULL) AS n_predictions_only, count(*) FILTER (x IS NULL) AS n_competitor_only,
  round(corr(x, y) FILTER (x IS NOT NULL AND y IS NOT NULL), 6) AS pearson_r, round(pow(corr(x, y) FILTER (x IS NOT NULL AND y IS NOT NULL), 2), 6) AS r_squared,
  round(avg(abs(x - y)) FILTER (x IS NOT NULL AND y IS NOT NULL), 6) AS mean_abs_diff FROM both_levels""",
        "covered", "verdicts", "alleles", "variants", extra={**CALLED, **_LEVELS},
    ),
)
def verify_written_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels written to records, but those of every seventh position, against the levels of another call set."""
    levels = records.beta_records(written_lines(spark, sf)).where("pos % 7 <> 0")
    other = derived.variants(spark, sf).where("in_comp").select("contig", "pos", F.col("beta_comp").alias("beta"))
    out = verify.compare_levels(levels, other)
    return out.withColumns({c: F.round(c, 6) for c in ("pearson_r", "r_squared", "mean_abs_diff")})
