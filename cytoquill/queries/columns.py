"""Queries over observations and columns: filters, pileup, methylation, genotype, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.functions.bases import five_base_context
from cytoquill.functions.flags import baseq_passes, flags_pass, mapq_passes
from cytoquill.functions.text import two_decimals
from cytoquill.operators import calling, genotype, methylation, pileup
from cytoquill.params import CallParams, EndMask, ReadFilter, error_rate
from cytoquill.queries import derived
from cytoquill.queries.derived import with_ctes
from cytoquill.queries.registry import as_long, query, r6

POSITION = ["contig", "pos"]


def counted(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.counted_observations(derived.observations(spark, sf))


def columns(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.columns(counted(spark, sf), derived.reference_context(spark, sf))


def scored_alts(cols: DataFrame) -> DataFrame:
    """Alts with a stand-in score (twice the allele share) so calling can be compared exactly."""
    alts = pileup.alt_rows(cols)
    score = F.least(F.lit(1.0), 2.0 * F.col("alt.depth") / F.col("depth"))
    return alts.withColumn("score", score).withColumn("alt_filter", calling.alt_filter())


def called_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns with calls, neighbour marks and a simple genotype from the called alts."""
    share = lambda a: F.least(F.lit(1.0), 2.0 * a.depth / F.col("depth"))
    marked = methylation.mark_called_neighbours(calling.call_alts(columns(spark, sf), share))
    best = F.get("called", F.lit(0))
    alt_depth = pileup.allele_count(best, "depth")
    ref_depth = pileup.allele_count(F.col("ref"), "depth")
    pair = F.when(ref_depth * 5 < alt_depth, F.array(best, best)).otherwise(F.array(F.col("ref"), best))
    return marked.withColumn("genotype", F.when(F.size("called") > 0, pair))


# The same in SQL, for the queries that build on calls.
CALLED = {
    "calledset": """SELECT contig, pos, string_agg(alt, '' ORDER BY alt_rank) AS called, arg_min(alt, alt_rank) AS best,
    arg_min(alt_depth, alt_rank) AS best_depth FROM verdicts WHERE alt_filter = 'PASS' GROUP BY contig, pos""",
    "wide": """SELECT c.*, coalesce(s.called, '') AS called, s.best, s.best_depth,
    coalesce(rr.depth, 0) AS ref_depth FROM covered c LEFT JOIN calledset s USING (contig, pos)
    LEFT JOIN alleles rr ON rr.contig = c.contig AND rr.pos = c.pos AND rr.base = c.ref""",
    "marked": """SELECT w.*, coalesce(contains(b.called, 'C'), false) AS c_before, coalesce(contains(n.called, 'G'), false) AS g_after,
    CASE WHEN best IS NULL THEN NULL WHEN w.ref_depth*5 < w.best_depth THEN best ELSE w.ref END AS g1, best AS g2
  FROM wide w LEFT JOIN (SELECT contig, pos + 1 AS pos, called FROM wide) b USING (contig, pos)
  LEFT JOIN (SELECT contig, pos - 1 AS pos, called FROM wide) n USING (contig, pos)""",
    "sides": """SELECT m.*,
    CASE WHEN ref = 'C' AND (coalesce(after = 'G', false) OR g_after) THEN 'Original'
      WHEN contains(called, 'C') AND (coalesce(after = 'G', false) OR g_after) THEN 'DeNovo' END AS origin_c,
    CASE WHEN ref = 'G' AND (coalesce(before = 'C', false) OR c_before) THEN 'Original'
      WHEN contains(called, 'G') AND (coalesce(before = 'C', false) OR c_before) THEN 'DeNovo' END AS origin_g,
    coalesce(t.ot_next_g, 0) AS mod_c, coalesce(c.ot_next_g, 0) AS unmod_c, coalesce(a.ob_prev_c, 0) AS mod_g, coalesce(g.ob_prev_c, 0) AS unmod_g,
    coalesce(c.n_ob, 0) AS no_snp_c, coalesce(t.n_ob, 0) AS snp_c, coalesce(g.n_ot, 0) AS no_snp_g, coalesce(a.n_ot, 0) AS snp_g
  FROM marked m
    LEFT JOIN (SELECT contig, pos, ot_next_g, n_ob FROM alleles WHERE base = 'C') c USING (contig, pos)
    LEFT JOIN (SELECT contig, pos, ot_next_g, n_ob FROM alleles WHERE base = 'T') t USING (contig, pos)
    LEFT JOIN (SELECT contig, pos, ob_prev_c, n_ot FROM alleles WHERE base = 'G') g USING (contig, pos)
    LEFT JOIN (SELECT contig, pos, ob_prev_c, n_ot FROM alleles WHERE base = 'A') a USING (contig, pos)""",
    "levels": """SELECT *, CASE WHEN origin_c IS NULL OR mod_c + unmod_c = 0 THEN NULL
      WHEN origin_c = 'Original' AND g2 IS NOT NULL AND g1 <> ref AND g2 <> ref THEN 0.0
      WHEN g2 IS NOT NULL AND g1 <> g2 AND (g1 = 'T' OR g2 = 'T')
        THEN greatest(mod_c - (mod_c + unmod_c)/2.0, 0)/(unmod_c + greatest(mod_c - (mod_c + unmod_c)/2.0, 0))
      ELSE mod_c/(mod_c + unmod_c) END AS beta_c,
    CASE WHEN origin_g IS NULL OR mod_g + unmod_g = 0 THEN NULL
      WHEN origin_g = 'Original' AND g2 IS NOT NULL AND g1 <> ref AND g2 <> ref THEN 0.0
      WHEN g2 IS NOT NULL AND g1 <> g2 AND (g1 = 'A' OR g2 = 'A')
        THEN greatest(mod_g - (mod_g + unmod_g)/2.0, 0)/(unmod_g + greatest(mod_g - (mod_g + unmod_g)/2.0, 0))
      ELSE mod_g/(mod_g + unmod_g) END AS beta_g FROM sides""",
    "evid": """SELECT *, CASE WHEN origin_c IS NULL AND origin_g IS NULL THEN NULL WHEN origin_g IS NULL THEN 'C' WHEN origin_c IS NULL THEN 'G'
      WHEN (CASE WHEN mod_c + unmod_c > 0 THEN 0 ELSE 2 END) + (CASE WHEN origin_c = 'Original' THEN 0 ELSE 1 END)
        <= (CASE WHEN mod_g + unmod_g > 0 THEN 0 ELSE 2 END) + (CASE WHEN origin_g = 'Original' THEN 0 ELSE 1 END) THEN 'C' ELSE 'G' END AS evidence,
    CASE WHEN origin_c = 'Original' AND beta_c IS NOT NULL THEN beta_c WHEN origin_g = 'Original' THEN beta_g END AS original_beta,
    CASE WHEN origin_c = 'DeNovo' AND beta_c IS NOT NULL THEN beta_c WHEN origin_g = 'DeNovo' THEN beta_g END AS denovo_beta FROM levels""",
    "methyl": """SELECT *, evidence IS NOT NULL AS in_cpg, CASE evidence WHEN 'C' THEN unmod_c WHEN 'G' THEN unmod_g ELSE 0 END AS unmod,
    CASE evidence WHEN 'C' THEN mod_c WHEN 'G' THEN mod_g ELSE 0 END AS mod,
    CASE evidence WHEN 'C' THEN no_snp_c WHEN 'G' THEN no_snp_g ELSE 0 END AS no_snp,
    CASE evidence WHEN 'C' THEN snp_c WHEN 'G' THEN snp_g ELSE 0 END AS snp,
    CASE WHEN (evidence = 'C' AND origin_c = 'Original') OR (evidence = 'G' AND origin_g = 'Original') THEN original_beta
      WHEN evidence IS NOT NULL THEN denovo_beta END AS beta,
    coalesce((ref = 'C' AND after = 'G') OR (ref = 'G' AND before = 'C'), false) AS reference_cpg FROM evid""",
}


@query(
    "cpg_beta",
    with_ctes(
        """SELECT contig, pos, ref, unmod, mod, no_snp, snp, coverage, round(mod/nullif(mod + unmod, 0), 6) AS beta FROM (
  SELECT k.contig, k.pos, s.base AS ref,
    count(*) FILTER ((s.base = 'C' AND strand = 'OT' AND next_base = 'G' AND k.base = 'C') OR (s.base = 'G' AND strand = 'OB' AND prev_base = 'C' AND k.base = 'G')) AS unmod,
    count(*) FILTER ((s.base = 'C' AND strand = 'OT' AND next_base = 'G' AND k.base = 'T') OR (s.base = 'G' AND strand = 'OB' AND prev_base = 'C' AND k.base = 'A')) AS mod,
    count(*) FILTER ((s.base = 'C' AND strand = 'OB' AND k.base = 'C') OR (s.base = 'G' AND strand = 'OT' AND k.base = 'G')) AS no_snp,
    count(*) FILTER ((s.base = 'C' AND strand = 'OB' AND k.base = 'T') OR (s.base = 'G' AND strand = 'OT' AND k.base = 'A')) AS snp,
    count(*) AS coverage
  FROM counted k JOIN refctx s ON k.contig = s.contig AND k.pos = s.pos
  WHERE (s.base = 'C' AND s.after = 'G') OR (s.base = 'G' AND s.before = 'C') GROUP BY k.contig, k.pos, s.base)""",
        "counted", "refctx",
    ),
)
def cpg_beta(spark: SparkSession, sf: str) -> DataFrame:
    levels = methylation.reference_cpg_levels(counted(spark, sf), derived.reference_context(spark, sf))
    return levels.withColumn("beta", r6("beta"))


@query(
    "flag_mapq_filter",
    with_ctes(
        """SELECT contig, CAST(flag AS BIGINT) AS flag, count(*) AS n, count(*) FILTER (baseq IS NOT NULL AND baseq >= 10) AS n_good_base FROM obs
WHERE (flag & 3) = 3 AND (flag & 3852) = 0 AND (mapq = 255 OR mapq >= 20) GROUP BY contig, flag""",
        "obs",
    ),
)
def flag_mapq_filter(spark: SparkSession, sf: str) -> DataFrame:
    obs = derived.observations(spark, sf)
    kept = obs.where(flags_pass(F.col("flag"), 3, 3852) & mapq_passes(F.col("mapq"), 20))
    return kept.groupBy("contig", as_long("flag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(baseq_passes(F.col("baseq"), 10)).alias("n_good_base")
    )


@query(
    "unpaired_flag_filter",
    with_ctes(
        "SELECT CAST(flag AS BIGINT) AS flag, count(*) AS n FROM obs WHERE ((flag & ~227) & (3 & ~227)) = (3 & ~227) AND ((flag & ~227) & (3852 & ~227)) = 0 GROUP BY flag",
        "obs",
    ),
)
def unpaired_flag_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = derived.observations(spark, sf).where(flags_pass(F.col("flag"), 3, 3852, unpaired=True))
    return kept.groupBy(as_long("flag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_end_mask",
    with_ctes(
        """SELECT strand, CAST(flag AS BIGINT) AS flag, count(*) AS n, CAST(sum(qpos) AS BIGINT) AS sum_qpos FROM (
  SELECT *, CASE WHEN strand = 'OT' AND (flag & 16) = 0 THEN 10 WHEN strand = 'OT' THEN 25 WHEN strand = 'OB' AND (flag & 16) <> 0 THEN 6
    WHEN strand = 'OB' THEN 7 ELSE 0 END AS lo, CASE WHEN strand = 'OT' AND (flag & 16) = 0 THEN 20 WHEN strand = 'OT' THEN 15
    WHEN strand = 'OB' AND (flag & 16) <> 0 THEN 5 WHEN strand = 'OB' THEN 8 ELSE 0 END AS hi FROM obs)
WHERE qpos >= lo AND qpos < read_len - hi GROUP BY strand, flag""",
        "obs",
    ),
)
def read_end_mask(spark: SparkSession, sf: str) -> DataFrame:
    mask = EndMask(ot=(10, 20, 15, 25), ob=(5, 6, 7, 8))
    kept = pileup.mask_ends(derived.observations(spark, sf), mask)
    return kept.groupBy("strand", as_long("flag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("qpos").alias("sum_qpos"))


@query(
    "depth_cap",
    with_ctes(
        """SELECT contig, pos, count(*) AS kept, CAST(sum(read_id) AS BIGINT) AS id_sum, max(read_rank) AS deepest FROM (
  SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY read_start, read_id, tie) AS read_rank FROM filtered)
WHERE read_rank <= 12 GROUP BY contig, pos""",
        "filtered",
    ),
)
def depth_cap(spark: SparkSession, sf: str) -> DataFrame:
    capped = pileup.cap_depth(pileup.filter_reads(derived.observations(spark, sf), ReadFilter()), 12)
    return capped.groupBy(*POSITION).agg(
        F.count(F.lit(1)).alias("kept"), F.sum("read_id").alias("id_sum"), as_long(F.max("read_rank")).alias("deepest")
    )


@query(
    "overlap_dedup",
    with_ctes("SELECT contig, pos, frag, read_id, base, is_second FROM counted", "counted"),
)
def overlap_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return counted(spark, sf).select("contig", "pos", "frag", "read_id", "base", "is_second")


@query(
    "pileup_position",
    with_ctes("SELECT contig, pos, depth, round(baseq, 6) AS baseq, round(mapq, 6) AS mapq, mapq0 FROM covered", "covered"),
)
def pileup_position(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.position_metrics(counted(spark, sf)).withColumns({"baseq": r6("baseq"), "mapq": r6("mapq")})


@query(
    "pileup_allele",
    with_ctes(
        """SELECT contig, pos, base, depth, n_ot, n_ob, round(sqrt(bq2/depth), 6) AS baseq, round(sqrt(mq2/depth), 6) AS mapq,
  round(coalesce(sqrt(bq2_ot/nullif(n_ot, 0)), 0), 6) AS baseq_ot, round(coalesce(sqrt(bq2_ob/nullif(n_ob, 0)), 0), 6) AS baseq_ob,
  round(coalesce(sqrt(mq2_ot/nullif(n_ot, 0)), 0), 6) AS mapq_ot, round(coalesce(sqrt(mq2_ob/nullif(n_ob, 0)), 0), 6) AS mapq_ob,
  round(sqrt(al2/depth), 6) AS aligned, round(sqrt(in2/depth), 6) AS indels, round(sqrt(pir2/depth), 6) AS pos_in_read,
  ot_next_g, ob_prev_c, first_seen, round(depth/(sum(depth) OVER (PARTITION BY contig, pos)), 6) AS af FROM alleles""",
        "alleles",
    ),
)
def pileup_allele(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = pileup.allele_metrics(counted(spark, sf))
    rounded = {c: r6(c) for c in ("baseq", "mapq", "baseq_ot", "baseq_ob", "mapq_ot", "mapq_ob", "aligned", "indels", "pos_in_read")}
    share = r6(F.col("depth") / F.sum("depth").over(Window.partitionBy(*POSITION)))
    return rows.withColumns({**rounded, "first_seen": as_long("first_seen"), "af": share})


@query(
    "paired_counts",
    with_ctes(
        """SELECT contig, pos, 'before' AS side, strand, base AS cur, prev_base AS adj, count(*) AS n FROM counted
WHERE base IN ('A','C','G','T') AND prev_base IN ('A','C','G','T') AND strand IS NOT NULL GROUP BY ALL
UNION ALL SELECT contig, pos, 'after', strand, base, next_base, count(*) FROM counted
WHERE base IN ('A','C','G','T') AND next_base IN ('A','C','G','T') AND strand IS NOT NULL GROUP BY ALL""",
        "counted",
    ),
)
def paired_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.paired_counts(counted(spark, sf))


@query(
    "alt_ranking",
    with_ctes("SELECT contig, pos, ref, alt, CAST(alt_rank AS BIGINT) AS alt_rank, alt_depth FROM altrows", "altrows"),
)
def alt_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.alt_rows(columns(spark, sf)).select(
        "contig", "pos", "ref", F.col("alt.base").alias("alt"), as_long("alt_rank").alias("alt_rank"), F.col("alt.depth").alias("alt_depth")
    )


@query(
    "seq_entropy",
    with_ctes(
        """SELECT contig, pos, round(-(CASE WHEN c > 0 THEN c/n*log2(c/n) ELSE 0 END) - (CASE WHEN t > 0 THEN t/n*log2(t/n) ELSE 0 END)
  - (CASE WHEN a > 0 THEN a/n*log2(a/n) ELSE 0 END) - (CASE WHEN g > 0 THEN g/n*log2(g/n) ELSE 0 END), 6) + 0.0 AS entropy FROM (
  SELECT contig, pos, count(*) FILTER (base = 'C') OVER w AS c, count(*) FILTER (base = 'T') OVER w AS t,
    count(*) FILTER (base = 'A') OVER w AS a, count(*) FILTER (base = 'G') OVER w AS g, count(*) OVER w AS n FROM refb
  WINDOW w AS (PARTITION BY contig ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING))""",
        "refb",
    ),
)
def seq_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.sequence_entropy(derived.reference(spark, sf)).select("contig", "pos", r6("entropy").alias("entropy"))


@query(
    "seq_context",
    with_ctes("SELECT contig, pos, concat_ws('', before2, before, base, after, after2) AS sc5 FROM refctx", "refctx"),
)
def seq_context(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return derived.reference_context(spark, sf).select(
        "contig", "pos", five_base_context(c("before2"), c("before"), c("base"), c("after"), c("after2")).alias("sc5")
    )


@query(
    "reference_cpgs",
    with_ctes(
        "SELECT contig, pos, base AS side FROM refctx WHERE (base = 'C' AND after = 'G') OR (base = 'G' AND before = 'C')", "refctx"
    ),
)
def reference_cpgs(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.reference_cpgs(derived.reference_context(spark, sf)).select("contig", "pos", "side")


@query(
    "column_evidence",
    with_ctes(
        """SELECT c.contig, c.pos, CAST(a.alts IS NOT NULL AS BIGINT) AS has_alt,
  CAST((ref = 'C' AND (coalesce(after = 'G', false) OR coalesce(contains(n.alts, 'G'), false)))
    OR (ref = 'G' AND (coalesce(before = 'C', false) OR coalesce(contains(b.alts, 'C'), false))) AS BIGINT) AS has_cpg
FROM covered c LEFT JOIN altset a USING (contig, pos)
  LEFT JOIN (SELECT contig, pos + 1 AS pos, alts FROM altset) b USING (contig, pos)
  LEFT JOIN (SELECT contig, pos - 1 AS pos, alts FROM altset) n USING (contig, pos)""",
        "altrows", "covered",
        extra={"altset": "SELECT contig, pos, string_agg(alt, '') AS alts FROM altrows GROUP BY contig, pos"},
    ),
)
def column_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.column_evidence(columns(spark, sf)).select(
        "contig", "pos", as_long("has_alt").alias("has_alt"), as_long("has_cpg").alias("has_cpg")
    )


@query(
    "uncovered_cpgs",
    with_ctes(
        """SELECT contig, pos, base AS side FROM refctx r WHERE ((base = 'C' AND after = 'G') OR (base = 'G' AND before = 'C'))
AND NOT EXISTS (SELECT 1 FROM deep c WHERE c.contig = r.contig AND c.pos = r.pos)""",
        "covered", "refctx", extra={"deep": "SELECT contig, pos FROM covered WHERE depth >= 20"},
    ),
)
def uncovered_cpgs(spark: SparkSession, sf: str) -> DataFrame:
    deep = pileup.position_metrics(counted(spark, sf)).where("depth >= 20")
    return pileup.uncovered_cpgs(derived.reference_context(spark, sf), deep).select("contig", "pos", "side")


def _with_methylation(spark: SparkSession, sf: str) -> DataFrame:
    return methylation.methylation(called_columns(spark, sf))


@query(
    "strand_evidence",
    with_ctes("SELECT contig, pos, unmod, mod, no_snp, snp FROM methyl", "covered", "verdicts", "alleles", extra=CALLED),
)
def strand_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _with_methylation(spark, sf).select("contig", "pos", "unmod", "mod", "no_snp", "snp")


@query(
    "beta_het_excess",
    with_ctes(
        """SELECT contig, pos, ref, g1 || '/' || g2 AS genotype, round(beta_c, 6) AS beta_c, round(beta_g, 6) AS beta_g FROM methyl
WHERE origin_c IS NOT NULL OR origin_g IS NOT NULL""",
        "covered", "verdicts", "alleles", extra=CALLED,
    ),
)
def beta_het_excess(spark: SparkSession, sf: str) -> DataFrame:
    return _with_methylation(spark, sf).where("origin_C is not null or origin_G is not null").select(
        "contig", "pos", "ref", F.concat_ws("/", "genotype").alias("_g"), "genotype", r6("beta_C").alias("beta_c"), r6("beta_G").alias("beta_g")
    ).select("contig", "pos", "ref", F.when(F.col("genotype").isNotNull(), F.col("_g")).alias("genotype"), "beta_c", "beta_g")


@query(
    "two_cpg_origins",
    with_ctes(
        """SELECT contig, pos, evidence, round(original_beta, 6) AS original_beta, round(denovo_beta, 6) AS denovo_beta FROM methyl
WHERE evidence IS NOT NULL""",
        "covered", "verdicts", "alleles", extra=CALLED,
    ),
)
def two_cpg_origins(spark: SparkSession, sf: str) -> DataFrame:
    return _with_methylation(spark, sf).where("evidence is not null").select(
        "contig", "pos", "evidence", r6("original_beta").alias("original_beta"), r6("denovo_beta").alias("denovo_beta")
    )


@query(
    "denovo_partner",
    with_ctes(
        """SELECT contig, pos, ref, CAST(c_before AS BIGINT) AS c_before, CAST(g_after AS BIGINT) AS g_after,
  CASE WHEN reference_cpg THEN NULL WHEN ref = 'C' AND g_after THEN 'C' WHEN ref = 'G' AND c_before THEN 'G' END AS partner FROM methyl""",
        "covered", "verdicts", "alleles", extra=CALLED,
    ),
)
def denovo_partner(spark: SparkSession, sf: str) -> DataFrame:
    cols = _with_methylation(spark, sf)
    side = F.when(F.col("reference_cpg"), F.lit(None).cast("string")).when((F.col("ref") == "C") & F.col("g_after"), F.lit("C")).when(
        (F.col("ref") == "G") & F.col("c_before"), F.lit("G")
    )
    return cols.select("contig", "pos", "ref", as_long("c_before").alias("c_before"), as_long("g_after").alias("g_after"), side.alias("partner"))


@query(
    "hom_ref_gq",
    with_ctes(
        f"""SELECT contig, pos, n_ref, n_alt, CASE WHEN n_ref + n_alt > 0 THEN round(-10*log10(others/(1 + others)), 6) END AS gq FROM (
  SELECT *, pow(10.0, least(het - hr, 300.0)) + pow(10.0, least(ha - hr, 300.0)) AS others FROM (
    SELECT *, n_alt*log10({error_rate()}) + n_ref*log10(1 - {error_rate()}) AS hr, (n_ref + n_alt)*log10(0.5) AS het,
      n_ref*log10({error_rate()}) + n_alt*log10(1 - {error_rate()}) AS ha FROM (
      SELECT m.contig, m.pos, CASE WHEN in_cpg THEN no_snp ELSE coalesce(r.n_ot + r.n_ob, 0) END AS n_ref,
        CASE WHEN in_cpg THEN snp ELSE coalesce(o.n, 0) END AS n_alt
      FROM methyl m LEFT JOIN alleles r ON r.contig = m.contig AND r.pos = m.pos AND r.base = m.ref
      LEFT JOIN (SELECT contig, pos, CAST(sum(n_ot + n_ob) AS BIGINT) AS n FROM altrows GROUP BY contig, pos) o ON o.contig = m.contig AND o.pos = m.pos
      WHERE m.called = '')))""",
        "covered", "verdicts", "alleles", "altrows", extra=CALLED,
    ),
)
def hom_ref_gq(spark: SparkSession, sf: str) -> DataFrame:
    cols = _with_methylation(spark, sf).where(F.size("called") == 0)
    n_ref, n_alt = genotype.hom_ref_counts(cols)
    scored = genotype.add_hom_ref_quality(cols.withColumns({"n_ref": n_ref, "n_alt": n_alt}))
    return scored.select("contig", "pos", "n_ref", "n_alt", r6("hom_ref_gq").alias("gq"))


@query(
    "call_or_reject",
    with_ctes("SELECT contig, pos, ref, alt, alt_depth, round(score, 6) AS score, alt_filter FROM verdicts", "verdicts"),
)
def call_or_reject(spark: SparkSession, sf: str) -> DataFrame:
    return scored_alts(columns(spark, sf)).select(
        "contig", "pos", "ref", F.col("alt.base").alias("alt"), F.col("alt.depth").alias("alt_depth"), r6("score").alias("score"), "alt_filter"
    )


@query(
    "record_filter_matrix",
    with_ctes(
        """SELECT contig, pos, CAST(in_cpg OR var AS BIGINT) AS default_mode, CAST(in_cpg AS BIGINT) AS cpgs_mode,
  CAST(1 AS BIGINT) AS all_mode, CAST(in_cpg AS BIGINT) AS all_cpgs_mode FROM (
  SELECT *, len(replace(replace(called, CASE WHEN coalesce(after = 'G', false) OR g_after THEN 'C' ELSE '.' END, ''),
    CASE WHEN coalesce(before = 'C', false) OR c_before THEN 'G' ELSE '.' END, '')) > 0 AS var FROM methyl)""",
        "covered", "verdicts", "alleles", extra=CALLED,
    ),
)
def record_filter_matrix(spark: SparkSession, sf: str) -> DataFrame:
    cols = _with_methylation(spark, sf).withColumns({"has_called_indel": F.lit(False), "covered": F.col("depth") > 0})
    cols = cols.withColumn("is_variant", calling.is_variant())
    modes = {
        "default_mode": CallParams(), "cpgs_mode": CallParams(cpgs_only=True),
        "all_mode": CallParams(all_positions=True), "all_cpgs_mode": CallParams(all_positions=True, cpgs_only=True),
    }
    return cols.select("contig", "pos", *[as_long(calling.keeps_record(p)).alias(n) for n, p in modes.items()])


GL_SQL = """SELECT contig, pos, l0, l1, l2, greatest(l0, l1, l2) AS best FROM (SELECT contig, pos,
    round(r*log10(1 - 0.01) + a*log10(0.01), 6) AS l0, round((r + a)*log10(0.5), 6) AS l1, round(r*log10(0.01) + a*log10(1 - 0.01), 6) AS l2
  FROM (SELECT contig, pos, ref_depth AS r, coalesce(best_depth, 0) AS a FROM wide))"""


@query(
    "genotype_gl_to_pl",
    with_ctes(
        """SELECT contig, pos, CASE WHEN l2 > l1 THEN '1/1' ELSE '0/1' END AS gt,
  CAST(least(greatest(floor(10*(best - l0) + 0.5), 0), 255) AS BIGINT) AS pl_00, CAST(least(greatest(floor(10*(best - l1) + 0.5), 0), 255) AS BIGINT) AS pl_01,
  CAST(least(greatest(floor(10*(best - l2) + 0.5), 0), 255) AS BIGINT) AS pl_11,
  round(CASE WHEN wrong <= 1e-10 THEN 99.0 ELSE least(-10*log10(wrong), 99.0) END, 4) AS gq FROM (
  SELECT *, (w0 + w1 + w2 - CASE WHEN l2 > l1 THEN w2 ELSE w1 END)/(w0 + w1 + w2) AS wrong FROM (
    SELECT *, pow(10.0, l0 - best) AS w0, pow(10.0, l1 - best) AS w1, pow(10.0, l2 - best) AS w2 FROM gls))""",
        "covered", "verdicts", "alleles",
        extra={"calledset": CALLED["calledset"], "wide": CALLED["wide"], "gls": GL_SQL},
    ),
)
def genotype_gl_to_pl(spark: SparkSession, sf: str) -> DataFrame:
    cols = called_columns(spark, sf)
    r = pileup.allele_count(F.col("ref"), "depth")
    a = F.coalesce(pileup.allele_count(F.get("called", F.lit(0)), "depth"), F.lit(0))
    lo, hi, half = F.log10(F.lit(0.01)), F.log10(F.lit(1 - 0.01)), F.log10(F.lit(0.5))
    gl = F.array(F.round(r * hi + a * lo, 6), F.round((r + a) * half, 6), F.round(r * lo + a * hi, 6))
    out = genotype.from_likelihoods(cols.withColumn("gl", gl))
    return out.select(
        "contig", "pos", "gt", *[as_long(F.get("pl", F.lit(i))).alias(n) for i, n in enumerate(("pl_00", "pl_01", "pl_11"))],
        F.round("gq", 4).alias("gq"),
    )


@query(
    "bed_records",
    with_ctes(
        """SELECT contig, pos, pos + 1 AS stop, ref, CASE WHEN beta IS NULL THEN '' ELSE printf('%.2f', beta) END AS beta_est,
  CASE evidence WHEN 'C' THEN '+' ELSE '-' END AS strand, unmod, mod, no_snp, snp, depth AS coverage,
  CASE WHEN reference_cpg THEN 'REF' ELSE 'NEW' END AS cpg FROM methyl WHERE evidence IS NOT NULL""",
        "covered", "verdicts", "alleles", extra=CALLED,
    ),
)
def bed_records(spark: SparkSession, sf: str) -> DataFrame:
    cols = _with_methylation(spark, sf).where("in_cpg")
    return cols.select(
        "contig", "pos", (F.col("pos") + 1).alias("stop"), "ref",
        F.when(F.col("beta").isNull(), F.lit("")).otherwise(two_decimals(F.col("beta"))).alias("beta_est"),
        F.when(F.col("evidence") == "C", F.lit("+")).otherwise(F.lit("-")).alias("strand"),
        "unmod", "mod", "no_snp", "snp", F.col("depth").alias("coverage"),
        F.when(F.col("in_denovo_cpg") & ~F.col("reference_cpg"), F.lit("NEW")).otherwise(F.lit("REF")).alias("cpg"),
    )
