"""Queries over reads: the CIGAR walk, per-read methylation, strands and modification tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.functions.bases import reverse_complement
from cytoquill.functions.mixing import mix
from cytoquill.operators import modbam, perread, pileup
from cytoquill.operators import reads as read_ops
from cytoquill.params import ReadFilter
from cytoquill.queries import derived
from cytoquill.queries.derived import with_ctes
from cytoquill.queries.registry import as_long, query

NOVEL = f"{mix('(pos*3 + 7)*11')} % 9 = 0"
WALKED = {
    "kept": "SELECT * FROM readbase WHERE (flag & 3) = 3 AND (flag & 3852) = 0 AND (mapq = 255 OR mapq >= 1)",
    "nb": """SELECT *, lag(b) OVER w AS prev_base, lead(b) OVER w AS next_base FROM kept WINDOW w AS (PARTITION BY read_id ORDER BY q)""",
    "onsite": f"""SELECT k.*, CASE WHEN shape = 'clip' THEN q - 2 ELSE q END AS rel,
    CASE WHEN r.base = 'C' AND r.after = 'G' THEN 'C' WHEN r.base = 'G' AND r.before = 'C' THEN 'G' END AS site, {mix('(r.pos*3 + 7)*11')} % 9 = 0 AS novel,
    CASE WHEN strand = 'OT' THEN CASE b WHEN 'T' THEN 1 WHEN 'C' THEN 0 END ELSE CASE b WHEN 'A' THEN 1 WHEN 'G' THEN 0 END END AS shown
  FROM kept k JOIN refctx r ON k.contig = r.contig AND k.src_pos = r.pos WHERE aligned""",
    "kinds": """SELECT *, CASE WHEN site = (CASE strand WHEN 'OT' THEN 'C' ELSE 'G' END) THEN
      CASE WHEN shown IS NULL THEN 'snp' WHEN shown = 1 THEN 'mod' ELSE 'unmod' END
    WHEN novel AND shown = 1 THEN 'modn' WHEN novel AND shown = 0 THEN 'unmodn' END AS kind FROM onsite""",
}


def kept_reads(spark: SparkSession, sf: str) -> DataFrame:
    return read_ops.with_strand(read_ops.select_reads(derived.reads(spark, sf), ReadFilter()))


def site_calls(spark: SparkSession, sf: str) -> DataFrame:
    """CpG calls over the reference: its own CpGs, and every ninth other position as a de-novo one."""
    ref = derived.reference_context(spark, sf)
    cpg = F.expr("coalesce((base = 'C' and after = 'G') or (base = 'G' and before = 'C'), false)")
    return ref.withColumn("call", F.when(F.expr(NOVEL), F.lit("denovo")).when(cpg, F.lit("cpg"))).select("contig", "pos", "call").where("call is not null")


@query(
    "aligned_bases",
    with_ctes(
        """SELECT read_id, contig, src_pos AS pos, q AS qpos, b AS base, prev_base, next_base, bq AS baseq, strand FROM nb WHERE aligned""",
        "readbase", extra={k: WALKED[k] for k in ("kept", "nb")},
    ),
)
def aligned_bases(spark: SparkSession, sf: str) -> DataFrame:
    return read_ops.walk(kept_reads(spark, sf)).select(
        "read_id", "contig", "pos", "qpos", "base", "prev_base", "next_base", "baseq", "strand"
    )


@query(
    "indel_observations",
    with_ctes(
        """SELECT contig, start + anchor AS pos, shape AS kind, CAST(2 AS BIGINT) AS indel_len, CASE WHEN shape = 'ins' THEN 'CA' ELSE '' END AS bases, count(*) AS n
FROM mates WHERE shape IN ('ins', 'del') AND (flag & 3) = 3 AND (flag & 3852) = 0 AND (mapq = 255 OR mapq >= 1) GROUP BY ALL""",
        "mates",
    ),
)
def indel_observations(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_ops.indel_observations(kept_reads(spark, sf))
    return rows.groupBy("contig", "pos", "kind", as_long("indel_len").alias("indel_len"), "bases").agg(F.count(F.lit(1)).alias("n"))


def _lists(kind: str) -> str:
    return f"coalesce(string_agg(CAST(rel AS STRING), ',' ORDER BY rel) FILTER (kind = '{kind}'), '')"


@query(
    "per_read_methylation",
    with_ctes(
        f"""SELECT contig, CAST(start + CASE WHEN shape = 'clip' THEN 2 ELSE 0 END AS BIGINT) AS start, qname AS read_id, CAST(mapq AS BIGINT) AS mapq,
  CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS orientation, abs(tlen) AS insert_size, CAST(flag AS BIGINT) AS flag, count(kind) AS num_cpg,
  count(*) FILTER (kind IN ('mod', 'modn')) AS num_mod, {_lists('mod')} AS mod_cpgs, {_lists('unmod')} AS unmod_cpgs, {_lists('snp')} AS snp_cpgs,
  {_lists('modn')} AS mod_denovos, {_lists('unmodn')} AS unmod_denovos FROM kinds GROUP BY read_id, contig, start, shape, qname, mapq, flag, tlen HAVING count(kind) > 0""",
        "readbase", "refctx", extra={k: WALKED[k] for k in ("kept", "onsite", "kinds")},
    ),
)
def per_read_methylation(spark: SparkSession, sf: str) -> DataFrame:
    rows = perread.per_read(derived.reads(spark, sf), derived.reference_context(spark, sf), site_calls(spark, sf))
    return perread.as_text(rows).select(
        "contig", "start", "read_id", as_long("mapq").alias("mapq"), "orientation", "insert_size", as_long("flag").alias("flag"),
        as_long("num_cpg").alias("num_cpg"), as_long("num_mod").alias("num_mod"), *perread.LISTS,
    )


@query(
    "strand_guess",
    with_ctes(
        f"""SELECT read_id, tg, ca, CASE WHEN tg > ca THEN 'OT' WHEN tg < ca THEN 'OB' WHEN {mix('read_id*7 + pos*13 + flag')} % 2 = 0 THEN 'OT' ELSE 'OB' END AS strand FROM (
  SELECT read_id, start + CASE WHEN shape = 'clip' THEN 2 ELSE 0 END AS pos, flag,
    count(*) FILTER (mism AND b || coalesce(next_base, '.') = 'TG') + count(*) FILTER (mism AND coalesce(prev_base, '.') || b = 'TG') AS tg,
    count(*) FILTER (mism AND b || coalesce(next_base, '.') = 'CA') + count(*) FILTER (mism AND coalesce(prev_base, '.') || b = 'CA') AS ca
  FROM (SELECT *, coalesce(aligned AND ref_base IN ('A','C','G','T') AND b <> ref_base, false) AS mism FROM nb) GROUP BY 1, 2, 3)""",
        "readbase", extra={k: WALKED[k] for k in ("kept", "nb")},
    ),
)
def strand_guess(spark: SparkSession, sf: str) -> DataFrame:
    ref = derived.reference(spark, sf)
    reads = kept_reads(spark, sf)
    guessed = read_ops.guess_strand(reads, ref).select("read_id", "strand")
    votes = read_ops.motif_evidence(
        read_ops.walk(reads).join(ref.withColumnRenamed("base", "ref_base"), ["contig", "pos"], "left")
    )
    return guessed.join(votes, "read_id").select("read_id", "tg", "ca", "strand")


@query(
    "strand_from_flags",
    with_ctes(
        """SELECT CAST(flag AS BIGINT) AS flag, CASE WHEN (flag & 96) = 96 OR (flag & 144) = 144 THEN 'OT' ELSE 'OB' END AS by_flag,
  CASE WHEN (flag & 1) = 0 OR (flag & 12) <> 0 THEN NULL WHEN ((flag & 16) = 0) = ((flag & 32) = 0) THEN NULL
    WHEN ((flag & 64) <> 0 AND (flag & 16) = 0) OR ((flag & 64) = 0 AND (flag & 32) = 0) THEN 'OT' ELSE 'OB' END AS by_orientation, count(*) AS n
FROM mates GROUP BY flag""",
        "mates",
    ),
)
def strand_from_flags(spark: SparkSession, sf: str) -> DataFrame:
    reads = derived.reads(spark, sf).select("flag", "contig")
    by_flag = read_ops.with_strand(reads).withColumnRenamed("strand", "by_flag")
    both = read_ops.with_strand(by_flag, from_orientation=True).withColumnRenamed("strand", "by_orientation")
    return both.groupBy(as_long("flag").alias("flag"), "by_flag", "by_orientation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "reverse_complement",
    "SELECT doc_id, reverse(translate(regexp_replace(text, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCATGCA')) AS rc FROM documents",
)
def reverse_complement_query(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "documents").select("doc_id", reverse_complement(F.col("text")).alias("rc"))


_MM = """SELECT read_id, seq, CASE WHEN n > 0 THEN (CASE WHEN (strand = 'OT') <> rev THEN 'C+m,' ELSE 'G-m,' END) || skips || ';' END AS mm FROM (
  SELECT k.read_id, k.strand, (k.flag & 16) <> 0 AS rev, any_value(s.seq) AS seq, count(skip) AS n, string_agg(CAST(skip AS STRING), ',' ORDER BY ord) AS skips
  FROM (SELECT DISTINCT read_id, strand, flag FROM kept) k JOIN seqs s USING (read_id)
  LEFT JOIN (SELECT read_id, ord, ord - coalesce(lag(ord) OVER (PARTITION BY read_id ORDER BY ord), -1) - 1 AS skip FROM ords WHERE m) o ON o.read_id = k.read_id
  GROUP BY k.read_id, k.strand, k.flag)"""
MODTAGS = {
    "kept": WALKED["kept"],
    "callset": f"""SELECT contig, pos, CASE WHEN {NOVEL} THEN 'denovo' ELSE 'cpg' END AS call, before2, before, after, after2 FROM refctx
  WHERE {NOVEL} OR coalesce((base = 'C' AND after = 'G') OR (base = 'G' AND before = 'C'), false)""",
    "marked": """SELECT k.*, c.call, c.before2, c.before, c.after, c.after2, CASE WHEN c.call IS NULL OR NOT aligned THEN NULL WHEN strand = 'OT' THEN
      CASE b WHEN 'T' THEN true WHEN 'C' THEN false END ELSE CASE b WHEN 'A' THEN true WHEN 'G' THEN false END END AS meth
  FROM kept k LEFT JOIN callset c ON k.contig = c.contig AND k.src_pos = c.pos""",
    "fixed": """SELECT *, CASE WHEN meth THEN CASE strand WHEN 'OT' THEN 'C' ELSE 'G' END ELSE b END AS nb FROM marked""",
    "seqs": "SELECT read_id, string_agg(nb, '' ORDER BY q) AS seq FROM fixed GROUP BY read_id",
    "ords": """SELECT read_id, coalesce(meth, false) AS m, row_number() OVER (PARTITION BY read_id ORDER BY CASE WHEN (flag & 16) <> 0 THEN -q ELSE q END) - 1 AS ord
  FROM fixed WHERE nb = CASE strand WHEN 'OT' THEN 'C' ELSE 'G' END""",
}


@query("modbam_mm", with_ctes(_MM, "readbase", "refctx", extra=MODTAGS))
def modbam_mm(spark: SparkSession, sf: str) -> DataFrame:
    tagged = modbam.modification_tags(kept_reads(spark, sf), site_calls(spark, sf))
    return tagged.select("read_id", F.col("new_seq").alias("seq"), "mm")


@query(
    "modbam_xm",
    with_ctes(
        """SELECT read_id, string_agg(CASE WHEN meth IS NULL THEN '.' WHEN meth THEN ctx ELSE lower(ctx) END, '' ORDER BY q) AS xm,
  CASE WHEN (any_value(flag) & 64) <> 0 THEN 'CT' ELSE 'GA' END AS xr, CASE any_value(strand) WHEN 'OB' THEN 'GA' ELSE 'CT' END AS xg FROM (
  SELECT *, CASE WHEN call = 'cpg' THEN 'Z' WHEN strand = 'OT' THEN CASE WHEN after = 'G' THEN 'Z' WHEN after2 = 'G' THEN 'X' ELSE 'H' END
    ELSE CASE WHEN before = 'C' THEN 'Z' WHEN before2 = 'C' THEN 'X' ELSE 'H' END END AS ctx FROM marked) GROUP BY read_id""",
        "readbase", "refctx", extra={k: MODTAGS[k] for k in ("kept", "callset", "marked")},
    ),
)
def modbam_xm(spark: SparkSession, sf: str) -> DataFrame:
    tagged = modbam.bisulfite_style_tags(kept_reads(spark, sf), site_calls(spark, sf), derived.reference_context(spark, sf))
    return tagged.select("read_id", "xm", "xr", "xg")


@query(
    "read_level_beta",
    with_ctes(
        """SELECT contig, pos, count(*) FILTER (mod) AS mod, count(*) FILTER (NOT mod) AS unmod FROM (
  SELECT contig, src_pos AS pos, CASE WHEN site = 'C' THEN b = 'T' ELSE b = 'A' END AS mod FROM onsite
  WHERE site IS NOT NULL AND bq >= 10 AND ((site = 'C' AND strand = 'OT' AND b IN ('C', 'T')) OR (site = 'G' AND strand = 'OB' AND b IN ('G', 'A')))) GROUP BY ALL""",
        "readbase", "refctx", extra={k: WALKED[k] for k in ("kept", "onsite")},
    ),
)
def read_level_beta(spark: SparkSession, sf: str) -> DataFrame:
    """Converted and unconverted reads per reference CpG, counted read by read (no mate removal)."""
    bases = read_ops.walk(kept_reads(spark, sf)).where("baseq >= 10")
    sites = pileup.reference_cpgs(derived.reference_context(spark, sf)).select("contig", "pos", "side")
    hits = bases.join(sites, ["contig", "pos"]).where(
        "(side = 'C' and strand = 'OT' and base in ('C', 'T')) or (side = 'G' and strand = 'OB' and base in ('G', 'A'))"
    )
    mod = F.col("base").isin("T", "A")
    return hits.groupBy("contig", "pos").agg(F.count_if(mod).alias("mod"), F.count_if(~mod).alias("unmod"))


@query(
    "clip_rescue",
    with_ctes(
        """SELECT contig, src_pos AS pos, read_id, q AS qpos, b AS base, bq AS baseq, strand FROM kept JOIN (SELECT contig AS rc, pos AS rp, base AS rb, before AS rbef, after AS raft FROM refctx) r
  ON rc = contig AND rp = src_pos WHERE shape = 'clip' AND q = 1 AND ((rb = 'C' AND raft = 'G' AND strand = 'OT' AND b IN ('C', 'T')) OR (rb = 'G' AND rbef = 'C' AND strand = 'OB' AND b IN ('G', 'A')))""",
        "readbase", "refctx", extra={"kept": WALKED["kept"]},
    ),
)
def clip_rescue(spark: SparkSession, sf: str) -> DataFrame:
    rescued = read_ops.clip_rescue(kept_reads(spark, sf), derived.reference_context(spark, sf))
    return rescued.select("contig", "pos", "read_id", "qpos", "base", "baseq", "strand")


@query(
    "reads_per_base",
    with_ctes(
        """SELECT round(sum(n)/sum(length), 6) AS reads_per_base FROM (SELECT contig, count(*) AS n FROM mates WHERE (flag & 4) = 0 GROUP BY contig)
JOIN (SELECT contig, count(*) AS length FROM refb GROUP BY contig) USING (contig)""",
        "mates", "refb",
    ),
)
def reads_per_base(spark: SparkSession, sf: str) -> DataFrame:
    lengths = derived.reference(spark, sf).groupBy("contig").agg(F.count(F.lit(1)).alias("length"))
    return read_ops.reads_per_covered_base(derived.reads(spark, sf), lengths).select(F.round("reads_per_base", 6).alias("reads_per_base"))


@query(
    "duplicate_rows",
    with_ctes(
        "SELECT contig, CAST(flag AS BIGINT) AS flag, CAST(mapq AS BIGINT) AS mapq, count(*) AS n_reads, count(DISTINCT qname) AS n_fragments FROM mates GROUP BY ALL",
        "mates",
    ),
)
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Reads and distinct fragments by flag and quality, after every row was added twice and made unique again."""
    reads = derived.reads(spark, sf).select("contig", "flag", "mapq", "qname", "pos", "cigar", "seq", "tlen")
    unique = reads.unionByName(reads).dropDuplicates()
    return unique.groupBy("contig", as_long("flag").alias("flag"), as_long("mapq").alias("mapq")).agg(
        F.count(F.lit(1)).alias("n_reads"), F.count_distinct("qname").alias("n_fragments")
    )
