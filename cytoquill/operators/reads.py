"""Alignments: CIGARs, tags, strands and the walk from reads to observations.

Everything is a JVM-side expression over the read row plus two explodes (operation, then base); reads are
never grouped, so no read set is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquill.functions.flags import flags_pass, has_bits, mapq_passes, strand_of_orientation, strand_of_pair
from cytoquill.functions.mixing import mix
from cytoquill.operators import tiling
from cytoquill.params import ReadFilter

READ_COLUMNS = "read_id bigint, qname string, flag int, contig string, pos bigint, mapq int, cigar string, mate_contig string, mate_pos bigint, tlen bigint, seq string, qual array<int>, tags map<string,string>"

QUERY_OPS = "('M','I','S','=','X')"
REFERENCE_OPS = "('M','D','N','=','X')"
MATCH_OPS = "('M','=','X')"


def parsed_cigar(cigar: str = "cigar") -> Column:
    """CIGAR text as array<struct<op, len>>."""
    return F.expr(
        f"transform(regexp_extract_all({cigar}, '[0-9]+[MIDNSHP=X]', 0),"
        " x -> named_struct('op', right(x, 1), 'len', cast(substr(x, 1, length(x) - 1) as int)))"
    )


def cigar_length(ops: str, kinds: str) -> str:
    return f"aggregate({ops}, 0, (n, x) -> n + CASE WHEN x.op IN {kinds} THEN x.len ELSE 0 END)"


def with_reference_span(reads: DataFrame) -> DataFrame:
    """Add `end`, one past the last reference base the alignment covers."""
    return reads.withColumn("_ops", parsed_cigar()).withColumn("end", F.expr(f"pos + {cigar_length('_ops', REFERENCE_OPS)}")).drop("_ops")


def _tag_matches(wanted: str) -> str:
    text = wanted.replace("'", "''")
    return (
        "CASE WHEN v IS NULL THEN false"
        f" WHEN substr(v, 1, 1) IN ('Z', 'H', 'A') THEN substr(v, 3) = '{text}'"
        f" WHEN substr(v, 1, 1) = 'i' THEN coalesce(try_cast(substr(v, 3) AS bigint) = try_cast('{text}' AS bigint), false)"
        f" WHEN substr(v, 1, 1) = 'f' THEN coalesce(try_cast(substr(v, 3) AS double) = try_cast('{text}' AS double), false)"
        " ELSE false END"
    )


def tags_match(required: tuple[tuple[str, str], ...]) -> Column:
    """All TAG=VALUE pairs hold. `tags` maps a tag to its SAM text (`Z:text`, `i:7`, ...); arrays never match."""
    test = F.lit(True)
    for tag, value in required:
        if len(tag) != 2:
            raise ValueError(f"{tag!r} is not a two-letter tag")
        seen = f"try_element_at(tags, '{tag}')"
        test = test & F.expr(_tag_matches(value).replace("(v, ", f"({seen}, ").replace("WHEN v IS NULL", f"WHEN {seen} IS NULL"))
    return test


def parse_tag_requirement(text: str) -> tuple[str, str]:
    tag, sep, value = text.partition("=")
    if not sep or len(tag) != 2:
        raise ValueError(f"{text!r} is not of the form TAG=VALUE")
    return tag, value


def select_reads(reads: DataFrame, keep: ReadFilter) -> DataFrame:
    """Flag, mapping quality, tag and length filters, all pushed below any join or explode."""
    out = reads.where(
        flags_pass(F.col("flag"), keep.include_flags, keep.exclude_flags, keep.unpaired)
        & mapq_passes(F.col("mapq"), keep.min_mapq)
    )
    if keep.require_tags:
        out = out.where(tags_match(keep.require_tags))
    if keep.max_read_length:
        out = out.where(F.length("seq") <= keep.max_read_length)
    return out


def with_strand(
    reads: DataFrame, from_orientation: bool = False, exclude_ambiguous: bool = False, unpaired: bool = False
) -> DataFrame:
    """Add `strand`, by pair flags (the caller) or by how the mates face each other (per-read output)."""
    if not from_orientation:
        return reads.withColumn("strand", strand_of_pair(F.col("flag"), unpaired))
    same = F.col("mate_contig") == F.col("contig") if "mate_contig" in reads.columns else F.lit(True)
    return reads.withColumn("strand", strand_of_orientation(F.col("flag"), same, exclude_ambiguous, unpaired))


def walk(reads: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per aligned base: read columns needed downstream plus `pos`, `qpos`, base, neighbours, quality."""
    prepared = reads.withColumn("_ops", parsed_cigar()).withColumns(
        {
            "_steps": F.expr(
                "transform(_ops, (x, i) -> named_struct('op', x.op, 'len', x.len,"
                f" 'q', {cigar_length('slice(_ops, 1, i)', QUERY_OPS).replace('(n, x)', '(n, y)').replace('x.op IN', 'y.op IN').replace('THEN x.len', 'THEN y.len')},"
                f" 'r', pos + {cigar_length('slice(_ops, 1, i)', REFERENCE_OPS).replace('(n, x)', '(n, y)').replace('x.op IN', 'y.op IN').replace('THEN x.len', 'THEN y.len')}))"
            ),
            "aligned": F.expr(cigar_length("_ops", MATCH_OPS)).cast("bigint"),
            "indels": F.expr(cigar_length("_ops", "('I','D')")).cast("bigint"),
            "read_len": F.length("seq").cast("bigint"),
            "lead_clip": F.expr("CASE WHEN _ops[0].op = 'H' AND size(_ops) > 1 AND _ops[1].op = 'S' THEN _ops[0].len + _ops[1].len"
                                " WHEN _ops[0].op IN ('S', 'H') THEN _ops[0].len ELSE 0 END"),
            "read_start": F.col("pos"),
        }
    )
    return prepared.withColumn("_m", F.expr(f"explode(filter(_steps, s -> s.op IN {MATCH_OPS} AND s.len > 0))")).withColumn(
        "_k", F.expr("explode(sequence(0, _m.len - 1))")
    ).select(
        "contig",
        (F.col("_m.r") + F.col("_k")).alias("pos"),
        "read_id",
        *extra,
        "flag",
        "mapq",
        "strand",
        "read_start",
        "read_len",
        "aligned",
        "indels",
        "lead_clip",
        (F.col("_m.q") + F.col("_k")).cast("bigint").alias("qpos"),
        F.expr("substr(seq, cast(_m.q + _k + 1 as int), 1)").alias("base"),
        F.expr("CASE WHEN _m.q + _k > 0 THEN substr(seq, cast(_m.q + _k as int), 1) END").alias("prev_base"),
        F.expr("CASE WHEN _m.q + _k + 1 < read_len THEN substr(seq, cast(_m.q + _k + 2 as int), 1) END").alias("next_base"),
        F.expr("get(qual, cast(_m.q + _k as int))").cast("bigint").alias("baseq"),
    )


def observations(reads: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Aligned bases in the layout the column operators expect. `reads` carries qname and strand."""
    return walk(reads, ("qname", *extra)).withColumns(
        {
            "frag": fragment(),
            "is_second": F.when(has_bits(F.col("flag"), 128), 1).otherwise(0).cast("bigint"),
            "tie": F.lit(0).cast("bigint"),
            "rescued": F.lit(False),
        }
    )


#: Positions that stay together when reads meet sites; about as many as a short read covers.
SITE_BIN = 64


def observations_at(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """The `observations` over some positions (contig, pos; each once). `reads` carries `end`.

    Reads move once, to the stretches of sites they cover, and are walked once there; what is not asked for is never a row of a shuffle.
    """
    stretches = sites.groupBy("contig", F.expr(f"pos div {SITE_BIN}").alias("_bin")).agg(F.collect_set("pos").alias("_sites"))
    bins = F.explode(F.expr(f"sequence(pos div {SITE_BIN}, greatest(end - 1, pos) div {SITE_BIN})"))
    met = reads.withColumn("_bin", bins).join(stretches, ["contig", "_bin"])
    return observations(met, ("_sites",)).where(F.array_contains("_sites", F.col("pos"))).drop("_sites")


def clip_rescue(reads: DataFrame, ref: DataFrame) -> DataFrame:
    """The one soft-clipped base beside each end of the alignment, where it completes a CpG reading.

    Same layout as `observations`. Such a base skips the read-end mask, not the quality filter.
    """
    ops = reads.withColumn("_ops", parsed_cigar()).withColumn("_span", F.expr(cigar_length("_ops", REFERENCE_OPS)))
    core = ops.withColumn("_clips", F.expr("filter(_ops, x -> x.op <> 'H')")).withColumns(
        {
            "_lead": F.expr("CASE WHEN _clips[0].op = 'S' THEN _clips[0].len ELSE 0 END"),
            "_tail": F.expr("CASE WHEN size(_clips) > 1 AND element_at(_clips, -1).op = 'S' THEN element_at(_clips, -1).len ELSE 0 END"),
            "read_len": F.length("seq").cast("bigint"),
            "aligned": F.expr(cigar_length("_ops", MATCH_OPS)).cast("bigint"),
            "indels": F.expr(cigar_length("_ops", "('I','D')")).cast("bigint"),
            "read_start": F.col("pos"),
        }
    )
    fringe = core.withColumn(
        "_f",
        F.expr(
            "explode(filter(array(CASE WHEN _lead > 0 AND pos > 0 THEN named_struct('p', pos - 1, 'q', cast(_lead - 1 as bigint)) END,"
            " CASE WHEN _tail > 0 THEN named_struct('p', pos + _span, 'q', read_len - _tail) END), f -> f IS NOT NULL))"
        ),
    )
    placed = fringe.select(
        "contig", F.col("_f.p").alias("pos"), "read_id", "qname", "flag", "mapq", "strand", "read_start", "read_len", "aligned", "indels",
        F.lit(0).alias("lead_clip"), F.col("_f.q").alias("qpos"),
        F.expr("substr(seq, cast(_f.q + 1 as int), 1)").alias("base"),
        F.expr("CASE WHEN _f.q > 0 THEN substr(seq, cast(_f.q as int), 1) END").alias("prev_base"),
        F.expr("CASE WHEN _f.q + 1 < read_len THEN substr(seq, cast(_f.q + 2 as int), 1) END").alias("next_base"),
        F.expr("get(qual, cast(_f.q as int))").cast("bigint").alias("baseq"),
        fragment().alias("frag"),
        F.when(has_bits(F.col("flag"), 128), 1).otherwise(0).cast("bigint").alias("is_second"),
        F.lit(0).cast("bigint").alias("tie"),
        F.lit(True).alias("rescued"),
    )
    sites = ref.where("(base = 'C' and after = 'G') or (base = 'G' and before = 'C')").select("contig", "pos", F.col("base").alias("_ref"))
    return placed.join(sites, ["contig", "pos"]).where(
        "(_ref = 'C' and strand = 'OT' and base in ('C', 'T')) or (_ref = 'G' and strand = 'OB' and base in ('G', 'A'))"
    ).drop("_ref")


def fragment() -> Column:
    """What mates share. A read without a name has no mate, so it is a fragment of its own."""
    return F.coalesce("qname", F.concat(F.lit("\u0001"), F.col("read_id").cast("string")))


def indel_observations(reads: DataFrame) -> DataFrame:
    """One row per insertion or deletion of a read, anchored on the base before it.

    `bases` is the inserted sequence; a deletion is identified by its length.
    """
    steps = reads.withColumn("_ops", parsed_cigar()).withColumn(
        "_at",
        F.expr(
            "explode(filter(transform(_ops, (x, i) -> named_struct('op', x.op, 'len', x.len, 'i', i,"
            f" 'q', aggregate(slice(_ops, 1, i), 0, (n, y) -> n + CASE WHEN y.op IN {QUERY_OPS} THEN y.len ELSE 0 END),"
            f" 'r', pos + aggregate(slice(_ops, 1, i), 0, (n, y) -> n + CASE WHEN y.op IN {REFERENCE_OPS} THEN y.len ELSE 0 END))),"
            " s -> s.op IN ('I', 'D') AND s.i > 0))"
        ),
    )
    return steps.select(
        "contig",
        (F.col("_at.r") - 1).alias("pos"),
        "read_id",
        "qname",
        fragment().alias("frag"),
        F.col("pos").alias("read_start"),
        has_bits(F.col("flag"), 128).alias("is_second"),
        "flag",
        F.when(F.col("_at.op") == "I", F.lit("ins")).otherwise(F.lit("del")).alias("kind"),
        F.col("_at.len").alias("indel_len"),
        F.expr("CASE WHEN _at.op = 'I' THEN substr(seq, cast(_at.q + 1 as int), _at.len) ELSE '' END").alias("bases"),
    )


def motif_evidence(bases: DataFrame) -> DataFrame:
    """TG and CA pairs around mismatches per read. `bases` is walked and carries `ref_base`."""
    known = F.col("ref_base").isin("A", "C", "G", "T") & F.col("base").isin("A", "C", "G", "T")
    mismatch = known & (F.col("ref_base") != F.col("base"))
    after, before = F.concat("base", F.coalesce("next_base", F.lit("."))), F.concat(F.coalesce("prev_base", F.lit(".")), "base")
    one = lambda hit: F.when(mismatch & hit, 1).otherwise(0)
    return bases.groupBy("read_id").agg(
        F.sum(one(after == "TG") + one(before == "TG")).alias("tg"),
        F.sum(one(after == "CA") + one(before == "CA")).alias("ca"),
    )


def guess_strand(reads: DataFrame, ref: DataFrame) -> DataFrame:
    """Replace `strand` by what the mismatches suggest; ties fall to a hash of the read."""
    named = ref.select("contig", "pos", F.col("base").alias("ref_base"))
    blank = reads.withColumn("strand", F.lit(None).cast("string"))
    votes = motif_evidence(walk(blank).join(named, ["contig", "pos"], "left"))
    coin = F.expr(f"{mix('read_id*7 + pos*13 + flag')} % 2")
    return blank.join(votes, "read_id", "left").withColumn(
        "strand",
        F.when(F.col("tg") > F.col("ca"), F.lit("OT")).when(F.col("tg") < F.col("ca"), F.lit("OB"))
        .otherwise(F.when(coin == 0, F.lit("OT")).otherwise(F.lit("OB"))),
    ).drop("tg", "ca")


def reads_per_covered_base(reads: DataFrame, lengths: DataFrame) -> DataFrame:
    """Mapped reads over the summed lengths of the contigs that hold any."""
    mapped = reads.where((F.col("flag").bitwiseAND(F.lit(4))) == 0).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))
    return mapped.join(lengths, "contig").agg((F.sum("n") / F.nullif(F.sum("length"), F.lit(0))).alias("reads_per_base"))
