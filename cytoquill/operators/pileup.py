"""From observations (read bases over positions) to per-position columns.

All per-position steps run behind one shuffle on (contig, pos): the depth cap is a row_number window that
Spark limits map-side before shuffling, and mate removal, allele counts and column assembly reuse its
partitioning. No task ever holds more than the capped reads of a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoquill.functions.bases import KNOWN, known, taken_side
from cytoquill.functions.flags import baseq_passes, flags_pass, mapq_passes, mapq_value
from cytoquill.functions.stats import rms
from cytoquill.operators import tiling
from cytoquill.params import CallParams, EndMask, ReadFilter

POSITION = ["contig", "pos"]
READ_ORDER = ["read_start", "read_id", "tie"]
#: Up to this many rows Spark limits a window before its shuffle; larger caps are ranked in two steps.
ONE_STEP_CAP = 1000
CAP_SALTS = 64


def filter_reads(df: DataFrame, keep: ReadFilter) -> DataFrame:
    """Flags and mapping quality; works on reads and on observations alike."""
    return df.where(
        flags_pass(F.col("flag"), keep.include_flags, keep.exclude_flags, keep.unpaired)
        & mapq_passes(F.col("mapq"), keep.min_mapq)
    )


def cap_depth(obs: DataFrame, max_coverage: int) -> DataFrame:
    """Keep the earliest-starting reads of every position (0 keeps all) and number them in `read_rank`."""
    order = Window.partitionBy(*POSITION).orderBy(*READ_ORDER)
    if max_coverage > ONE_STEP_CAP:
        # A position is ranked within shares of its reads first, so that no task sees all of a deep one.
        salted = obs.withColumn("_salt", F.pmod(F.xxhash64("read_id", "tie"), F.lit(CAP_SALTS)))
        share = Window.partitionBy(*POSITION, "_salt").orderBy(*READ_ORDER)
        obs = salted.withColumn("_k", F.row_number().over(share)).where(F.col("_k") <= max_coverage).drop("_salt", "_k")
    ranked = obs.withColumn("read_rank", F.row_number().over(order))
    return ranked.where(F.col("read_rank") <= max_coverage) if max_coverage else ranked


def end_mask_range(strand: Column, flag: Column, read_len: Column, mask: EndMask) -> tuple[Column, Column, Column]:
    """First kept offset, one past the last, and whether anything is kept. An unknown strand is never masked."""
    reverse = flag.bitwiseAND(F.lit(16)) != 0

    def by_read(end: int) -> Column:
        # A reverse read stores its 3' end first, so its two ends are swapped.
        ot = F.when(reverse, mask.ot[2 + (1 - end)]).otherwise(mask.ot[end])
        ob = F.when(reverse, mask.ob[1 - end]).otherwise(mask.ob[2 + end])
        return F.when(strand == "OT", ot).when(strand == "OB", ob).otherwise(0)

    first, past = by_read(0), read_len - by_read(1)
    return first, past, past > first


def mask_ends(obs: DataFrame, mask: EndMask) -> DataFrame:
    if mask == EndMask():
        return obs
    first, past, _ = end_mask_range(F.col("strand"), F.col("flag"), F.col("read_len"), mask)
    return obs.where((F.col("qpos") >= first) & (F.col("qpos") < past))


def drop_overlapping_mates(obs: DataFrame) -> DataFrame:
    """Count a fragment once per position.

    Mates that agree are represented by the earlier read; mates that disagree by the first in the template.
    Expects `read_rank` and runs inside the (contig, pos) partitioning it came with.
    """
    mates = Window.partitionBy(*POSITION, "frag").orderBy("read_rank")
    whole = mates.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    disagree = F.min("base").over(whole) != F.max("base").over(whole)
    template_first = F.min(F.col("is_second") * (1 << 32) + F.col("read_rank")).over(whole) % (1 << 32)
    chosen = F.when(disagree, template_first).otherwise(F.min("read_rank").over(whole))
    return obs.withColumn("_chosen", chosen).where(F.col("_chosen") == F.col("read_rank")).drop("_chosen")


def counted_observations(obs: DataFrame, params: CallParams = CallParams(), keep_overlaps: bool = False) -> DataFrame:
    """The observations every statistic is taken over, in the order the filters apply."""
    capped = cap_depth(filter_reads(obs, params.reads), params.max_coverage)
    rescued = F.col("rescued") if "rescued" in obs.columns else F.lit(False)
    good = capped.where(baseq_passes(F.col("baseq"), params.min_baseq))
    if params.mask != EndMask():
        first, past, _ = end_mask_range(F.col("strand"), F.col("flag"), F.col("read_len"), params.mask)
        good = good.where(rescued | ((F.col("qpos") >= first) & (F.col("qpos") < past)))
    return good if keep_overlaps else drop_overlapping_mates(good)


def position_metrics(counted: DataFrame) -> DataFrame:
    """Depth, RMS qualities and mapping-quality-zero reads per position."""
    return counted.groupBy(*POSITION).agg(
        F.count(F.lit(1)).alias("depth"),
        rms(F.col("baseq")).alias("baseq"),
        rms(mapq_value(F.col("mapq"))).alias("mapq"),
        F.count_if(F.col("mapq") == 0).alias("mapq0"),
    )


def _allele_sums(counted: DataFrame) -> DataFrame:
    """Plain sums per position and base; every RMS and ratio downstream is made from these."""
    bq, mq = F.col("baseq").cast("double"), mapq_value(F.col("mapq")).cast("double")
    rel = F.col("qpos").cast("double") / F.col("read_len")
    ot, ob = F.col("strand") == "OT", F.col("strand") == "OB"
    return counted.groupBy(*POSITION, "base").agg(
        F.count(F.lit(1)).alias("depth"),
        F.count_if(ot).alias("n_ot"),
        F.count_if(ob).alias("n_ob"),
        F.sum(bq * bq).alias("bq2"),
        F.sum(mq * mq).alias("mq2"),
        F.sum(F.when(ot, bq * bq)).alias("bq2_ot"),
        F.sum(F.when(ob, bq * bq)).alias("bq2_ob"),
        F.sum(F.when(ot, mq * mq)).alias("mq2_ot"),
        F.sum(F.when(ob, mq * mq)).alias("mq2_ob"),
        F.sum(F.col("aligned").cast("double") * F.col("aligned")).alias("al2"),
        F.sum(F.col("indels").cast("double") * F.col("indels")).alias("in2"),
        F.sum(rel * rel).alias("pir2"),
        F.count_if(F.col("mapq") == 0).alias("mapq0"),
        F.count_if(ot & (F.col("next_base") == "G")).alias("ot_next_g"),
        F.count_if(ob & (F.col("prev_base") == "C")).alias("ob_prev_c"),
        F.min("read_rank").alias("first_seen"),
    )


def _root_mean(total: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.sqrt(F.col(total) / F.col(n))).otherwise(F.lit(0.0))


ALLELE_FIELDS = [
    "base", "depth", "n_ot", "n_ob", "baseq", "mapq", "baseq_ot", "baseq_ob", "mapq_ot", "mapq_ob",
    "aligned", "indels", "pos_in_read", "ot_next_g", "ob_prev_c", "first_seen",
]


def _with_allele_means(sums: DataFrame) -> DataFrame:
    return sums.withColumns(
        {
            "baseq": _root_mean("bq2", "depth"),
            "mapq": _root_mean("mq2", "depth"),
            "baseq_ot": _root_mean("bq2_ot", "n_ot"),
            "baseq_ob": _root_mean("bq2_ob", "n_ob"),
            "mapq_ot": _root_mean("mq2_ot", "n_ot"),
            "mapq_ob": _root_mean("mq2_ob", "n_ob"),
            "aligned": _root_mean("al2", "depth"),
            "indels": _root_mean("in2", "depth"),
            "pos_in_read": _root_mean("pir2", "depth"),
        }
    )


def allele_metrics(counted: DataFrame) -> DataFrame:
    """Support of every base at every position, overall and per strand."""
    return _with_allele_means(_allele_sums(counted)).select(*POSITION, *ALLELE_FIELDS)


def paired_counts(counted: DataFrame) -> DataFrame:
    """Reads by strand, base and the base beside it in the read; unknown bases take no part."""
    sides = F.array(
        F.struct(F.lit("before").alias("side"), F.col("prev_base").alias("adj")),
        F.struct(F.lit("after").alias("side"), F.col("next_base").alias("adj")),
    )
    exploded = counted.where(known(F.col("base")) & F.col("strand").isNotNull()).withColumn("_s", F.explode(sides))
    return (
        exploded.where(known(F.col("_s.adj")))
        .groupBy(*POSITION, F.col("_s.side").alias("side"), "strand", F.col("base").alias("cur"), F.col("_s.adj").alias("adj"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def columns(counted: DataFrame, ref: DataFrame) -> DataFrame:
    """One row per covered position: reference context, position metrics, `ref_allele` and ordered `alts`.

    `ref` holds contig, pos, base, before2, before, after, after2. Alts are ordered by depth, then by the
    read that showed them first.
    """
    alleles = _with_allele_means(_allele_sums(counted))
    allele = F.struct(*ALLELE_FIELDS)
    per_position = alleles.groupBy(*POSITION).agg(
        F.collect_list(allele).alias("alleles"),
        F.sum("depth").alias("depth"),
        F.sqrt(F.sum("bq2") / F.sum("depth")).alias("baseq"),
        F.sqrt(F.sum("mq2") / F.sum("depth")).alias("mapq"),
        F.sum("mapq0").alias("mapq0"),
    )
    joined = per_position.join(ref.withColumnRenamed("base", "ref"), POSITION)
    order = lambda a, b: (
        F.when(a.depth != b.depth, F.when(a.depth > b.depth, -1).otherwise(1))
        .when(a.first_seen < b.first_seen, -1).when(a.first_seen > b.first_seen, 1).otherwise(0)
    )
    return joined.withColumns(
        {
            **{f"allele_{b}": _first(F.filter("alleles", _shows(b))) for b in KNOWN},
            "alts": F.array_sort(
                F.filter("alleles", lambda a: (a.base != F.col("ref")) & a.base.isin(*KNOWN)), order
            ),
        }
    ).withColumn("ref_allele", by_base(F.col("ref")))


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _shows(base: str):
    return lambda a: a.base == base


def by_base(base: Column) -> Column:
    """The allele struct of a base known only at run time; NULL if no read shows it."""
    picked = F.when(base == "A", F.col("allele_A"))
    for b in KNOWN[1:]:
        picked = picked.when(base == b, F.col(f"allele_{b}"))
    return picked


def allele_count(base: Column | str, field: str) -> Column:
    """A number of the allele showing `base`, 0 if no read does. The four alleles are columns of their own,
    so this is a plain field access."""
    if isinstance(base, str):
        return F.coalesce(F.col(f"allele_{base}")[field], F.lit(0))
    picked = F.when(base == "A", F.col("allele_A")[field])
    for b in KNOWN[1:]:
        picked = picked.when(base == b, F.col(f"allele_{b}")[field])
    return F.coalesce(picked, F.lit(0))


def alt_rows(cols: DataFrame) -> DataFrame:
    """One row per alt of every column."""
    return cols.select("*", F.posexplode("alts").alias("alt_rank", "alt"))


def column_evidence(cols: DataFrame) -> DataFrame:
    """Add `has_alt`, `has_cpg` and `has_indel`: a column with none of them needs no processing.

    A CpG counts if the reference has it or a *candidate* alt next door, or an inserted base, would make it.
    `cols` may carry `inserted_first` / `inserted_last`, the end bases of insertions anchored at the column.
    """
    alt_bases = F.transform("alts", lambda a: a.base)
    empty = F.array().cast("array<string>")
    first = F.col("inserted_first") if "inserted_first" in cols.columns else empty
    last = F.col("inserted_last") if "inserted_last" in cols.columns else empty
    prepared = cols.withColumns({"_alts": alt_bases, "_first": first, "_last": last})
    near = tiling.with_neighbours(prepared, {"_b": ("_alts", -1), "_bi": ("_last", -1), "_a": ("_alts", 1)})
    has = lambda array, base: F.coalesce(F.array_contains(F.col(array), base), F.lit(False))
    c_before = F.coalesce(F.col("before") == "C", F.lit(False)) | has("_b", "C") | has("_bi", "C")
    g_after = F.coalesce(F.col("after") == "G", F.lit(False)) | has("_a", "G") | has("_first", "G")
    indel = (F.size("indels_seen") > 0) if "indels_seen" in cols.columns else F.lit(False)
    return near.withColumns(
        {
            "has_alt": F.size("alts") > 0,
            "has_cpg": ((F.col("ref") == "C") & g_after) | ((F.col("ref") == "G") & c_before),
            "has_indel": indel,
        }
    ).drop("_alts", "_first", "_last", "_b", "_bi", "_a")


def reference_cpgs(ref: DataFrame) -> DataFrame:
    """Positions whose reference base takes a CpG side, with that side."""
    side = taken_side(F.col("base"), F.col("before"), F.col("after"))
    return ref.withColumn("side", side).where(F.col("side").isNotNull())


def uncovered_cpgs(ref: DataFrame, cols: DataFrame) -> DataFrame:
    """Reference CpG positions no read reaches."""
    return reference_cpgs(ref).join(cols.select(*POSITION), POSITION, "left_anti")


def sequence_entropy(ref: DataFrame, radius: int = 50) -> DataFrame:
    """Shannon entropy of the bases within `radius`; N counts towards the window size only."""
    one = {b: F.sum(F.when(F.col("base") == b, 1).otherwise(0)) for b in "CTAG"}
    counted = tiling.with_range_aggregates(
        ref, {**{f"_n{b}": agg for b, agg in one.items()}, "_n": F.count(F.lit(1))}, radius
    )
    total = F.lit(0.0)
    for b in "CTAG":
        share = F.col(f"_n{b}") / F.col("_n")
        total = total - F.when(F.col(f"_n{b}") > 0, share * F.log2(share)).otherwise(F.lit(0.0))
    return counted.withColumn("entropy", total).drop("_n", *[f"_n{b}" for b in "CTAG"])


def with_uncovered_cpgs(cols: DataFrame, ref: DataFrame) -> DataFrame:
    """Columns plus one empty column, depth 0, per reference CpG position no read reaches."""
    empty = uncovered_cpgs(ref, cols).select("contig", "pos", F.col("base").alias("ref"), "before2", "before", "after", "after2")
    kinds = {f.name: f.dataType for f in cols.schema}
    empty = empty.withColumns(
        {
            "depth": F.lit(0).cast(kinds["depth"]),
            "mapq0": F.lit(0).cast(kinds["mapq0"]),
            "alleles": F.array().cast(kinds["alleles"]),
            "alts": F.array().cast(kinds["alts"]),
        }
    )
    return cols.unionByName(empty, allowMissingColumns=True)
