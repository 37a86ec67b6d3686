"""CpG sides, methylation levels and de-novo CpGs over columns.

A column can take up to two CpG sides. `Original` is the reference base's own (in a reference CpG, or
beside a called alt that makes one), `DeNovo` a called alt's. No level is NULL, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquill.functions.bases import SIDE_MOD, SIDE_UNMOD
from cytoquill.operators import tiling
from cytoquill.operators.pileup import allele_count, reference_cpgs


def _in(array: Column, base: str) -> Column:
    return F.coalesce(F.array_contains(array, base), F.lit(False))


def mark_called_neighbours(cols: DataFrame) -> DataFrame:
    """Add `c_before` / `g_after`: whether a called alt or insertion next door puts a C before or a G after.

    Reads only neighbours' calls, never its own output, so one look-up in each direction is exact.
    Expects `called` (array of called alt bases); `called_inserted_first` / `called_inserted_last` optional.
    """
    empty = F.array().cast("array<string>")
    have = set(cols.columns)
    prepared = cols.withColumns(
        {
            "_first": F.col("called_inserted_first") if "called_inserted_first" in have else empty,
            "_last": F.col("called_inserted_last") if "called_inserted_last" in have else empty,
        }
    )
    near = tiling.with_neighbours(prepared, {"_b": ("called", -1), "_bl": ("_last", -1), "_a": ("called", 1)})
    return near.withColumns(
        {
            "c_before": _in(F.col("_b"), "C") | _in(F.col("_bl"), "C"),
            "g_after": _in(F.col("_a"), "G") | _in(F.col("_first"), "G"),
        }
    ).drop("_first", "_last", "_b", "_bl", "_a")


def _beside(side: str) -> Column:
    """Whether the neighbour completing `side` is there, in the reference or by a call."""
    if side == "C":
        return F.coalesce(F.col("after") == "G", F.lit(False)) | F.col("g_after")
    return F.coalesce(F.col("before") == "C", F.lit(False)) | F.col("c_before")


def side_origin(side: str) -> Column:
    called = _in(F.col("called"), side)
    return F.when((F.col("ref") == side) & _beside(side), F.lit("Original")).when(called & _beside(side), F.lit("DeNovo"))


def side_reads(side: str) -> tuple[Column, Column]:
    """(modified, unmodified) reads of a side: on its converting strand, next to its partner in the read."""
    field = "ot_next_g" if side == "C" else "ob_prev_c"
    return allele_count(SIDE_MOD[side], field), allele_count(SIDE_UNMOD[side], field)


def plain_reads(side: str) -> tuple[Column, Column]:
    """(no SNP, SNP) reads of a side: the strand the conversion leaves alone."""
    field = "n_ob" if side == "C" else "n_ot"
    return allele_count(SIDE_UNMOD[side], field), allele_count(SIDE_MOD[side], field)


def adjusted_level(mod: Column, unmod: Column, origin: Column, carries_ref: Column, confounded: Column) -> Column:
    """Methylation level under a genotype; NULL without reads.

    A reference CpG on no chromosome has level 0. Where one chromosome carries the base a methylated read
    shows, half of the reads are taken as the variant's and only the excess counts as methylated.
    """
    total = mod + unmod
    excess = F.greatest(mod - total / 2.0, F.lit(0.0))
    return (
        F.when(total == 0, F.lit(None).cast("double"))
        .when((origin == "Original") & ~carries_ref, F.lit(0.0))
        .when(confounded, excess / F.nullif(unmod + excess, F.lit(0.0)))
        .otherwise(mod / F.nullif(total, F.lit(0)))
    )


def methylation(cols: DataFrame) -> DataFrame:
    """Add per-side origins and reads, levels per origin, the evidence side and its strand counts.

    Expects `called`, `c_before`, `g_after`, and `genotype`: array of the two carried bases or NULL.
    """
    gt = F.col("genotype")
    known_gt = gt.isNotNull()
    carries_ref = F.coalesce(~known_gt | F.array_contains(gt, F.col("ref")), F.lit(True))
    het = F.coalesce(F.get(gt, F.lit(0)) != F.get(gt, F.lit(1)), F.lit(False))
    sides: dict[str, Column] = {}
    for side in ("C", "G"):
        mod, unmod = side_reads(side)
        plain, snp = plain_reads(side)
        sides |= {
            f"origin_{side}": side_origin(side), f"mod_{side}": mod, f"unmod_{side}": unmod,
            f"no_snp_{side}": plain, f"snp_{side}": snp,
        }
    staged = cols.withColumns(sides).withColumns(
        {
            f"beta_{side}": F.when(
                F.col(f"origin_{side}").isNotNull(),
                adjusted_level(
                    F.col(f"mod_{side}"), F.col(f"unmod_{side}"), F.col(f"origin_{side}"), carries_ref,
                    het & _in(gt, SIDE_MOD[side]),
                ),
            )
            for side in ("C", "G")
        }
    )

    def slot(origin: str, value: str) -> Column:
        # Two sides of the same origin: the C side's level stands if it has one.
        c = (F.col("origin_C") == origin) & F.col("beta_C").isNotNull()
        g = (F.col("origin_G") == origin) & F.col("beta_G").isNotNull()
        return F.when(c, F.col(f"{value}_C")).when(g, F.col(f"{value}_G"))

    def rank(side: str) -> Column:
        # Evidence: a side with reads first, then the reference's own, then C.
        silent = F.when(F.col(f"mod_{side}") + F.col(f"unmod_{side}") > 0, 0).otherwise(2)
        later = F.when(F.col(f"origin_{side}") == "Original", 0).otherwise(1)
        return F.when(F.col(f"origin_{side}").isNotNull(), silent + later)

    c_rank, g_rank = rank("C"), rank("G")
    evidence = F.when(c_rank.isNotNull() & (g_rank.isNull() | (c_rank <= g_rank)), F.lit("C")).when(
        g_rank.isNotNull(), F.lit("G")
    )
    staged = staged.withColumns(
        {
            **{
                f"{name}_{value}": slot(origin, value)
                for name, origin in (("original", "Original"), ("denovo", "DeNovo"))
                for value in ("beta", "mod", "unmod")
            },
            "evidence": evidence,
        }
    )
    pick = lambda value: F.when(F.col("evidence") == "C", F.col(f"{value}_C")).when(
        F.col("evidence") == "G", F.col(f"{value}_G")
    )
    ref_cpg = ((F.col("ref") == "C") & (F.col("after") == "G")) | ((F.col("ref") == "G") & (F.col("before") == "C"))
    return staged.withColumns(
        {
            "in_cpg": F.col("evidence").isNotNull(),
            "reference_cpg": F.coalesce(ref_cpg, F.lit(False)),
            "evidence_origin": pick("origin"),
            "unmod": F.coalesce(pick("unmod"), F.lit(0)),
            "mod": F.coalesce(pick("mod"), F.lit(0)),
            "no_snp": F.coalesce(pick("no_snp"), F.lit(0)),
            "snp": F.coalesce(pick("snp"), F.lit(0)),
        }
    ).withColumns(
        {
            "in_denovo_cpg": F.coalesce(
                (F.col("origin_C") == "DeNovo"), F.lit(False)
            ) | F.coalesce(F.col("origin_G") == "DeNovo", F.lit(False)) | (F.col("in_cpg") & ~F.col("reference_cpg") & (
                ((F.col("ref") == "C") & F.col("g_after")) | ((F.col("ref") == "G") & F.col("c_before"))
            )),
            "beta": F.when(F.col("evidence_origin") == "Original", F.col("original_beta")).when(
                F.col("evidence_origin") == "DeNovo", F.col("denovo_beta")
            ),
        }
    )


def reference_cpg_levels(counted: DataFrame, ref: DataFrame) -> DataFrame:
    """The short path for reference CpGs only: one hash aggregate of four conditional counts.

    Needs no alleles, calls or genotypes, so it prunes to the CpG positions before aggregating.
    """
    sites = reference_cpgs(ref).select("contig", "pos", F.col("base").alias("ref"), "side")
    hits = counted.join(sites, ["contig", "pos"])
    on_c, on_g = F.col("side") == "C", F.col("side") == "G"
    converting = (on_c & (F.col("strand") == "OT") & (F.col("next_base") == "G")) | (
        on_g & (F.col("strand") == "OB") & (F.col("prev_base") == "C")
    )
    plain = (on_c & (F.col("strand") == "OB")) | (on_g & (F.col("strand") == "OT"))
    mod = F.col("base") == F.when(on_c, "T").otherwise("A")
    unmod = F.col("base") == F.col("side")
    counts = hits.groupBy("contig", "pos", "ref").agg(
        F.count_if(converting & unmod).alias("unmod"),
        F.count_if(converting & mod).alias("mod"),
        F.count_if(plain & unmod).alias("no_snp"),
        F.count_if(plain & mod).alias("snp"),
        F.count(F.lit(1)).alias("coverage"),
    )
    return counts.withColumn("beta", F.col("mod") / F.nullif(F.col("mod") + F.col("unmod"), F.lit(0)))
