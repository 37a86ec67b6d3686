"""Bases, CpG sides, contexts and strings over them, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the conversion does on each side of a CpG. The C side is read on the OT strand
# next to a following G; the G side on OB next to a preceding C.
SIDE_UNMOD = {"C": "C", "G": "G"}
SIDE_MOD = {"C": "T", "G": "A"}
SIDE_PARTNER = {"C": "G", "G": "C"}
KNOWN = ("A", "C", "G", "T")


def known(base: Column) -> Column:
    return base.isin(*KNOWN)


def side_value(side: Column, table: dict[str, str]) -> Column:
    return F.when(side == "C", F.lit(table["C"])).when(side == "G", F.lit(table["G"]))


def taken_side(base: Column, before: Column, after: Column) -> Column:
    """The CpG side `base` takes given its neighbours: 'C' before a G, 'G' after a C, else NULL."""
    return F.when((base == "C") & (after == "G"), F.lit("C")).when((base == "G") & (before == "C"), F.lit("G"))


def read_methylated(side: Column, observed: Column) -> Column:
    """TRUE for the converted base, FALSE for the unconverted one, NULL for any other."""
    return F.when(observed == side_value(side, SIDE_MOD), F.lit(True)).when(
        observed == side_value(side, SIDE_UNMOD), F.lit(False)
    )


def is_conversion(side: Column, alt: Column) -> Column:
    """An alt that looks like the conversion of the reference's own CpG side."""
    return F.coalesce(alt == side_value(side, SIDE_MOD), F.lit(False))


def complement(base: Column) -> Column:
    return F.translate(F.upper(base), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    """Everything that is not A, C, G or T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCATGCA"))


def five_base_context(b2: Column, b1: Column, ref: Column, a1: Column, a2: Column) -> Column:
    """The five reference bases around a position; missing flanks are left out."""
    return F.concat_ws("", b2, b1, ref, a1, a2)


def cytosine_context(strand: Column, before2: Column, before1: Column, after1: Column, after2: Column) -> Column:
    """CG / CHG / CHH of a cytosine read on `strand`; what is not known to be the former is CHH."""
    near = F.when(strand == "OB", complement(before1)).otherwise(after1)
    far = F.when(strand == "OB", complement(before2)).otherwise(after2)
    return F.when(near == "G", F.lit("CG")).when(far == "G", F.lit("CHG")).otherwise(F.lit("CHH"))


# Letters of the XM tag, methylated upper case.
XM_LETTERS = {"CG": "Z", "CHG": "X", "CHH": "H"}


def xm_letter(context: Column, methylated: Column) -> Column:
    letter = F.lit(None).cast("string")
    for name, upper in XM_LETTERS.items():
        letter = F.when(context == name, F.when(methylated, upper).otherwise(upper.lower())).otherwise(letter)
    return F.coalesce(letter, F.lit("."))
