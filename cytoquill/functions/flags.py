"""Alignment flags, mapping quality and strand as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cytoquill.params import MAPQ_UNAVAILABLE, MAPQ_UNAVAILABLE_AS, PAIR_BITS


def has_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == bits


def flags_pass(flag: Column, include: int, exclude: int, unpaired: bool = False) -> Column:
    if unpaired:
        include, exclude = include & ~PAIR_BITS, exclude & ~PAIR_BITS
        flag = flag.bitwiseAND(F.lit(~PAIR_BITS & 0xFFFF))
    return has_bits(flag, include) & (flag.bitwiseAND(F.lit(exclude)) == 0)


def mapq_passes(mapq: Column, minimum: int) -> Column:
    return (mapq == MAPQ_UNAVAILABLE) | (mapq >= minimum)


def mapq_value(mapq: Column) -> Column:
    """Mapping quality for arithmetic: an unavailable one counts as a good one."""
    return F.when(mapq == MAPQ_UNAVAILABLE, F.lit(MAPQ_UNAVAILABLE_AS)).otherwise(mapq)


def baseq_passes(baseq: Column, minimum: int) -> Column:
    return F.coalesce(baseq >= minimum, F.lit(False))


def strand_of_pair(flag: Column, unpaired: bool = False) -> Column:
    """OT for forward first / reverse second mates, otherwise OB."""
    if unpaired:
        return F.when(has_bits(flag, 16), F.lit("OB")).otherwise(F.lit("OT"))
    return F.when(has_bits(flag, 96) | has_bits(flag, 144), F.lit("OT")).otherwise(F.lit("OB"))


def strand_of_orientation(
    flag: Column, same_contig: Column, exclude_ambiguous: bool = False, unpaired: bool = False
) -> Column:
    """Strand from how two mapped mates face each other.

    A forward first mate facing a reverse second one is OT, the mirror image OB, and two mates in the
    same direction have no strand. Where there is no placed pair to look at, the flags alone decide.
    """
    if unpaired:
        return strand_of_pair(flag, unpaired=True)
    reverse, mate_reverse = has_bits(flag, 16), has_bits(flag, 32)
    first, last = has_bits(flag, 64), has_bits(flag, 128)
    placed_pair = has_bits(flag, 1) & (flag.bitwiseAND(F.lit(12)) == 0) & F.coalesce(same_contig, F.lit(False))
    first_is_forward = F.when(first, ~reverse).otherwise(~mate_reverse)
    facing = F.when(reverse == mate_reverse, F.lit(None).cast("string")).otherwise(
        F.when(first_is_forward, F.lit("OT")).otherwise(F.lit("OB"))
    )
    if exclude_ambiguous:
        return F.when(placed_pair, facing)
    by_flag = F.when((first & mate_reverse) | (last & reverse), F.lit("OT")).when(
        (first & reverse) | (last & mate_reverse), F.lit("OB")
    )
    return F.when(placed_pair, facing).otherwise(by_flag)
