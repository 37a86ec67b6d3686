"""Base-modification tags on reads, in the MM/ML and in the older XM/XR/XG form.

`calls` holds contig, pos and `call` ('cpg', 'denovo' or anything else). All work is per read: the called
bases are gathered per read (bounded by its length) and the strings are built by array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquill.functions.bases import cytosine_context, read_methylated, reverse_complement, xm_letter
from cytoquill.functions.flags import has_bits
from cytoquill.operators import reads as read_ops


def _side() -> Column:
    return F.when(F.col("strand") == "OT", F.lit("C")).when(F.col("strand") == "OB", F.lit("G"))


def called_bases(reads: DataFrame, calls: DataFrame) -> DataFrame:
    """Walked bases over CpG calls whose base shows a methylation state."""
    sites = calls.where("call in ('cpg', 'denovo')").select("contig", "pos", "call").dropDuplicates(["contig", "pos"])
    on_site = read_ops.walk(reads).where(F.col("strand").isNotNull()).join(sites, ["contig", "pos"])
    return on_site.withColumn("methylated", read_methylated(_side(), F.col("base"))).where("methylated is not null")


def _skips(seq: Column, base: Column, wanted: Column) -> Column:
    """How many of `base` to skip before each wanted position, counted from the previous one."""
    where = F.filter(
        F.transform(F.split(seq, ""), lambda b, i: F.when(b == base, i)), lambda i: i.isNotNull()
    )
    ordinals = F.filter(
        F.transform(where, lambda p, i: F.when(F.array_contains(wanted, p), i)), lambda i: i.isNotNull()
    )
    return F.transform(ordinals, lambda o, i: F.when(i == 0, o).otherwise(o - F.get(ordinals, i - 1) - 1))


def modification_tags(reads: DataFrame, calls: DataFrame) -> DataFrame:
    """Reads with SEQ rewritten to unconverted bases and `mm` / `ml` tags, NULL where nothing is methylated.

    Offsets count from the 5' end of the original read, so a reverse read is flipped together with its strand.
    """
    gathered = (
        called_bases(reads, calls).where("methylated").groupBy("read_id").agg(F.array_sort(F.collect_set(F.col("qpos").cast("int"))).alias("_at"))
    )
    joined = reads.join(gathered, "read_id", "left").withColumn("_at", F.coalesce("_at", F.array().cast("array<int>")))
    unmod = _side()
    rewritten = F.concat_ws(
        "", F.transform(F.split("seq", ""), lambda b, i: F.when(F.array_contains("_at", i), unmod).otherwise(b))
    )
    out = joined.withColumn("new_seq", F.when(F.size("_at") > 0, rewritten).otherwise(F.col("seq")))
    reverse = has_bits(F.col("flag"), 16)
    read_seq = F.when(reverse, reverse_complement(F.col("new_seq"))).otherwise(F.col("new_seq"))
    read_at = F.when(reverse, F.transform("_at", lambda p: F.length("seq") - 1 - p)).otherwise(F.col("_at"))
    on_top = (F.col("strand") == "OT") != reverse
    base = F.when(on_top, F.lit("C")).otherwise(F.lit("G"))
    out = out.withColumns({"_seq": read_seq, "_pos": read_at, "_base": base}).withColumn("_skips", _skips(F.col("_seq"), F.col("_base"), F.col("_pos")))
    prefix = F.when(on_top, F.lit("C+m,")).otherwise(F.lit("G-m,"))
    some = F.size("_skips") > 0
    return out.withColumns(
        {
            "mm": F.when(some, F.concat(prefix, F.concat_ws(",", F.transform("_skips", lambda x: x.cast("string"))), F.lit(";"))),
            "ml": F.when(some, F.transform("_skips", lambda x: F.lit(255))),
        }
    ).drop("_at", "_seq", "_pos", "_base", "_skips")


def bisulfite_style_tags(reads: DataFrame, calls: DataFrame, ref: DataFrame) -> DataFrame:
    """Reads with `xm`, `xr` and `xg`. Context letters of de-novo sites come from the reference around them."""
    near = ref.select("contig", "pos", "before2", "before", "after", "after2")
    bases = called_bases(reads, calls).join(near, ["contig", "pos"], "left")
    around = cytosine_context(F.col("strand"), F.col("before2"), F.col("before"), F.col("after"), F.col("after2"))
    context = F.when(F.col("call") == "denovo", around).otherwise(F.lit("CG"))
    letters = bases.withColumn("_l", xm_letter(context, F.col("methylated")))
    gathered = letters.groupBy("read_id").agg(F.map_from_entries(F.collect_set(F.struct(F.col("qpos").cast("int"), "_l"))).alias("_xm"))
    joined = reads.join(gathered, "read_id", "left")
    letter = lambda b, i: F.coalesce(F.try_element_at("_xm", i), F.lit("."))
    return joined.withColumns(
        {
            "xm": F.concat_ws("", F.transform(F.split("seq", ""), letter)),
            "xr": F.when(has_bits(F.col("flag"), 64), F.lit("CT")).otherwise(F.lit("GA")),
            "xg": F.when(F.col("strand") == "OB", F.lit("GA")).otherwise(F.lit("CT")),
        }
    ).drop("_xm")
