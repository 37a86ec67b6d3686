"""Text tables in: variant files, CpG tables, per-read tables, interval files, region arguments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators.perread import LISTS
from cytoquill.operators.records import BED_COLUMNS
from cytoquill.sources import bcf
from cytoquill.sources.lines import overlapping, read_lines

#: Regions as (contig, start, end), half open, 0-based.
Regions = list[tuple[str, int, int]]

CALL_TYPES = ["string", "bigint", "bigint", "string", "string", "string", "bigint", "bigint", "bigint", "bigint", "bigint", "string", "double", "double", "string"]


def variant_lines(spark: SparkSession, path: str, regions: Regions | None = None) -> DataFrame:
    return bcf.read_lines(spark, path, regions) if path.endswith(".bcf") else read_lines(spark, path, regions)


def read_vcf(spark: SparkSession, path: str, regions: Regions | None = None) -> DataFrame:
    """Variant lines of a text (also compressed) or binary file; a line with too few fields or a bad position is skipped.

    With regions, the records whose reference bases overlap one of them; an indexed file is read only there, and a contig
    that it lacks gives nothing.
    """
    f = F.split("value", "\t")
    field = lambda i: F.get(f, F.lit(i))
    rows = variant_lines(spark, path, regions).where(~F.col("value").startswith("#") & (F.size(f) >= 8))
    out = rows.select(
        field(0).alias("contig"), (field(1).try_cast("bigint") - 1).alias("pos"), F.lit(0).alias("kind"), field(3).alias("ref_text"), field(4).alias("alt_text"),
        field(5).alias("qual"), field(6).alias("filter"), field(7).alias("info"), F.coalesce(field(8), F.lit("")).alias("format"), F.coalesce(field(9), F.lit("")).alias("sample"),
    ).where("pos is not null")
    return overlapping(out.withColumn("_stop", F.col("pos") + F.length("ref_text")), regions, "pos", "_stop").drop("_stop")


def vcf_contigs(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Contigs a variant file declares, in order (header lines only)."""
    heads = bcf.header_lines(path) if path.endswith(".bcf") else [r[0] for r in spark.read.text(path).where(F.col("value").startswith("##contig=")).collect()]
    out = []
    for line in heads:
        if not line.startswith("##contig="):
            continue
        name, size = re.search(r"ID=([^,>]+)", line), re.search(r"length=(\d+)", line)
        out.append((name.group(1), int(size.group(1)) if size else 0))
    return out


def read_calls(spark: SparkSession, path: str, regions: Regions | None = None) -> DataFrame:
    """A CpG table; rows that do not parse are dropped, older files without the last column count as reference CpGs.

    With regions, the rows that overlap one of them; an indexed file is read only there.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(BED_COLUMNS, CALL_TYPES))
    text = read_lines(spark, path, regions).where(~F.col("value").startswith("#"))
    rows = text.select(F.from_csv("value", schema, {"sep": "\t", "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    rows = overlapping(rows, regions, "start", "end", "chr")
    return rows.where("chr is not null and start is not null").withColumn("cpg", F.coalesce("cpg", F.lit("REF")))


PER_READ = ["contig string", "start bigint", "end bigint", "read_id string", "mapq int", "orientation string", "insert_size bigint", "read_length int", "flag int", "num_cpg int", "num_mod int"]


def read_per_read(spark: SparkSession, path: str) -> DataFrame:
    """A per-read table with its position lists as arrays."""
    schema = ", ".join([*PER_READ, *[f"{c} string" for c in LISTS]])
    rows = spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)
    as_array = lambda c: F.transform(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    return rows.where("contig is not null").withColumns({c: as_array(c) for c in LISTS})


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Half-open intervals. Comment, track and browser lines are skipped, empty intervals dropped; a short or
    malformed line is an error naming it."""
    f = F.split("value", "\t")
    field = lambda i: F.get(f, F.lit(i))
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    bad = (F.size(f) < 3) | field(1).try_cast("bigint").isNull() | field(2).try_cast("bigint").isNull()
    checked = lines.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit("not an interval: "), "value")).cast("boolean")).otherwise(F.lit(True)))
    return checked.where("_ok").select(field(0).alias("contig"), field(1).try_cast("bigint").alias("start"), field(2).try_cast("bigint").alias("end")).where("start < end")


def parse_region(text: str) -> tuple[str, int, int | None]:
    """`chr`, `chr:start` or `chr:start-end`, 1-based and inclusive, as a half-open 0-based interval."""
    found = re.fullmatch(r"([^:]+)(?::([\d,]+)(?:-([\d,]+))?)?", text.strip())
    if not found:
        raise ValueError(f"{text!r} is not a region")
    contig, start, end = found.groups()
    begin = int(start.replace(",", "")) - 1 if start else 0
    stop = int(end.replace(",", "")) if end else None
    if begin < 0 or (stop is not None and stop <= begin):
        raise ValueError(f"region {text!r} is empty")
    return contig, begin, stop


def regions(spark: SparkSession, texts: list[str], contigs: list[tuple[str, int]]) -> DataFrame:
    """Regions as intervals. `@file` reads an interval file; a contig named here must exist, one from a file may not."""
    sizes = dict(contigs)
    rows, tables = [], []
    for text in texts:
        if text.startswith("@"):
            known = spark.createDataFrame(list(contigs), "contig string, length bigint")
            tables.append(read_intervals(spark, text[1:]).join(F.broadcast(known), "contig").select("contig", "start", F.least("end", "length").alias("end")))
            continue
        contig, begin, stop = parse_region(text)
        if contig not in sizes:
            raise ValueError(f"contig {contig!r} is not in the reference")
        rows.append((contig, begin, min(stop, sizes[contig]) if stop is not None else sizes[contig]))
    out = spark.createDataFrame(rows, "contig string, start bigint, end bigint")
    for t in tables:
        out = out.unionByName(t)
    return out
