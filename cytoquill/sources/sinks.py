"""Text outputs whose parts, read in order, are one valid file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.operators.records import BED_COLUMNS, FILTERS, FORMAT_FIELDS, INFO_FIELDS
from cytoquill.sources import bcf


def write_lines(rows: DataFrame, header: list[str], path: str, order: list[str]) -> None:
    """Write `value` in the order of `order` (`rank` first), the header before everything.

    Range partitioning keeps the sort distributed; a path ending in .gz is compressed. Spark's committer
    shows the output only when the whole job has succeeded.
    """
    spark = rows.sparkSession
    top = spark.createDataFrame([(i, line) for i, line in enumerate(header)], "_line int, value string")
    body = rows.withColumns({"_head": F.lit(1), "_line": F.lit(0)})
    head = top.withColumn("_head", F.lit(0))
    both = head.unionByName(body, allowMissingColumns=True)
    keys = ["_head", "_line", *[k for k in order]]
    ordered = both.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value")
    writer = ordered.write.mode("overwrite")
    if path.endswith((".gz", ".bgz")):
        writer = writer.option("compression", "gzip")
    writer.text(path)


def _rank(contigs: list[tuple[str, int]]):
    return F.create_map(*[F.lit(x) for i, (name, _) in enumerate(contigs) for x in (name, i)])


def vcf_header(contigs: list[tuple[str, int]], info: list[str], fmt: list[str], metadata: dict[str, str] | None = None) -> list[str]:
    """Header lines: version, metadata, declared filters and fields, contigs in their order."""
    declared = lambda kind, fields, wanted: [
        f'##{kind}=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in fields if i in wanted
    ]
    return [
        "##fileformat=VCFv4.5",
        *[f"##{k}={v}" for k, v in (metadata or {}).items()],
        *[f'##FILTER=<ID={i},Description="{d}">' for i, d in FILTERS],
        *declared("INFO", INFO_FIELDS, info),
        *declared("FORMAT", FORMAT_FIELDS, fmt),
        *[f"##contig=<ID={name},length={size}>" for name, size in contigs],
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsample",
    ]


def write_vcf(lines: DataFrame, path: str, contigs: list[tuple[str, int]], info: list[str], fmt: list[str], metadata: dict[str, str] | None = None) -> None:
    """Variant lines in contig, position and record-kind order; binary if the path ends in .bcf."""
    value = F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), F.lit("."), "ref_text", "alt_text", "qual", "filter", F.coalesce(F.nullif("info", F.lit("")), F.lit(".")), "format", "sample")
    rows = lines.select(_rank(contigs)[F.col("contig")].alias("rank"), "pos", "kind", value.alias("value"))
    write = bcf.write_lines if path.endswith(".bcf") else write_lines
    write(rows, vcf_header(contigs, info, fmt, metadata), path, ["rank", "pos", "kind", "value"])


def write_bed(rows: DataFrame, path: str, contigs: list[tuple[str, int]], columns: list[str] = BED_COLUMNS) -> None:
    """Tab-separated rows under a `#` header, sorted by contig and start. The first column names the contig."""
    first, start = columns[0], columns[1]
    value = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    out = rows.select(_rank(contigs)[F.col(first)].alias("rank"), F.col(start).alias("pos"), value.alias("value"))
    write_lines(out, ["#" + "\t".join(columns).replace("contig", "chr", 1)], path, ["rank", "pos", "value"])
