"""Queries over ordered positions and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoquill.operators import pileup, tiling
from cytoquill.queries import derived
from cytoquill.queries.derived import with_ctes
from cytoquill.queries.registry import as_long, query

SITES = {"sites": """SELECT DISTINCT contig, pos FROM altrows WHERE alt_depth >= 3"""}
MERGED = {
    "uniq": 'SELECT contig, start, max("end") AS stop FROM intervals WHERE "end" > start GROUP BY contig, start',
    "reach": "SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM uniq",
    "isl": "SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start) AS island FROM reach",
    "merged": "SELECT contig, min(start) AS start, max(stop) AS stop FROM isl GROUP BY contig, island",
}
SPANS = {
    "spans": """SELECT read_id, contig, start + CASE WHEN shape = 'clip' THEN 2 ELSE 0 END AS start,
    start + CASE shape WHEN 'del' THEN 18 WHEN 'ins' THEN 14 ELSE 16 END AS stop FROM mates"""
}


def variant_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Positions where an alt is seen at least three times."""
    from cytoquill.queries.columns import columns

    rows = pileup.alt_rows(columns(spark, sf)).where("alt.depth >= 3")
    return rows.select("contig", "pos").distinct()


def read_spans(spark: SparkSession, sf: str) -> DataFrame:
    from cytoquill.operators import reads

    return reads.with_reference_span(derived.reads(spark, sf)).select("read_id", "contig", F.col("pos").alias("start"), "end")


@query("interval_merge", with_ctes("SELECT * FROM merged", "intervals", extra=MERGED))
def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.merge_intervals(derived.intervals(spark, sf)).withColumnRenamed("end", "stop")


@query(
    "interval_semi_join",
    with_ctes(
        """SELECT contig, pos FROM refb r WHERE EXISTS (SELECT 1 FROM intervals i WHERE i.contig = r.contig AND i.start <= r.pos AND r.pos < i."end")""",
        "refb", "intervals",
    ),
)
def interval_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.points_in_intervals(derived.reference(spark, sf), derived.intervals(spark, sf)).select("contig", "pos")


@query(
    "interval_anti_join",
    with_ctes(
        """SELECT contig, pos FROM refb r WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE i.contig = r.contig AND i.start <= r.pos AND r.pos < i."end")""",
        "refb", "intervals",
    ),
)
def interval_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.points_in_intervals(derived.reference(spark, sf), derived.intervals(spark, sf), "anti").select("contig", "pos")


@query(
    "interval_overlap_join",
    with_ctes(
        """SELECT m.contig, m.start, m.stop, s.read_id FROM merged m JOIN spans s ON m.contig = s.contig AND m.start < s.stop AND s.start < m.stop""",
        "intervals", "mates", extra={**MERGED, **SPANS},
    ),
)
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    left = tiling.merge_intervals(derived.intervals(spark, sf)).select("contig", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = read_spans(spark, sf).select("read_id", "contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return tiling.overlap_join(left, right).select(
        "contig", F.col("l_start").alias("start"), F.col("l_end").alias("stop"), "read_id"
    )


@query(
    "gap_chains",
    with_ctes(
        """SELECT contig, min(pos) AS chain_start, max(pos) AS chain_end, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY pos) AS chain FROM (
    SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY contig ORDER BY pos) <= 20 THEN 0 ELSE 1 END AS fresh FROM hets))
GROUP BY contig, chain""",
        "altrows", extra={"hets": "SELECT DISTINCT contig, pos FROM altrows WHERE alt_depth >= 8"},
    ),
)
def gap_chains(spark: SparkSession, sf: str) -> DataFrame:
    from cytoquill.queries.columns import columns

    sites = pileup.alt_rows(columns(spark, sf)).where("alt.depth >= 8").select("contig", "pos").distinct()
    return tiling.gap_chains(sites, 20).groupBy("contig", "chain_start").agg(
        F.max("pos").alias("chain_end"), F.count(F.lit(1)).alias("n")
    )


@query(
    "neighbour_density",
    with_ctes(
        "SELECT contig, pos, count(*) OVER (PARTITION BY contig ORDER BY pos RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) - 1 AS nearby FROM sites",
        "altrows", extra=SITES,
    ),
)
def neighbour_density(spark: SparkSession, sf: str) -> DataFrame:
    near = tiling.with_range_aggregates(variant_sites(spark, sf), {"nearby": F.count(F.lit(1))}, 100)
    return near.select("contig", "pos", (F.col("nearby") - 1).alias("nearby"))


@query(
    "nearest_cpg",
    with_ctes(
        """SELECT q.contig, q.pos, s.pos AS site, CAST(coalesce(q.pos - s.pos <= 1, false) AS BIGINT) AS on_site
FROM sites q ASOF LEFT JOIN (SELECT contig, pos FROM refctx WHERE base = 'C' AND after = 'G') s ON q.contig = s.contig AND q.pos >= s.pos""",
        "altrows", "refctx", extra=SITES,
    ),
)
def nearest_cpg(spark: SparkSession, sf: str) -> DataFrame:
    cpgs = pileup.reference_cpgs(derived.reference_context(spark, sf)).where("side = 'C'")
    found = tiling.nearest_before(variant_sites(spark, sf), cpgs, "site")
    return found.select("contig", "pos", "site", as_long(F.coalesce(F.col("pos") - F.col("site") <= 1, F.lit(False))).alias("on_site"))


@query(
    "coverage_events",
    with_ctes(
        """SELECT contig, pos, CAST(delta AS BIGINT) AS delta, CAST(sum(delta) OVER (PARTITION BY contig ORDER BY pos) AS BIGINT) AS depth FROM (
  SELECT contig, pos, sum(delta) AS delta FROM (SELECT contig, start AS pos, 1 AS delta FROM spans UNION ALL SELECT contig, stop, -1 FROM spans) GROUP BY ALL)""",
        "mates", extra=SPANS,
    ),
)
def coverage_events(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.coverage_from_events(read_spans(spark, sf)).select("contig", "pos", "delta", "depth")


@query(
    "depth_median",
    with_ctes(
        """SELECT contig, n, CAST(list_sort(depths)[n // 2 + 1] AS BIGINT) AS median_depth FROM (
  SELECT contig, list(depth) AS depths, count(*) AS n FROM covered GROUP BY contig)""",
        "covered",
    ),
)
def depth_median(spark: SparkSession, sf: str) -> DataFrame:
    from cytoquill.operators.quality import upper_median
    from cytoquill.queries.columns import counted

    return upper_median(pileup.position_metrics(counted(spark, sf)), ["contig"], "depth", "median_depth")
