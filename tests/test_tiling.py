"""Tiled windows and intervals against brute force, with tiles small enough that every edge is crossed."""

import random

import pytest
from pyspark.sql import functions as F

from cytoquill.operators import quality, sampling, tiling


def positions(seed, n=120, span=300):
    rng = random.Random(seed)
    return sorted({(rng.choice("ab"), rng.randrange(span)) for _ in range(n)})


def frame(spark, rows, schema="contig string, pos bigint"):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours(spark, seed):
    rows = positions(seed)
    have = set(rows)
    got = tiling.with_neighbours(frame(spark, rows).withColumn("v", F.col("pos") * 10), {"l": ("v", -1), "r": ("v", 1)}, width=7).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["l"] == ((r["pos"] - 1) * 10 if (r["contig"], r["pos"] - 1) in have else None)
        assert r["r"] == ((r["pos"] + 1) * 10 if (r["contig"], r["pos"] + 1) in have else None)


def test_range_aggregates(spark):
    rows = positions(3)
    got = tiling.with_range_aggregates(frame(spark, rows), {"n": F.count(F.lit(1))}, 5, width=11).collect()
    for r in got:
        assert r["n"] == sum(c == r["contig"] and abs(p - r["pos"]) <= 5 for c, p in rows)


def test_running_sum_and_maximum(spark):
    rows = positions(4)
    df = frame(spark, rows)
    got = tiling.with_running(df, sums={"s": F.col("pos")}, maxima={"m": F.when(F.col("pos") % 3 == 0, F.col("pos"))}, width=13).collect()
    for r in got:
        upto = [p for c, p in rows if c == r["contig"] and p <= r["pos"]]
        assert r["s"] == sum(upto)
        assert r["m"] == max((p for p in upto if p % 3 == 0), default=None)


def test_gap_chains(spark):
    rows = positions(5, n=60)
    got = {(r["contig"], r["pos"]): r["chain_start"] for r in tiling.gap_chains(frame(spark, rows), 4, width=9).collect()}
    for contig in "ab":
        last, start = None, None
        for p in sorted(p for c, p in rows if c == contig):
            if last is None or p - last > 4:
                start = p
            assert got[contig, p] == start
            last = p


def test_merge_and_membership(spark):
    rng = random.Random(6)
    spans = [(rng.choice("ab"), s, s + rng.randrange(0, 12)) for s in (rng.randrange(250) for _ in range(40))]
    df = frame(spark, spans, "contig string, start bigint, end bigint")
    covered = {(c, p) for c, s, e in spans for p in range(s, e)}
    merged = tiling.merge_intervals(df, width=10).collect()
    assert {(r["contig"], p) for r in merged for p in range(r["start"], r["end"])} == covered
    for r in merged:  # maximal and apart: neither neighbour touches
        assert (r["contig"], r["start"] - 1) not in covered and (r["contig"], r["end"]) not in covered
    pts = [(c, p) for c in "ab" for p in range(270)]
    inside = {(r["contig"], r["pos"]) for r in tiling.points_in_intervals(frame(spark, pts), df, width=8).collect()}
    outside = {(r["contig"], r["pos"]) for r in tiling.points_in_intervals(frame(spark, pts), df, "anti", width=8).collect()}
    flagged = {(r["contig"], r["pos"]) for r in tiling.points_in_intervals(frame(spark, pts), df, "flag", width=8).where("inside").collect()}
    assert inside == covered & set(pts) == flagged and outside == set(pts) - covered


@pytest.mark.parametrize("cover", [False, True])
def test_overlap_join(spark, cover):
    rng = random.Random(8)
    make = lambda n: [(i, rng.choice("ab"), s, s + rng.randrange(1, 30)) for i, s in enumerate(rng.randrange(200) for _ in range(n))]
    a, b = make(25), make(40)
    left = frame(spark, a, "i bigint, contig string, l_start bigint, l_end bigint")
    right = frame(spark, b, "j bigint, contig string, r_start bigint, r_end bigint")
    got = sorted((r["i"], r["j"]) for r in tiling.overlap_join(left, right, width=7, cover=cover).collect())
    test = (lambda ls, le, rs, re: rs <= ls and le <= re) if cover else (lambda ls, le, rs, re: ls < re and rs < le)
    assert got == sorted((i, j) for i, c, ls, le in a for j, d, rs, re in b if c == d and test(ls, le, rs, re))


def test_nearest_and_counts(spark):
    sites, asked = positions(9, n=40), positions(10, n=80)
    found = tiling.nearest_before(frame(spark, asked), frame(spark, sites), "site", width=17).collect()
    for r in found:
        assert r["site"] == max((p for c, p in sites if c == r["contig"] and p <= r["pos"]), default=None)
    counted = tiling.sites_up_to(frame(spark, asked), frame(spark, sites), "n", width=17).collect()
    for r in counted:
        assert r["n"] == sum(c == r["contig"] and p <= r["pos"] for c, p in sites)


def test_coverage(spark):
    rng = random.Random(11)
    spans = [("a", s, s + rng.randrange(1, 20), rng.random() < 0.5) for s in (rng.randrange(100) for _ in range(50))]
    df = frame(spark, spans, "contig string, start bigint, end bigint, top boolean")
    pts = [("a", p) for p in range(130)]
    got = tiling.coverage_at(frame(spark, pts), df, {"t": F.col("top"), "b": ~F.col("top")}, width=9).collect()
    assert len(got) == 130
    for r in got:
        assert r["t"] == sum(s <= r["pos"] < e and top for _, s, e, top in spans)
        assert r["b"] == sum(s <= r["pos"] < e and not top for _, s, e, top in spans)
    events = {r["pos"]: r["depth"] for r in tiling.coverage_from_events(df, width=9).collect()}
    assert all(depth == sum(s <= p < e for _, s, e, _ in spans) for p, depth in events.items())


def test_upper_median(spark):
    rng = random.Random(12)
    rows = [(rng.choice("abc"), rng.randrange(9)) for _ in range(50)]
    got = {r["k"]: r["m"] for r in quality.upper_median(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", "m").collect()}
    for k in got:
        values = sorted(v for c, v in rows if c == k)
        assert got[k] == values[len(values) // 2]


def test_smallest_keys_is_exact(spark):
    rng = random.Random(13)
    rows = [(i, "hot" if i % 10 else "cold", rng.randrange(1000)) for i in range(400)]
    df = spark.createDataFrame(rows, "i bigint, c string, key bigint")
    got = sampling.smallest_keys(df, ["c"], F.col("key"), F.when(F.col("c") == "hot", 37).otherwise(100), key_range=1000).collect()
    for c, cap in (("hot", 37), ("cold", 100)):
        expected = sorted((k, i) for i, cc, k in rows if cc == c)[:cap]
        assert sorted((r["key"], r["i"]) for r in got if r["c"] == c) == expected


def test_holdout_shape():
    assert sampling.holdout_shape(100, 900, 50, 400) == (44, 400)
    assert sampling.holdout_shape(0, 0, 3, 5) == (3, 5)
    pos, neg = sampling.holdout_shape(10, 10_000_000, 5, 90_000)
    assert pos >= 1 and neg <= 90_000
