"""Filters and mate removal against brute force, with one position holding a third of all rows."""

import random
from collections import defaultdict

import pytest

from cytoquill.operators import pileup
from cytoquill.params import CallParams, EndMask
from cytoquill.queries import QUERIES, load_all

SCHEMA = (
    "contig string, pos bigint, frag bigint, read_id bigint, tie bigint, read_start bigint, qpos bigint, read_len bigint, aligned bigint, indels bigint,"
    " is_second bigint, strand string, flag bigint, mapq bigint, baseq bigint, base string, prev_base string, next_base string"
)


def rows(seed, n=3000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        pos = 7 if rng.random() < 1 / 3 else rng.randrange(60)
        second = rng.randrange(2)
        strand = rng.choice(("OT", "OB", None))
        flag = {("OT", 0): 99, ("OT", 1): 147, ("OB", 0): 83, ("OB", 1): 163}.get((strand, second), 67)
        out.append((
            "c", pos, rng.randrange(n // 6), i, 0, pos - rng.randrange(50), rng.randrange(50), 50, 50, 0, second, strand,
            flag | (1024 if rng.random() < 0.05 else 0), rng.choice((0, 1, 40, 255)), rng.choice((None, 5, 10, 30)), rng.choice("ACGT"), "C", "G",
        ))
    return out


def brute(data, cap):
    columns = defaultdict(list)
    for r in data:
        if r[12] & 3 == 3 and not r[12] & 3852 and (r[13] == 255 or r[13] >= 1):
            columns[r[1]].append(r)
    kept = set()
    for reads in columns.values():
        reads.sort(key=lambda r: (r[5], r[3], r[4]))
        fragments = defaultdict(list)
        for r in reads[:cap] if cap else reads:
            if r[14] is not None and r[14] >= 10:
                fragments[r[2]].append(r)
        for mates in fragments.values():
            best = min(mates, key=lambda r: r[10]) if len({r[15] for r in mates}) > 1 else mates[0]
            kept.add(best[3])
    return kept


@pytest.mark.parametrize("cap", [0, 25, 1000])
def test_counted_reads(spark, cap):
    data = rows(cap)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = {r["read_id"] for r in pileup.counted_observations(df, CallParams(max_coverage=cap)).select("read_id").collect()}
    assert got == brute(data, cap)


def test_unknown_strand_is_never_masked(spark):
    data = rows(2)
    df = spark.createDataFrame(data, SCHEMA)
    kept = pileup.mask_ends(df, EndMask((50, 0, 0, 50), (50, 0, 0, 50))).collect()
    assert sum(r["strand"] is None for r in kept) == sum(r[11] is None for r in data)
    assert {(r["strand"], bool(r["flag"] & 16)) for r in kept if r["strand"]} == set()


def test_plans_limit_before_the_shuffle_and_join_on_keys(spark):
    load_all()
    df = spark.createDataFrame(rows(3), SCHEMA)
    plan = pileup.cap_depth(df, 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    for name in ("cpg_beta", "strand_evidence", "per_read_methylation", "interval_semi_join", "interval_overlap_join", "mbias_table", "beta_diff_hist", "fragment_links"):
        text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "PythonUDF" not in text, name
