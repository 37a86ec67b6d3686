"""Queries whose rows used to be worked out and shuffled several times: the same results from less."""

import random

from pyspark.sql import functions as F

from cytoquill.operators import haplotypes, pileup, quality
from cytoquill.operators import reads as read_ops


def some_reads(spark, rng, n=400, size=16, span=60):
    ref = [rng.choice("ACGT") for _ in range(span + 2 * size)]
    rows = []
    for i in range(n):
        start = rng.randrange(span)
        seq = "".join(rng.choice("ACGTN") if rng.random() < 0.08 else b for b in ref[start : start + size])
        rows.append((i, f"f{i // 2}" if rng.random() < 0.9 else None, rng.choice([99, 147, 163, 83, 1123]), "c", start, start + size, rng.choice([0, 30, 255]), f"{size}M", seq, [rng.randrange(2, 41) for _ in seq], "OT"))
    reads = spark.createDataFrame(rows, "read_id bigint, qname string, flag int, contig string, pos bigint, end bigint, mapq int, cigar string, seq string, qual array<int>, strand string")
    at = lambda i: ref[i] if 0 <= i < len(ref) else None
    context = spark.createDataFrame([("c", i, b, at(i - 2), at(i - 1), at(i + 1), at(i + 2)) for i, b in enumerate(ref)], "contig string, pos bigint, base string, before2 string, before string, after string, after2 string")
    return reads, context


def shuffled(df):
    """Exchanges and the columns they move."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_noisy_positions_of_reads_are_those_of_columns(spark):
    for seed in (1, 2):
        reads, context = some_reads(spark, random.Random(seed))
        cols = pileup.columns(pileup.counted_observations(read_ops.observations(reads)), context)
        wanted = {r["pos"] for r in haplotypes.noisy_positions(cols, 4).collect()}
        found = haplotypes.noisy_positions_of_reads(reads, context, at_least=4).collect()
        assert {r["pos"] for r in found} == wanted and len(found) == len(wanted)
        # Repeated rows of the reference count nothing twice.
        assert {r["pos"] for r in haplotypes.noisy_positions_of_reads(reads, context.unionAll(context), at_least=4).collect()} == wanted
        assert 0 < len(wanted) < 60


def test_reads_are_walked_once_over_their_sites(spark):
    reads, context = some_reads(spark, random.Random(5))
    sites = context.select("contig", "pos").where("pos % 3 = 0")
    walked = read_ops.observations_at(reads, sites)
    assert "r_start" not in walked.columns
    plan = walked._jdf.queryExecution().optimizedPlan().toString()
    # A row per read and site, each walked whole, came of a join on `r_start`; now the sites come as a list.
    assert "r_start" not in plan and "collect_set" in plan


def test_calls_of_fragments_move_once(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        start = rng.randrange(200)
        calls = {k: sorted(rng.sample(range(16), 2)) for k in quality.TYPES}
        rows.append(("c", start, start + 16, None if i % 17 == 0 else f"f{i // 2}", rng.choice(["+", "-"]), 30, rng.choice([99, 147, 83, 163, 67]), *calls.values()))
    kinds = ", ".join(f"{k} array<bigint>" for k in quality.TYPES)
    reads = spark.createDataFrame(rows, f"contig string, start bigint, end bigint, read_id string, orientation string, insert_size bigint, flag int, {kinds}")
    cpgs = spark.createDataFrame([("c", p) for p in range(0, 260, 5)], "contig string, pos bigint")
    found = quality.fragment_calls(reads, cpgs, reads.select("contig", "start", "end").unionAll(spark.range(5).select(F.lit("c"), "id", F.col("id") + 3)))
    assert sum("read_id" in line for line in shuffled(found)) == 1
    wanted: dict = {}
    starts = [p for p in range(0, 260, 5)]
    for contig, start, end, name, _, size, flag, *lists in rows:
        strand = "OT" if flag in (99, 147) else "OB"
        if name is None:
            continue
        before = 0 if start < 3 else sum(p <= start - 3 for p in starts)
        last = sum(p <= end - 1 for p in starts)
        typed = sorted((p, t) for t, places in zip(quality.TYPES.values(), lists) for p in places)
        for k, (p, t) in enumerate(typed):
            if before + 1 + k <= last:
                wanted.setdefault((name, strand, before + 1 + k, size), []).append((start, end, start + p, t))
    ends: dict = {}
    for (name, strand, *_), held in wanted.items():
        first, stop = ends.get((name, strand), (10**9, -1))
        ends[name, strand] = min(first, *(h[0] for h in held)), max(stop, *(h[1] for h in held))
    expected = set()
    for (name, strand, cpg, size), held in wanted.items():
        kind = "S" if any(h[3] == "S" for h in held) else "U" if all(h[3] in "Uu" for h in held) else "M"
        at, (first, stop) = min(h[2] for h in held), ends[name, strand]
        expected.add((name, strand, cpg, size, kind, at - first if strand == "OT" else stop - at))
    got = [(r["read_id"], r["strand"], r["cpg_id"], r["insert_size"], r["type"], r["pos_in_fragment"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
