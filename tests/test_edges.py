"""Cases that a planted genome does not hold: two alts, nameless and repeated reads, deep positions, large counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoquill.functions import stats
from cytoquill.operators import forest, haplotypes, perread, phasing, pileup, quality, reads as read_ops, sampling
from cytoquill.params import CallParams
from cytoquill.plans.calling import call, engine_genotypes
from cytoquill.sources.alignments import READS

VERDICT = "contig string, cluster bigint, anchor bigint, kind string, bases string, event int, gl array<double>, compound_gl array<double>"


def test_two_passing_alts_are_typed_together_or_again(spark):
    both = [-90.0, -40.0, -60.0, -45.0, 0.0, -70.0]  # 1/2 is likeliest
    first_only = [-30.0, 0.0, -20.0, -25.0, -22.0, -40.0]  # 0/1 is likeliest: no copy of the second
    rows = [
        ("c", 5, 5, "base", "A", 0, [-9.0, 0.0, -9.0], both), ("c", 5, 5, "base", "T", 1, [-8.0, 0.0, -8.0], both),
        ("c", 9, 9, "base", "A", 0, [-7.0, 0.0, -6.0], first_only), ("c", 9, 9, "base", "T", 1, [0.0, -5.0, -9.0], first_only),
        ("c", 12, 12, "base", "G", 0, [-20.0, -6.0, 0.0], None),
    ]
    called = [("c", 5, "C", ["A", "T"]), ("c", 9, "C", ["A", "T"]), ("c", 12, "C", ["G", "T"]), ("c", 20, "C", ["A"])]
    found = {
        r["pos"]: r
        for r in engine_genotypes(spark.createDataFrame(rows, VERDICT), spark.createDataFrame(called, "contig string, pos bigint, ref string, called array<string>")).collect()
    }
    assert found[5]["genotype"] == ["A", "T"] and len(found[5]["pl"]) == 6
    assert found[9]["genotype"] == ["C", "A"] and len(found[9]["pl"]) == 3
    assert found[12]["genotype"] == ["G", "G"] and len(found[12]["pl"]) == 3
    assert 20 not in found


def simple_reads(spark, names, seq="ACGTACGT", pos=10):
    rows = [(n, 99, "c1", pos, 60, f"{len(seq)}M", "c1", pos, len(seq), seq, [38] * len(seq), {}) for n in names]
    return spark.createDataFrame(rows, READS).withColumn("read_id", F.xxhash64(F.monotonically_increasing_id()))


def test_reads_without_a_name_are_not_mates(spark):
    reads = read_ops.with_strand(read_ops.with_reference_span(simple_reads(spark, [None, None, None, "q", "q"])))
    counted = pileup.counted_observations(read_ops.observations(reads), CallParams())
    assert {r["n"] for r in counted.groupBy("pos").agg(F.count("*").alias("n")).collect()} == {4}


def test_repeated_reads_stand_beside_each_other(spark):
    reads = simple_reads(spark, ["q"]).withColumn("read_id", F.lit(7).cast("bigint"))
    ref = spark.createDataFrame([("c1", p, b) for p, b in enumerate("TTTTTTTTTTACGTACGTTTTT")], "contig string, pos bigint, base string")
    from cytoquill.plans.calling import reference_context

    context = reference_context(ref)
    one, two = (perread.as_text(perread.per_read(r, context)).collect() for r in (reads, reads.unionByName(reads)))
    assert len(one) == 1 and two == one * 2 and one[0]["num_cpg"] == 2


@pytest.mark.parametrize("cap", [1001, 1500])
def test_large_caps_rank_as_one_step(spark, cap):
    rows = [(7 if i % 3 else i % 50, i // 5, i) for i in range(4000)]
    obs = spark.createDataFrame(rows, "pos bigint, read_start bigint, read_id bigint").selectExpr("'c' AS contig", "*", "0L AS tie")
    found = {(r["pos"], r["read_rank"]): r["read_id"] for r in pileup.cap_depth(obs, cap).collect()}
    expected = {}
    for p in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == p), key=lambda r: r[1:])[:cap]):
            expected[p, k + 1] = r[2]
    assert found == expected


def test_poisson_limits_of_large_counts():
    for k in (9_999.0, 10_000.0, 1e7, 1e9):
        low, high = (float(v[0]) for v in stats.poisson_limits(np.array([k])))
        # Wilson and Hilferty's cube-root form is right to far better than a thousandth of a standard deviation here.
        form = lambda n, z: n * (1 - 1 / (9 * n) + z / (3 * n**0.5)) ** 3
        assert abs(low - form(k, -1.959963985)) < 2e-3 * k**0.5 and abs(high - form(k + 1, 1.959963985)) < 2e-3 * k**0.5
    near = [stats.poisson_limits(np.array([k]))[0][0] for k in (9_999.0, 10_000.0)]
    assert near[1] - near[0] == pytest.approx(0.99, abs=0.01)


def test_noise_tail_of_deep_sites(spark):
    rows = [(100_000, 2_000), (100_000, 2_300), (1_000_000, 20_000)]
    df = spark.createDataFrame(rows, "n bigint, k bigint").select("n", "k", quality.noise_tail(F.col("k"), F.col("n")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(float(stats.binomial_upper_tail(np.array([r["k"]]), np.array([r["n"]]), 0.02)[0]), rel=1e-4, abs=1e-9)


def test_call_refuses_to_run_without_models(spark):
    ref = spark.createDataFrame([("c1", p, "A") for p in range(40)], "contig string, pos bigint, base string")
    with pytest.raises(ValueError):
        call(simple_reads(spark, ["q"]), ref)


def test_substitution_clusters_take_in_their_neighbours(spark):
    alts = spark.createDataFrame([("c", p, a) for p, a in ((100, "A"), (105, "C"), (105, "G"), (110, "T"), (118, "A"), (300, "C"))], "contig string, pos bigint, alt string")
    indel = spark.createDataFrame([("c", 112, 112, 112, [(112, "ins", "TT", 2)])], f"contig string, cluster bigint, first bigint, last bigint, events array<{haplotypes.EVENT}>")
    plain = {r["cluster"]: [(e["anchor"], e["bases"]) for e in r["events"]] for r in haplotypes.snv_clusters(alts, None).collect()}
    assert plain[300] == [(300, "C")]
    assert plain[100] == [(100, "A"), (105, "C"), (105, "G")]
    # The nearest two are as far, and together too many; the next one fits.
    assert plain[105] == [(105, "C"), (105, "G"), (118, "A")]
    assert plain[118] == [(100, "A"), (110, "T"), (118, "A")]
    # Twenty columns of two alts leave no room for each other; the one behind them fits, where no other is as far on the other side.
    dense = [(p, a) for p in range(1000, 1100, 5) for a in "CG"] + [(1100, "A")]
    crowd = spark.createDataFrame([("c", p, a) for p, a in dense], "contig string, pos bigint, alt string")
    far = {r["cluster"]: [(e["anchor"], e["bases"]) for e in r["events"]] for r in haplotypes.snv_clusters(crowd, None).collect()}
    assert all(far[p] == [(p, "C"), (p, "G")] + [(1100, "A")] * (p < 1050) for p in range(1000, 1100, 5))
    near = {r["cluster"]: [(e["anchor"], e["kind"]) for e in r["events"]] for r in haplotypes.snv_clusters(alts, indel).collect()}
    assert (112, "ins") in near[110] and (112, "ins") in near[105] and near[300] == [(300, "base")]


def phased(spark, held, sites):
    df = phasing.phase(
        spark.createDataFrame(held, "contig string, pos bigint, kind string, qname string, site bigint, allele int, cost int"),
        spark.createDataFrame(sites, "contig string, pos bigint, kind string, site bigint, guard string"),
    )
    return {(r["pos"], r["kind"]): (r["ps"], r["first"], r["pq"]) for r in df.collect()}


def test_phasing_recovers_planted_haplotypes(spark):
    rng = random.Random(2)
    where = sorted(rng.sample(range(1000), 30))
    hap = {p: rng.randrange(2) for p in where}
    held = []
    for f in range(900):
        start, side = rng.randrange(-60, 1000), rng.randrange(2)
        for p in where:
            if start <= p < start + 160:
                allele = hap[p] ^ side ^ (rng.random() < 0.02)
                held.append(("c", p, "snv", f"f{f}", 2 * p, int(allele), 26))
    found = phased(spark, held, [("c", p, "snv", 2 * p, None) for p in where])
    assert len(found) >= 28
    for ps in {v[0] for v in found.values()}:
        members = [(p, v) for (p, _), v in sorted(found.items()) if v[0] == ps]
        assert members[0][1][1] == 0 and ps == members[0][0] + 1
        assert len({v[1] ^ hap[p] for p, v in members}) == 1


def test_phasing_attaches_guarded_sites_and_cuts_weak_links(spark):
    held = []
    for f in range(12):
        side = f % 2
        for p in (10, 20, 30):
            held.append(("c", p, "snv", f"f{f}", 2 * p, side, 26))
        held.append(("c", 25, "indel", f"f{f}", 51, 1 - side, 26))
    for f in range(12):
        for p in (400, 410):
            held.append(("c", p, "snv", f"g{f}", 2 * p, f % 2, 26))
    held += [("c", 30, "snv", "weak", 60, 0, 10), ("c", 400, "snv", "weak", 800, 0, 10)]
    sites = [("c", p, "snv", 2 * p, None) for p in (10, 20, 30, 400, 410)] + [("c", 25, "indel", 51, "depth")]
    found = phased(spark, held, sites)
    assert {k: v[:2] for k, v in found.items()} == {(10, "snv"): (11, 0), (20, "snv"): (11, 0), (25, "indel"): (11, 1), (30, "snv"): (11, 0), (400, "snv"): (401, 0), (410, "snv"): (401, 0)}


def test_pooled_samples_keep_their_own_rows(spark):
    rows = spark.createDataFrame([(s, "c", p, "A", "C", p % 2, [float(p + s)]) for s in (0, 1) for p in range(60)], "sample int, contig string, pos bigint, ref string, alt string, label bigint, features array<double>")
    train, held = forest.training_split(rows, forest.TrainParams(positives=20, negatives=20))
    both = train.unionByName(held).collect()
    assert len(both) == len({(r["sample"], r["pos"]) for r in both}) >= 40
    assert all(r["features"] == [float(r["pos"] + r["sample"])] for r in both)


def test_holdout_keeps_the_ratio():
    for seen, left in (((10, 90), (10, 90)), ((5, 5), (1, 100)), ((1, 1000), (3, 50)), ((7, 0), (4, 0)), ((3, 4), (0, 0))):
        pos, neg = sampling.holdout_shape(*seen, *left)
        assert 0 <= pos <= left[0] and 0 <= neg <= left[1]
        assert (pos > 0) == (left[0] > 0) and (neg > 0) == (left[1] > 0)
