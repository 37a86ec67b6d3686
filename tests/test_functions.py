"""Scalar functions and statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoquill.functions import alignment as al
from cytoquill.functions import bases, flags, stats
from cytoquill.functions.text import two_decimals
from cytoquill.operators import genotype, quality, records
from cytoquill.operators.forest import Platt, fit_platt
from cytoquill.params import CallParams, EndMask, error_rate
from cytoquill.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_two_decimals_rounds_the_binary_value(spark):
    values = [i / 1000 for i in range(1001)] + [1 / 3, 0.145, 0.295, 0.125, 0.375, 0.625, 33 / 200, 0.0, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_decimals(F.col("v")).alias("t")).collect()
    assert [(r["v"], r["t"]) for r in rows if r["t"] != f"{r['v']:.2f}"] == []


def test_significant(spark):
    for value, text in [(35.5778123, "35.5778"), (60.0, "60"), (0.6666666667, "0.666667"), (0.8, "0.8"), (18.06, "18.06"), (0.0, "0")]:
        assert one(spark, records.significant(F.lit(value))) == text


def test_hom_ref_quality_of_known_counts(spark):
    # Six and twelve plain reads at the default error rate.
    assert round(one(spark, genotype.hom_ref_quality(F.lit(6), F.lit(0), 0.00109))) == 18
    assert round(one(spark, genotype.hom_ref_quality(F.lit(12), F.lit(0), 0.00109))) == 36
    assert one(spark, genotype.hom_ref_quality(F.lit(0), F.lit(0), 0.00109)) is None
    assert one(spark, genotype.hom_ref_quality(F.lit(5000), F.lit(0), 0.00109)) is not None


def test_exact_limits():
    low, high = stats.binomial_limits(np.array([8, 0, 12]), np.array([12, 10, 12]), 0.95)
    assert low[0] == pytest.approx(0.34887, abs=1e-4) and high[0] == pytest.approx(0.90075, abs=1e-4)
    assert low[1] == 0 and high[1] == pytest.approx(0.30850, abs=1e-4)
    assert high[2] == 1 and low[2] == pytest.approx(0.73535, abs=1e-4)
    low, high = stats.poisson_limits(np.array([0, 5, 100]))
    assert low[0] == 0 and high[0] == pytest.approx(3.68888, abs=1e-4)
    assert low[1] == pytest.approx(1.62349, abs=1e-4) and high[1] == pytest.approx(11.66833, abs=1e-4)
    assert low[2] == pytest.approx(81.3640, abs=1e-2) and high[2] == pytest.approx(121.6277, abs=1e-2)


def test_noise_tail_matches_direct_sum(spark):
    for k, n in [(1, 5), (2, 10), (3, 40), (7, 200)]:
        direct = sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k, n + 1))
        assert one(spark, quality.noise_tail(F.lit(k), F.lit(n))) == pytest.approx(direct, rel=1e-9)
        assert stats.binomial_upper_tail(np.array([k]), np.array([n]), 0.02)[0] == pytest.approx(direct, rel=1e-6)


@pytest.mark.parametrize(
    "flag,pair,facing",
    [(99, "OT", "OT"), (147, "OT", "OT"), (83, "OB", "OB"), (163, "OB", "OB"), (67, "OB", None), (113, "OT", None)],
)
def test_strands(spark, flag, pair, facing):
    assert one(spark, flags.strand_of_pair(F.lit(flag))) == pair
    assert one(spark, flags.strand_of_orientation(F.lit(flag), F.lit(True))) == facing


def test_flag_filter_of_unpaired_reads(spark):
    assert not one(spark, flags.flags_pass(F.lit(16), 3, 3852))
    assert one(spark, flags.flags_pass(F.lit(16), 3, 3852, unpaired=True))
    assert not one(spark, flags.flags_pass(F.lit(16 | 1024), 3, 3852, unpaired=True))


def test_contexts(spark):
    c = lambda *v: [F.lit(x) for x in v]
    assert one(spark, bases.cytosine_context(*c("OT", None, None, "G", "A"))) == "CG"
    assert one(spark, bases.cytosine_context(*c("OT", None, None, "A", "G"))) == "CHG"
    assert one(spark, bases.cytosine_context(*c("OB", "A", "C", None, None))) == "CG"
    assert one(spark, bases.cytosine_context(*c("OB", "C", "T", None, None))) == "CHG"
    assert one(spark, bases.cytosine_context(*c("OB", None, None, None, None))) == "CHH"
    assert one(spark, bases.five_base_context(*c(None, "A", "C", "G", None))) == "ACG"
    assert one(spark, bases.reverse_complement(F.lit("AcGtN-x"))) == "NNNACGT"


def test_genotype_reporting(spark):
    gl = F.array(*[F.lit(v) for v in (-30.0, -2.0, -20.0)])
    row = genotype.from_likelihoods(spark.range(1).select(gl.alias("gl"))).first()
    assert row["gt"] == "0/1" and row["pl"] == [255, 0, 180] and row["gq"] == 99.0
    tie = genotype.from_likelihoods(spark.range(1).select(F.array(F.lit(0.0), F.lit(-5.0), F.lit(-5.0)).alias("gl"))).first()
    assert tie["gt"] == "0/1"
    assert one(spark, genotype.genotype_bases(F.lit("0/1"), F.array(F.lit("C"), F.lit("T")))) == "C/T"
    assert one(spark, genotype.genotype_bases(F.lit("./1"), F.array(F.lit("C"), F.lit("T")))) is None


def test_parameters():
    assert error_rate("NovaSeq6000") == 0.00109 and error_rate("0.01") == 0.01
    for bad in ("unknown", "0", "1.5"):
        with pytest.raises(ValueError):
            error_rate(bad)
    assert EndMask.parse("1,2,3,4") == (1, 2, 3, 4)
    with pytest.raises(ValueError):
        EndMask.parse("1,2,3")
    with pytest.raises(ValueError):
        CallParams(ml_threshold=0.001)
    assert tables.parse_region("chr1:11-20") == ("chr1", 10, 20) and tables.parse_region("chr1") == ("chr1", 0, None)
    with pytest.raises(ValueError):
        tables.parse_region("chr1:20-10")
    info, fmt = records.choose_fields(["AS_SB"], ["GT"])
    assert info == ["AS_SB_OT", "AS_SB_OB"] and fmt == ["GT"]
    with pytest.raises(ValueError):
        records.choose_fields(["nope"])


def test_platt_recovers_a_known_curve(spark):
    rng = np.random.default_rng(3)
    s = rng.uniform(0, 1, 4000)
    y = rng.uniform(0, 1, 4000) < 1 / (1 + np.exp(-6 * s + 3))
    fitted = fit_platt(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int"))
    assert fitted.a == pytest.approx(-6, abs=0.6) and fitted.b == pytest.approx(3, abs=0.4)
    assert one(spark, Platt(-6.0, 3.0).apply(F.lit(0.5))) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        fit_platt(spark.createDataFrame([(0.1, 1)], "score double, label int"))


def test_haplotypes_of_events():
    events = [{"anchor": 12, "kind": "base", "bases": "T", "len": 1}, {"anchor": 13, "kind": "del", "bases": "", "len": 2}, {"anchor": 15, "kind": "base", "bases": "A", "len": 1}]
    spelled = dict(al.haplotypes("ACGTACGTAC", 10, events))
    assert spelled[0] == "ACGTACGTAC" and spelled[1] == "ACTTACGTAC" and spelled[2] == "ACGTGTAC"
    assert 6 not in spelled  # the last base lies inside the deletion
    pairs = al.pairs_of([0, 1, 2])
    assert pairs == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]


def test_forward_prefers_the_true_haplotype_and_ignores_conversion():
    rng = np.random.default_rng(1)
    ref = "".join(rng.choice(list("ACGT"), 80)).replace("CG", "CA")
    ref = ref[:40] + "CG" + ref[42:]
    flat = lambda s: np.full(len(s), 0.5)
    deleted = ref[:50] + ref[53:]

    def scores(seq, top, start):
        block = al.ReadBlock([seq], [[35] * len(seq)], np.array([top]))
        out = []
        for h in (ref, deleted):
            pairs = al.Pairs()
            pairs.add(np.array([0]), h, flat(h), np.array([start - al.BAND]), np.array([len(seq) + 2 * al.BAND]))
            out.append(pairs.score(block)[0])
        return out

    same, gone = scores(ref[20:70], True, 20)
    assert same > gone + 2
    same, gone = scores(deleted[20:70], True, 20)
    assert gone > same + 2
    plain = scores(ref[20:70], True, 20)[0]
    converted = ref[:40] + "T" + ref[41:]
    assert scores(converted[20:70], True, 20)[0] == pytest.approx(plain, abs=1e-6)
    assert scores(converted[20:70], False, 20)[0] < plain - 2


def test_slack_keeps_reads_with_gaps_the_haplotype_does_not_spell():
    rng = np.random.default_rng(7)
    ref = "".join(rng.choice(list("ACGT"), 400))
    extra = "".join(rng.choice(list("ACGT"), 30))
    reads = {  # sequence, placement of its first base, slack left and right
        "plain": (ref[100:200], 100, 0, 0),
        "deleted": (ref[100:150] + ref[180:230], 100, 0, 30),
        "inserted": (ref[100:150] + extra + ref[150:200], 100, 30, 0),
        "clipped": (ref[140:180] + ref[100:200], 60, 40, 40),
    }

    def score(names):
        block = al.ReadBlock([reads[n][0] for n in names], [[35] * len(reads[n][0]) for n in names], np.ones(len(names), bool))
        left, right = (np.array([reads[n][i] for n in names]) + al.BAND for i in (2, 3))
        pairs = al.Pairs()
        pairs.add(np.arange(len(names)), ref, np.full(len(ref), 0.5), np.array([reads[n][1] for n in names]) - left, block.length + left + right)
        return pairs.score(block)

    together = score(list(reads))
    for i, name in enumerate(reads):
        assert score([name])[0] == together[i]  # whatever else is in the batch
    plain, deleted, inserted, clipped = together
    # One gap costs its opening and extensions, not a read of mismatches.
    assert plain - 45 < deleted < plain and plain - 60 < inserted < plain
    no_room = al.Pairs()
    block = al.ReadBlock([reads["deleted"][0]], [[35] * 100], np.ones(1, bool))
    no_room.add(np.array([0]), ref, np.full(len(ref), 0.5), np.array([100 - al.BAND]), np.array([100 + 2 * al.BAND]))
    assert deleted > no_room.score(block)[0] + 15
