"""Clusters of long groups are grown in stretches, and what reads say is added up where they are scored."""

import random

import numpy as np
import pandas as pd

from cytoquill.operators import haplotypes
from cytoquill.params import CallParams


def plain(columns, gap, limit):
    """Own events, then those of the columns of the chain by distance, equally far ones together, while they fit."""
    at, out, run, runs = sorted(columns), {}, 0, {}
    for i, p in enumerate(at):
        run += i > 0 and p - at[i - 1] > gap
        runs[p] = run
    for p in at:
        room = [(p, b) for b in columns[p]]
        others = [q for q in at if q != p and runs[q] == runs[p]]
        for d in sorted({abs(q - p) for q in others}):
            there = [(q, b) for q in others if abs(q - p) == d for b in columns[q]]
            if len(room) + len(there) <= limit:
                room += there
        out[p] = sorted(room)
    return out


def test_long_groups_are_grown_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(haplotypes, "GROUP_TILE", 16)
    rng, params = random.Random(4), CallParams()
    columns, at = {}, 5
    for _ in range(400):
        at += rng.choice([1, 1, 1, 2, 3, 21])
        columns[at] = rng.sample("ACG", rng.choice([1, 1, 2]))
    alts = spark.createDataFrame([("c", p, b) for p, bases in columns.items() for b in bases], "contig string, pos bigint, alt string")
    found = {r["cluster"]: [(e["anchor"], e["bases"]) for e in r["events"]] for r in haplotypes.snv_clusters(alts, None, params).collect()}
    assert found == plain(columns, params.cluster_gap, params.max_events)


def test_a_batch_adds_up_what_its_reads_say():
    n = 40
    window = "ACGTTGCAAGCTTAGGCTAACGTTAGCCATGCAATCGGATCCTA"
    pdf = pd.DataFrame({
        "contig": "c", "cluster": 20, "qname": [f"r{i}" for i in range(n)], "mapq": 60, "strand": "OT", "seq": window[12:28], "qual": [[30] * 16] * n,
        "r_start": 12, "lead_clip": 0, "slack_left": 0, "slack_right": 0,
    })
    cluster = haplotypes._Cluster(window, 0, ((20, "base", "G", 1),), ())
    out = haplotypes._score_batch(pdf, lambda row: cluster, CallParams())
    assert out.accounts.notna().tolist() == out.alleles.notna().tolist() == [True] + [False] * (n - 1)
    single = haplotypes._score_batch(pdf[:1], lambda row: cluster, CallParams())
    assert np.allclose(out.accounts[0], n * np.asarray(single.accounts[0]))
    assert out.alleles[0].tolist() == [n, 0, 0, 0]
