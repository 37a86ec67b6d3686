"""Importance resampling: scores against a plain version, the exact top k, held-out ranking, odd cases."""

import random

import numpy as np
import pytest

from cytoquill.llm import resampling
from cytoquill.llm.hashing import shingle_hashes, word_hashes

from .data import no_docs, odd_docs, odd_rows

SF = "/root/testdata/sf0.01"


def plain_buckets(text):
    out = np.zeros(resampling.BUCKETS)
    for _, _, words, bounds in word_hashes([text]):
        own = words[bounds[0] : bounds[1]]
        for w in own:
            out[int(w) % resampling.BUCKETS] += 1
        for i in range(len(own) - 1):
            out[int(shingle_hashes(own[i : i + 2], 2)[0]) % resampling.BUCKETS] += 1
    return out


def test_importance_equals_plain_version(spark):
    rows = odd_rows()
    docs = odd_docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)] + [(None, 1, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    ratio = resampling.importance(docs, labels)
    counts = [plain_buckets(r[1]) for r in rows]
    raw = sum(counts)
    target = sum(c for c, r in zip(counts, rows) if r[0] is not None and r[0] < 60 and r[0] % 2)
    prior = (raw + 1) / (raw + 1).sum()
    expected = np.log((target + resampling.BUCKETS * prior) / (target.sum() + resampling.BUCKETS)) - np.log(prior)
    assert np.allclose(ratio, expected)
    found = resampling.score(docs, ratio).collect()
    want = sorted((round(float(c @ expected), 6), int(c.sum())) for c in counts)
    assert np.allclose(sorted((round(r["importance"], 6), r["n_grams"]) for r in found), want, atol=1e-4)


@pytest.mark.parametrize("k", [0, 1, 37, 500, 999, 1000])
@pytest.mark.parametrize("ties", [False, True])
def test_top_k_is_exact(spark, k, ties, monkeypatch):
    monkeypatch.setattr(resampling, "STEPS", 5)
    rng = random.Random(k)
    rows = [(i % 700 if i % 7 else None, i % 3, i, float(rng.randrange(4)) if ties else rng.gauss(0, 9)) for i in range(1000)]
    scored = spark.createDataFrame(rows, "doc_id bigint, mark bigint, row bigint, noisy double")
    kept = {r["row"] for r in resampling.top_k(scored, k).where("kept").collect()}
    order = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    assert kept == {r[2] for r in order[:k]}


def test_good_documents_rank_higher(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = resampling.resample(docs, fit).join(held, "doc_id").collect()
    good, bad = ([r["importance"] for r in found if r["quality"] == q] for q in (1, 0))
    above = np.mean([g > b for g in good for b in bad])
    assert above >= 0.8
    assert np.mean([r["kept"] for r in found if r["quality"] == 1]) > np.mean([r["kept"] for r in found if r["quality"] == 0])


def test_odd_cases(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = resampling.resample(odd_docs(spark), labels).collect()
    assert len(found) == len(odd_rows()) and {r["importance"] for r in found} == {0.0}
    assert sum(r["kept"] for r in found) == round(0.5 * len(found))
    assert resampling.resample(no_docs(spark), labels).count() == 0
