"""Ranked search against plain scoring, and the sharing DAG against plain sums."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from cytoquill.llm import search

from .data import no_docs, odd_docs, odd_rows, words
from .test_phrase_index import as_table, some_items, terms


def plain(rows, items, k=10):
    docs = [Counter(terms(r[1])) for r in rows]
    sizes = [sum(d.values()) for d in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for d in docs for t in d)
    out = []
    for item_id, text in items:
        scored = []
        for row, d, size in zip(rows, docs, sizes, strict=True):
            score = 0
            for t in terms(text):
                if d[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * d[t]) // (1000 * d[t] + 8 * (25 + (75 * size * n) // total)))
            if score > 0:
                scored.append((-score, row[0] is None, row[0]))
        out += [(item_id, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars,accumulators", [(400_000, 4_000_000), (40_000, 300)])
def test_results_equal_plain_scores(spark, monkeypatch, chars, accumulators):
    monkeypatch.setattr(search, "CHUNK_CHARS", chars)
    monkeypatch.setattr(search, "ACCUMULATORS", accumulators)
    rows = odd_rows()
    rows += [(200 + i, rows[7][1], "en", "copies", 0) for i in range(30)]
    items = some_items(rows)
    found = search.search(odd_docs(spark, rows), as_table(spark, items)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain(rows, items)


def test_sums_are_shared():
    rng = random.Random(4)
    common = [words(rng, 8, 50) for _ in range(4)]
    texts = [" ".join([rng.choice(common), words(rng, 5), rng.choice(common)]) for _ in range(40)] + ["", "w1 w1 w1"]
    plan = search.Plan(search.terms_of(texts))
    arrays = plan.arrays()
    single = sum(len(set(terms(t))) for t in texts)
    assert len(plan.sums) + sum(len(nodes) for nodes in plan.lists) < 0.7 * single
    values = np.random.default_rng(1).integers(0, 1 << 40, (len(plan.terms), 6))
    got = search.evaluate(arrays, values[arrays["leaf_terms"]] * arrays["leaf_times"][:, None])
    for row, i in zip(got, arrays["items"], strict=True):
        hashes = search.terms_of([texts[i]])[0]
        assert (row == values[np.searchsorted(plan.terms, hashes)].sum(axis=0)).all()
    assert len(plan.lists) - 2 not in arrays["items"]


def test_empty_tables(spark):
    items = as_table(spark, [(1, "a b c"), (2, None)])
    assert search.search(no_docs(spark), items).count() == 0
    assert search.search(odd_docs(spark), items.limit(0)).count() == 0
    assert search.search(odd_docs(spark, [(1, None, None, None, 0)]), items).count() == 0
