"""Fingerprints: order, edited texts, likeness against exact similarity, near copies against brute force."""

import hashlib

import pytest

from cytoquill.llm import minhash

from .data import no_docs, odd_docs, odd_rows
from .test_jaccard import graded_rows, plain_components


def test_every_document_meets_the_next(spark):
    rows = odd_rows()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    expected = []
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        half = len(a) // 2
        changed = a[: len(a) - half] + b[:half]
        sets = [minhash.exact_jaccard(a, changed), minhash.exact_jaccard(a, b)]
        expected.append((i, len(a), hashlib.sha256(changed.encode()).hexdigest(), sets, bool(a.split()), bool(b.split())))
    for each in (7, 4000):
        found = minhash.fingerprint_in_order(odd_docs(spark, rows), each).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        found, expected = sorted(found, key=key), sorted(expected, key=key)
        assert [tuple(r[:3]) for r in found] == [e[:3] for e in expected]
        for r, e in zip(found, expected):
            if e[4] and e[5]:
                assert r["near_edited"] == pytest.approx(e[3][0], abs=0.16)
                assert r["near_next"] == pytest.approx(e[3][1], abs=0.16)


def test_equal_texts_equal_fingerprints(spark):
    rows = [(1, "a b c d e f g", None, None, 0), (2, "a b c d e f g", None, None, 0), (3, "", None, None, 0), (4, None, None, None, 0)]
    found = {r["doc_id"]: r for r in minhash.fingerprint_in_order(odd_docs(spark, rows)).collect()}
    assert found[1]["fingerprint"] == found[2]["fingerprint"] and found[1]["near_next"] == 1.0
    assert found[3]["near_next"] == 1.0 and found[4]["near_next"] == 0.0


def test_one_row_follows_itself(spark):
    found = minhash.fingerprint_in_order(odd_docs(spark, [(9, "one two three four five six", None, None, 0)])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in found] == [(9, 1.0)]


def test_near_duplicates(spark):
    for rows in (odd_rows(), graded_rows(3)):
        found = minhash.near_duplicates(odd_docs(spark, rows)).collect()
        expected = plain_components(rows, 5, 80)
        # Bands may miss a link near the threshold, and never add one.
        same = sum(a == b for a, b in zip(sorted((tuple(r) for r in found), key=repr), expected))
        assert same >= 0.97 * len(rows)
        first = {r[0]: r[2] for r in expected}
        groups = {}
        for r in (r for r in found if r["doc_id"] is not None):
            groups.setdefault(r["component_id"], set()).add(first[r["doc_id"]])
        assert all(len(g) == 1 for k, g in groups.items() if k is not None)


def test_empty(spark):
    assert minhash.fingerprint_in_order(no_docs(spark)).count() == 0
