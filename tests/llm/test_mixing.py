"""Mixing: targets against a plain loop, words per source near them, and the odd cases."""

import collections
import re

import pytest

from cytoquill.llm import mixing

from .data import no_docs, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / share for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def check(rows, found):
    sizes = collections.Counter()
    largest = collections.Counter()
    for _, text, _, source, _ in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    target, taken = plain_targets(sizes), collections.Counter()
    assert len(found) == len(rows)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
        if sizes[r["source"]]:
            share = r["target"] / r["source_size"]
            assert r["size"] == 0 or abs(r["copies"] - share) < 1 + 1e-6
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6, s


@pytest.mark.parametrize("block", [3, 48])
def test_words_reach_targets(spark, block):
    rows = odd_rows()
    check(rows, mixing.mix(odd_docs(spark, rows), block=block).collect())


def test_reruns_agree(spark):
    get = lambda: sorted(map(tuple, mixing.mix(odd_docs(spark)).select("doc_id", "size", "copies").collect()), key=repr)
    assert get() == get()


def test_fractions_stay_right_on_average(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "ab"[i >= 30], 1) for i in range(40)]
    total = collections.Counter()
    for seed in range(8):
        for r in mixing.mix(odd_docs(spark, rows), seed=f"s{seed}", block=8).where("source = 'a'").collect():
            total[r["doc_id"]] += r["copies"]
            share = r["target"] / r["source_size"]
    assert abs(sum(total.values()) / (8 * 30) - share) < 0.08
    assert max(abs(v / 8 - share) for v in total.values()) < 0.75


def test_take_repeats_rows(spark):
    docs = odd_docs(spark)
    mixed = mixing.mix(docs)
    taken = mixing.take(docs, mixed)
    assert taken.columns == docs.columns
    assert taken.count() == mixed.agg({"copies": "sum"}).first()[0]


def test_empty(spark):
    assert mixing.mix(no_docs(spark)).count() == 0
