"""The positional index against plain scans of texts: windows, short items, slop, odd rows, test sets in several parts."""

import hashlib
import random
import re

import pytest

from cytoquill.llm import phrase_index

from .data import no_docs, odd_docs, odd_rows, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def windows_of(item, window):
    w = terms(item)
    k = min(window, len(w))
    return [(i, w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def plain(rows, items, window):
    out = []
    for row in rows:
        w, hit, found = terms(row[1]), set(), set()
        for item_id, text in items:
            for _, g in windows_of(text, window):
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        hit.update(range(i, i + len(g)))
                        found.add(item_id)
        named = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((row[0], len(w), len(hit), len(found), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def some_items(rows, seed=3):
    """Passages of documents, some altered, some short, repeated, without id, without words, or absent."""
    rng = random.Random(seed)
    items = []
    for i in range(12):
        w = (rows[rng.randrange(60)][1] or "").split() or ["none"]
        at = rng.randrange(len(w))
        items.append((i * 7, ". ".join(w[at : at + 25]).upper()))
    items += [(100, rows[77 - 1][1]), (101, "tail words"), (102, "W3"), (103, words(rng, 40)), (104, None), (105, "?!"), (None, rows[61][1]), (None, "nobody")]
    items += [(0, items[0][1]), (0, rows[9][1]), (106, "ünïcødé \U0001d538"), (107, "w1 w1 w1")]
    return items


def as_table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS items", "0 AS n_hit")


@pytest.mark.parametrize("window,segment,chars", [(10, 1 << 19, 4_000_000), (3, 500, 40_000), (1, 40, 4_000_000)])
def test_hits_equal_plain_scan(spark, monkeypatch, window, segment, chars):
    monkeypatch.setattr(phrase_index, "SEGMENT_WORDS", segment)
    monkeypatch.setattr(phrase_index, "CHUNK_CHARS", chars)
    monkeypatch.setattr(phrase_index, "STEP", 50)
    rows = odd_rows()
    items = some_items(rows)
    index = phrase_index.build(odd_docs(spark, rows))
    found = phrase_index.digest_columns(phrase_index.contamination(index, as_table(spark, items), window)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain(rows, items, window)
    assert any(r["contaminated"] for r in found)


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_matches_equal_plain_scan(spark, slop):
    rng = random.Random(8)
    rows = [(i, words(rng, 60, 12), "en", "s", 0) for i in range(25)] + [(25, "", "en", "s", 0)]
    items = [(1, words(rng, 6, 12)), (2, words(rng, 3, 12)), (3, "w1 w2"), (None, words(rng, 5, 12))]
    index = phrase_index.build(odd_docs(spark, rows))
    found = phrase_index.matches(index, as_table(spark, items), 4, slop).collect()
    expected = []
    for row in rows:
        w = terms(row[1])
        for item_id, text in items:
            for at, g in windows_of(text, 4):
                starts = [
                    s
                    for s in range(len(w) - len(g) + 1)
                    if all(any(w[p] == t for p in range(max(0, s + k - slop), min(len(w), s + k + slop + 1))) for k, t in enumerate(g))
                ]
                expected += [(row[0], item_id, at, s) for s in (starts[:1] if slop else starts)]
    assert sorted((tuple(r) for r in found), key=repr) == sorted(expected, key=repr)
    assert expected


def test_empty_tables(spark):
    items = as_table(spark, [(1, "a b c")])
    assert phrase_index.contamination(phrase_index.build(no_docs(spark)), items).count() == 0
    index = phrase_index.build(odd_docs(spark))
    assert phrase_index.contamination(index, items.limit(0)).where("n_hit > 0 OR n_items > 0").count() == 0
    assert phrase_index.contamination(index, as_table(spark, [(1, None)])).where("n_hit = 0").count() == len(odd_rows())
