"""Collocations against plain counts, and the parsing's own promises."""

import random
import re
from collections import Counter

import pytest

from cytoquill.llm import collocations

from .data import no_docs, odd_docs, odd_rows

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [WORD.findall(p) for p in PIECE.split(lowered)]


def plain(rows, least, covered, best):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for w in pieces(r[1]):
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    around = Counter()
    for p, a in held.items():
        lang, w = p[0], p[1:]
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[(lang, *w[i : i + k])] = max(around[(lang, *w[i : i + k])], a)
    out = {}
    for p, a in held.items():
        lang, w = p[0], p[1:]
        if 100 * around[p] >= covered * a:
            continue
        score, k = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted(
        ((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:best])), key=repr
    )


def some_rows(seed):
    """Texts over few words with set phrases, repeated passages, breaks, tabs, and odd characters."""
    rng = random.Random(seed)
    phrases = ["new york", "New  York city", "a b c d", "in\tthe middle of", "ünïcødé \U0001d538 here", "x x x x"]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = odd_rows(seed)
    for i in range(300, 420):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else f"v{rng.randrange(30)}" for _ in range(rng.randrange(60))]
        parts = [p + rng.choice(["", "", ".", ",", "\n", "\r\n", " ; ", "?!"]) for p in parts]
        text = " ".join(parts) + (passage if i % 3 == 0 else "")
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), "s", 0))
    return rows


@pytest.mark.parametrize("seed,least,best", [(1, 30, 2000), (2, 3, 20), (3, 2, 2000)])
def test_equal_plain_counts(spark, seed, least, best):
    rows = some_rows(seed)
    found = collocations.collocations(odd_docs(spark, rows), least, 80, best).collect()
    expected = plain(rows, least, 80, best)
    assert sorted((tuple(r) for r in found), key=repr) == expected
    assert expected


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 7)
    rows = some_rows(4)
    found = collocations.collocations(odd_docs(spark, rows), 3).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain(rows, 3, 80, 2000)


@pytest.mark.parametrize("longest", [4_096, 20])
def test_chunks_overlap_in_a_trigger_and_depend_on_content(monkeypatch, longest):
    monkeypatch.setattr(collocations, "CHUNK", longest)
    rng = random.Random(9)
    passage = " ".join(f"q{rng.randrange(1000)}" for _ in range(400))
    before = [" ".join(f"z{rng.randrange(50)}" for _ in range(30)) for _ in range(2)]
    parsed = [collocations.chunks([f"{b} {passage}".encode()]) for b in before]
    for found, b in zip(parsed, before, strict=True):
        split = [c.split(b" ") for c in found]
        for x, y in zip(split, split[1:], strict=False):
            assert x[-3:] == y[:3]
        joined = [w for c in split for w in c[:-3]]
        assert [w.decode() for w in joined if w != b"\n"] == f"{b} {passage}".split()
    if longest > 400:
        assert len(set(parsed[0]) & set(parsed[1])) >= min(map(len, parsed)) - 6
    assert collocations.chunks([b"", b" \t", b"..."]) == []
    assert max(len(c.split(b" ")) for c in collocations.chunks([b"same " * 1000])) <= longest + 3


def test_empty(spark):
    assert collocations.collocations(no_docs(spark)).count() == 0
    assert collocations.collocations(odd_docs(spark, [(1, None, None, None, 0), (2, "", "en", None, 0)])).count() == 0
