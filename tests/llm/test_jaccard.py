"""The Jaccard join against all pairs, over odd rows and groups of graded near copies."""

import random
import re

import numpy as np
import pytest

from cytoquill.llm import jaccard
from cytoquill.llm.components import components
from cytoquill.llm.hashing import mix
from cytoquill.session import cut_lineage

from .data import no_docs, odd_docs, odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_set(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def plain_components(rows, n, percent):
    sets = [gram_set(r[1], n) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        k = root(i)
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def graded_rows(seed):
    """Groups whose members differ by 0 to 25 % of their words, around a passage that all groups share."""
    rng = random.Random(seed)
    passage, rows = words(rng, 50).split(), []
    for g in range(8):
        base = words(rng, rng.choice([4, 12, 40, 150])).split() + passage
        for _ in range(14):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.03, 0.05, 0.1, 0.25]))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(copy).replace("w1", "W1"), "en", f"s{g}", 0))
    return rows


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("kind", ["odd", 1, 2])
def test_components_equal_all_pairs(spark, n, percent, kind, monkeypatch):
    if kind == 2:  # every segment counts as a large one
        monkeypatch.setattr(jaccard, "SMALL_SEGMENT", 1)
        monkeypatch.setattr(jaccard, "CLASS_BLOCK", 3)
        monkeypatch.setattr(jaccard, "FEW_PAIRS", 2)
        monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rows = odd_rows() if kind == "odd" else graded_rows(kind)
    found = jaccard.jaccard_components(odd_docs(spark, rows), n, percent).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_components(rows, n, percent)


def test_similar_sets_share_a_segment():
    rng = np.random.default_rng(11)
    for percent in (80, 90):
        sizes = jaccard.Sizes(percent)
        for trial in range(600):
            size = int(rng.integers(1, 300))
            x = np.unique(mix(rng.integers(0, 1 << 62, size, dtype=np.uint64)))
            keep = x[rng.permutation(len(x))[: max(1, int(np.ceil(len(x) * rng.uniform(percent / 100, 1))))]]
            extra = int(len(x) * 100 / percent) - len(x)
            y = np.unique(np.concatenate([keep, mix(rng.integers(0, 1 << 62, int(rng.integers(0, extra + 1)), dtype=np.uint64))]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                a, b = (set(np.concatenate(jaccard.segments(s, sizes)).tolist()) for s in (x, y))
                assert a & b, (percent, trial, len(x), len(y))


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100)]
    found = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def plain_labels(links):
    label = {v: v for link in links for v in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components_of_odd_graphs(spark, seed):
    rng = random.Random(seed)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(90)]
    path = rng.sample(ids[:30], 30)
    links = list(zip(path, path[1:], strict=False)) + [(v, ids[31]) for v in ids[31:50]] + [tuple(rng.sample(ids[50:80], 2)) for _ in range(25)]
    links += [(b, a) for a, b in links[::3]] + links[::4]
    odd = [(ids[85], ids[85]), (ids[86], None), (None, ids[87])]
    found = components(spark.createDataFrame(links + odd, "a bigint, b bigint")).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain_labels(links).items())
    assert components(spark.createDataFrame(odd, "a bigint, b bigint")).collect() == []


def test_components_do_not_carry_settled_vertices(spark, monkeypatch):
    """A long path takes many steps; pairs and stars beside it are settled at once and must not go through each of them."""
    links = [(i, i + 1) for i in range(64)] + [(i, i + 1) for i in range(1_000, 5_000, 2)] + [(10_000, i) for i in range(10_001, 12_000)]
    stored = []

    def counted(df):
        stored.append(cut_lineage(df))
        return stored[-1]

    monkeypatch.setattr("cytoquill.llm.components.cut_lineage", counted)
    found = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(65), 0), **{i: i - i % 2 for i in range(1_000, 5_000)}, **dict.fromkeys(range(10_000, 12_000), 10_000)}
    assert sum(df.count() for df in stored) < 6 * len(links)


def test_classes_of_many_large_segments_hang_on_one_hub(spark, monkeypatch):
    """Segments of 40 neighbours each: links to name their groups follow the hubs, not the classes of every segment."""
    rows = [(s, c, c % 3) for g in range(4) for s in range(100 * g, 100 * g + 20) for c in range(1_000 * g + s % 5, 1_000 * g + 400)]
    rows += [(500 + i, 9_000 + c, 0) for i in range(3) for c in range(10 * i, 10 * i + 12)]
    given = []

    def counted(links):
        given.append(links.where("a <> b").distinct().count())
        return components(links)

    monkeypatch.setattr(jaccard, "components", counted)
    mixed = spark.createDataFrame(rows, "segment bigint, class bigint, component bigint")
    found = jaccard._grouped(mixed).collect()
    assert sorted(tuple(r) for r in found) == sorted({(c, k, 9_000 if c >= 9_000 else c - c % 1_000) for _, c, k in rows})
    assert given[0] <= 4 * 4 + 2


def test_a_large_group_links_few_hubs(spark, monkeypatch):
    """Near copies that share many large segments: the links that group their segments stay far fewer than the classes."""
    rng = random.Random(5)
    base, rows, given = words(rng, 60).split(), [], []
    for i in range(1_500):
        copy = list(base)
        for k in rng.sample(range(60), 2):
            copy[k] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(copy), "en", "s", 0))

    def counted(links):
        given.append(links.where("a <> b").distinct().count())
        return components(links)

    monkeypatch.setattr(jaccard, "components", counted)
    jaccard.jaccard_components(odd_docs(spark, rows), 3, 90).count()
    assert len(given) == 3 and given[1] < 500


def test_empty(spark):
    assert jaccard.jaccard_components(no_docs(spark), 3, 90).count() == 0


def test_blocks_count_overlaps_and_give_out_a_forest():
    rng = np.random.default_rng(3)
    x, y = ([np.unique(rng.integers(-500, 500, int(rng.integers(0, 300)))) for _ in range(n)] for n in (40, 60))
    may = rng.random((40, 60)) < 0.7
    plain = np.array([[len(np.intersect1d(a, b)) for b in y] for a in x])
    found = jaccard._overlaps(x, y, may)
    assert (found[may] == plain[may]).all()
    for share in (0.0, 0.01, 0.03, 0.5):
        link = rng.random((40, 60)) < share
        edges = jaccard._forest(link)
        assert len(edges) < 100 and all(link[e] for e in edges)

        def groups(pairs):
            label = list(range(100))
            for i, j in pairs:
                old, new = label[40 + j], label[i]
                label = [new if v == old else v for v in label]
            return {tuple(k for k, v in enumerate(label) if v == g) for g in label}

        assert groups(edges) == groups(np.argwhere(link))


def test_a_group_of_near_copies_that_no_hub_joins(spark):
    """Members differ from each other as much as from the hub; few pairs are near enough."""
    rng = random.Random(2)
    base, rows = words(rng, 60).split(), []
    for i in range(1_500):
        copy = list(base)
        for k in rng.sample(range(60), 2):
            copy[k] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(copy), "en", "s", 0))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(odd_docs(spark, rows), 3, 90).collect()}
    sets = [gram_set(r[1], 3) for r in rows]
    owners = {}
    for i, s in enumerate(sets):
        for g in s:
            owners.setdefault(g, []).append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j):
                both = len(sets[i] & sets[j])
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    low, high = sorted((root(i), root(j)))
                    label[high] = low
    assert found == {i: root(i) for i in range(len(rows))}


def test_blocks_of_a_group_meet_once_and_only_near_sizes(spark):
    rng = random.Random(6)
    rows = [(1, c, c % 90, rng.choice([0, 1, 2, 9]), rng.random() < 0.7) for c in range(200)]
    rows = [(g, c, part, step, guest, 2 * step + guest, 1, b"", []) for g, c, part, step, guest in rows]
    kind = "group bigint, class bigint, component bigint, step int, guest boolean, sheet int, size bigint, outline binary, grams array<bigint>"
    sheets = [(1, step, guest, 2 * step + guest, 3) for step in (0, 1, 2, 9) for guest in (False, True)]
    made = spark.createDataFrame(sheets, "group bigint, step int, guest boolean, sheet int, blocks bigint")
    cells = {}
    for r in jaccard._cells(spark.createDataFrame(rows, kind), made).collect():
        cells.setdefault((r["lo"], r["hi"]), []).append((r["class"], r["first"], r["second"]))
    met = [tuple(sorted((a, b))) for (lo, hi), held in cells.items() for a, x, _ in held for b, _, y in held if x and y and (lo != hi or a < b)]
    near = [(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and abs(a[3] - b[3]) <= 1 and (a[4] or b[4])]
    assert sorted(met) == sorted(near)
    assert sum(len(held) for held in cells.values()) < sum(2 * 3 * 4 for _ in rows)
