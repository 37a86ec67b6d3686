"""Sharding: balance, whole groups, gapless slots, and differencing against a plain version."""

import collections
import heapq
import zlib

import numpy as np

from cytoquill.llm import sharding

from .data import no_docs, odd_docs, odd_rows


def plain_loads(sizes, k):
    heap = [(-s, i, tuple([s] + [0] * (k - 1))) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        c = tuple(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
        heapq.heappush(heap, (-(c[0] - c[-1]), n, c))
        n += 1
    return heap[0][2]


def test_differencing_equals_plain_version():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 10_000, 300)
    loads = np.zeros((300, 5), np.int64)
    loads[:, 0] = sizes
    goes, final = sharding.difference(loads)
    assert tuple(final) == plain_loads(sizes.tolist(), 5)
    sums = np.bincount(goes[:, 0], weights=sizes, minlength=5)
    assert sums.tolist() == final.tolist()


def shards_of(spark, docs, rows, **more):
    found = sharding.shard(docs, **more).collect()
    assert len(found) == len(rows)
    places, slots, loads = collections.defaultdict(set), collections.defaultdict(list), collections.Counter()
    text = collections.defaultdict(list)
    for r in rows:
        data = (r[1] or "").encode()
        text[r[0], 1 + len(data), zlib.crc32(data)].append(r[1])
    for r in found:
        held = text[r["doc_id"], r["size"], r["text_crc32"]]
        places[held[0]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(p) == 1 for p in places.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_odd_rows(spark):
    rows = odd_rows()
    for block in (4, 4096):
        shards_of(spark, odd_docs(spark, rows), rows, block=block)


def test_balance_over_levels(spark):
    rows = [(i, f"{i} " + "x" * (i * 37 % 900), "en", "s", 1) for i in range(3000)]
    loads = shards_of(spark, odd_docs(spark, rows), rows, block=100)
    assert max(loads.values()) - min(loads.values()) <= 20


def test_many_slot_buckets(spark):
    rows = spark.range(500).selectExpr("id AS doc_id", "id AS row", "CAST(id % 3 AS INT) AS shard")
    found = sharding.number_slots(rows, 3, each=10).collect()
    for k in range(3):
        mine = [r["slot"] for r in found if r["shard"] == k]
        assert sorted(mine) == list(range(len(mine)))


def test_empty(spark):
    assert sharding.shard(no_docs(spark)).count() == 0
