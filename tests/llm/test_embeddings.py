"""The multi-index against brute force, with copies, clusters and unusable vectors."""

import numpy as np
import pytest

from cytoquill.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, cosine):
    usable = [r[1] is not None and len(r[1]) > 0 and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if u else None for r, u in zip(rows, usable)]
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(find(i)) if usable[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(30):
        centre = rng.normal(size=12)
        for k in range(12):
            rows.append((len(rows), (centre + rng.normal(size=12) * rng.choice([0, 0.05, 0.12, 0.2])).tolist(), c % 3))
    rows += [(500 + i, rng.normal(size=12).tolist(), i % 3) for i in range(100)]
    rows += [rows[0], rows[0], (None, rows[0][1], 0), (None, [9.0] + [0.0] * 11, 2)]
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * 12, 1), (703, [1.0, None] + [0.0] * 10, 1), (704, [float("nan")] + [1.0] * 11, 1), (705, [float("inf")] + [1.0] * 11, 1)]
    rows += [(706, rows[0][1], None), (707, [1.0, 2.0], 1), (708, [1.0, 2.001], 1), (709, [3.0], 1), (710, [4.0], 1), (711, [-4.0], 1)]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 5)])
def test_equals_brute_force(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS class", "2 AS cell", "'x' AS held").repartition(4)
    found = embeddings.near_duplicates(df, block=block).collect()
    assert sorted((tuple(r[:3]) for r in found), key=repr) == plain(rows, 0.98)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(5)
    c, x, y = rng.normal(size=(20, 6)), rng.normal(size=(300, 6)), rng.normal(size=(300, 6))
    _, least = embeddings.least_distance(x, c)
    home, _ = embeddings.least_distance(y, c)
    for i in range(300):
        assert (least[i][home] <= np.linalg.norm(x[i] - y, axis=1) + 1e-9).all()


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(3, None, 1)], SCHEMA)).collect()] == [(3, 0, 3, True)]
