"""Near-duplicate vectors by an inverted multi-index.

Each half of a vector (scaled to length 1) is quantised by a codebook of its own, and the pairs of nearest centroids form
a grid of cells. A vector's own cell is its home. A query visits cells in order of how near they can come to it: a vector whose
nearest centroid is c instead of the query's c* lies beyond the plane halfway between them, so it is at least
(d(c)^2 - d(c*)^2) / (2 |c - c*|) away in that half. Cells are visited until the two halves together exceed the
distance that belongs to the wanted cosine; nothing beyond can qualify, so recall is complete. What is found in
a cell is verified by the cosine in double precision.

Equal vectors of a label are one class with a count. Members of a cell and its visitors are cut into blocks,
each pair of blocks is one small matrix product, and only counts and a spanning forest of the links leave it, never
all pairs.

The codebooks are fitted on at most SAMPLE vectors, those with the smallest hashes; every vector is indexed.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without a label, link
with nothing and are their own component; vectors of different lengths are never compared (they count as different labels); repeated
rows are separate rows and link with each other; a row with a NULL vec_id links like others but never names a component (its own
is NULL if it links with no named one, and kept is then false); an empty table gives an empty result; only vec_id, embedding and label are read, so
further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.components import components
from cytoquill.llm.tables import columns, cut_lineage, hash_order

COSINE = 0.98
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 20_000
#: Centroids of a half: this many times the fourth root of the number of vectors, within these bounds. Fewer centroids mean
#: fewer cells to visit and larger products in a cell.
CENTROIDS = 0.7
LEAST_CENTROIDS, MOST_CENTROIDS = 8, 128
#: Vectors of a block.
BLOCK = 512
_SLACK = 1e-7


def fit_codebook(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows of a sample in hash order; an empty cluster keeps its centroid."""
    centroids = np.unique(x, axis=0)
    if len(centroids) <= k:
        return centroids
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        nearest = np.argmin(_squares(x, centroids), axis=1)
        held = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[held > 0] = sums[held > 0] / held[held > 0, None]
    return np.unique(centroids, axis=0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


def least_distance(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each half vector, and how far at least every centroid's other members are from it."""
    squares = _squares(x, c)
    nearest = np.argmin(squares, axis=1)
    between = np.sqrt(_squares(c, c))[nearest]
    gap = squares - squares[np.arange(len(x)), nearest][:, None]
    return nearest, np.where(between > 0, gap / (2 * np.maximum(between, 1e-12)), 0.0)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    # Scale first: lengths of very large or small components would overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(class, width, label, embedding, held, least) of every different usable vector of a label. Stored."""
    size = F.size("embedding")
    usable = F.col("label").isNotNull() & (size > 0) & F.exists("embedding", lambda v: v != 0)
    usable &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(usable).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("held"), F.min("vec_id").alias("least"))
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("class"), size.alias("width"), "label", "embedding", "held", "least"))


def _cells(books: dict[int, tuple[np.ndarray, np.ndarray]], radius: float):
    """For every class its home cell and all cells that a vector within the radius may live in."""

    def run(batches):
        for part in batches:
            for width, own in part.groupby("width"):
                first, second = books[int(width)]
                x = _unit(own["embedding"])
                half = int(width) // 2
                (i, a), (j, b) = least_distance(x[:, :half], first), least_distance(x[:, half:], second)
                limit = radius * radius + _SLACK
                for at in range(len(own)):
                    # Both halves in order of distance: the sequences are merged until no further cell can qualify.
                    near_a, near_b = np.flatnonzero(a[at] ** 2 <= limit), np.flatnonzero(b[at] ** 2 <= limit)
                    inside = a[at][near_a, None] ** 2 + b[at][None, near_b] ** 2 <= limit
                    u, v = np.nonzero(inside)
                    cells = near_a[u] * len(second) + near_b[v]
                    row = own.iloc[at]
                    home = int(i[at]) * len(second) + int(j[at])
                    yield pd.DataFrame(
                        {"class": row["class"], "width": int(width), "label": row["label"], "cell": cells.astype(np.int64), "home": cells == home, "held": row["held"]}
                    )

    return run


def _chunks(run):
    """Larger frames from many small ones."""

    def together(batches):
        held, size = [], 0
        for frame in run(batches):
            held.append(frame)
            size += len(frame)
            if size > 5_000:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return together


def _link_block(cosine: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        homes, guests = block[block["home"]], block[~block["home"]]
        if not len(homes) or not len(guests):
            return pd.DataFrame({"class": [], "links": [], "other": []})
        a, b = _unit(guests["vector"]), _unit(homes["vector"])
        left, right = guests["class"].to_numpy(), homes["class"].to_numpy()
        linked = (a @ b.T >= cosine) & (left[:, None] != right[None, :])
        links = linked @ homes["held"].to_numpy()
        # A spanning forest: each guest hangs on its first linked home, and homes that share a guest on one another.
        out_a, out_b, root = [], [], {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for g in np.flatnonzero(linked.any(axis=1)):
            for h in np.flatnonzero(linked[g]):
                x, y = find(left[g]), find(right[h])
                if x != y:
                    root[x] = y
                    out_a.append(left[g])
                    out_b.append(right[h])
        none = pd.Series([pd.NA] * len(left), dtype="Int64")
        found = pd.DataFrame({"class": left, "links": links.astype(np.int64), "other": none})
        return pd.concat([found[found["links"] > 0], pd.DataFrame({"class": out_a, "links": 0, "other": pd.array(out_b, dtype="Int64")})], ignore_index=True)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept."""
    kept = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = cut_lineage(columns(vectors, vec_id="bigint", embedding=kept, label="bigint"))
    classes = vector_classes(rows)
    books = {}
    for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect():
        picked = classes.where(F.col("width") == r["width"]).orderBy(*hash_order(F.col("class"))).limit(sample).select("embedding").toPandas()
        x, half = _unit(picked["embedding"]), r["width"] // 2
        k = int(np.clip(CENTROIDS * r["n"] ** 0.25, LEAST_CENTROIDS, MOST_CENTROIDS))
        books[r["width"]] = (fit_codebook(x[:, :half], k) if half else np.zeros((1, 0)), fit_codebook(x[:, half:], k))
    if not books:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    kind = "class bigint, width int, label bigint, cell bigint, home boolean, held bigint"
    visits = cut_lineage(classes.select("class", "width", "label", "embedding", "held").repartition("class").mapInPandas(_chunks(_cells(books, radius)), kind))
    # Every visitor of a cell, in blocks, meets every block of those at home there.
    per_cell = visits.groupBy("width", "label", "cell").agg(F.count(F.lit(1)).alias("guests"), F.count(F.when(F.col("home"), 1)).alias("homes")).where("homes > 0")
    vector = classes.select("class", F.col("embedding").alias("vector"))
    sized = visits.join(per_cell, ["width", "label", "cell"]).where("guests > 1").join(vector, "class")
    blocks = lambda n: F.ceil(F.col(n) / block)
    mine = lambda n, salt: F.pmod(F.xxhash64("class", F.lit(salt)), blocks(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))
    keys = ["width", "label", "cell", "guest_block", "home_block"]
    values = ["class", "held", "vector"]
    as_guest = sized.withColumn("guest_block", mine("guests", 1)).withColumn("home_block", all_of("homes")).select(*keys, *values, F.lit(False).alias("home"))
    at_home = sized.where("home").withColumn("home_block", mine("homes", 2)).withColumn("guest_block", all_of("guests")).select(*keys, *values, F.lit(True).alias("home"))
    found = cut_lineage(as_guest.unionAll(at_home).groupBy(*keys).applyInPandas(_link_block(cosine), "class bigint, links bigint, other bigint"))
    counts = found.where("other IS NULL").groupBy("class").agg(F.sum("links").alias("links"))
    linked = components(found.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    placed = classes.join(counts, "class", "left").join(linked.select(F.col("vertex").alias("class"), "component"), "class", "left")
    placed = placed.select("class", "label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "component").select("label", "embedding", F.col("n_links").alias("links"), "component_id", F.lit(True).alias("used"))
    joined = rows.join(named, ["label", "embedding"], "left")
    component = F.when(F.col("used"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
