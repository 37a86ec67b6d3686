"""Keyed sampling: the rows with the smallest pseudo-random keys per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 16


def smallest_keys(df: DataFrame, classes: Sequence[str], key: Column, caps: Column, key_range: int = 1 << 32) -> DataFrame:
    """Per class, the rows with the `caps` smallest keys (ties by all columns), with the key in `sample_key`.

    A class may hold most of the data, so it is never sorted whole: a histogram of the keys says up to
    which bin rows are needed, and only those few rows are ranked.
    """
    keyed = df.withColumns({"sample_key": key, "_cap": caps}).withColumn("_bin", F.expr(f"sample_key div {max(key_range // BINS, 1)}"))
    histogram = keyed.groupBy(*classes, "_bin").agg(F.count(F.lit(1)).alias("n"), F.max("_cap").alias("_cap"))
    upto = Window.partitionBy(*classes).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    needed = histogram.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("_before") < F.col("_cap"))
    likely = keyed.join(needed.select(*classes, "_bin"), [*classes, "_bin"], "left_semi")
    order = Window.partitionBy(*classes).orderBy("sample_key", *[c for c in df.columns if c not in classes])
    return likely.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_cap")).drop("_rank", "_cap", "_bin")


def row_key(seed: int, *columns: str) -> Column:
    """A 32-bit key fixed by the row's identity and the seed, whatever the partitioning."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(0xFFFFFFFF))


def holdout_shape(seen_pos: int, seen_neg: int, left_pos: int, left_neg: int, most: int = 100_000) -> tuple[int, int]:
    """How many positives and negatives to hold out of those left, as close as possible to the ratio of those seen.

    The size is the largest that neither class runs out at. A class that is left at all gives at least one row; with
    nothing seen, the ratio of those left is kept.
    """
    seen = (seen_pos, seen_neg) if seen_pos + seen_neg else (left_pos, left_neg)
    left = (left_pos, left_neg)
    whole = sum(seen)
    size = min([most, sum(left), *(n * whole // k for n, k in zip(left, seen) if k)])
    shares = [min(n, max(size * k // whole if whole else 0, min(n, 1))) for n, k in zip(left, seen)]
    spare = size - sum(shares)
    if spare > 0:
        short = max(range(2), key=lambda i: (size * seen[i] % whole, -i))
        shares[short] = min(left[short], shares[short] + spare)
    return shares[0], shares[1]
