"""Reading the given tables, and helpers that several operators share."""

from __future__ import annotations

import functools
import gc
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cytoquill.session import cut_lineage, ensure_checkpoint_dir

#: A table of at most so many narrow rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000

__all__ = ["BROADCAST_ROWS", "columns", "cut_lineage", "ensure_checkpoint_dir", "hash_order", "hashed_sample", "load_arrays", "maybe_broadcast", "parts_for", "query_chunks", "release", "shared_arrays", "shared_file", "stored", "table", "unit"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects garbage, which a large heap with little work puts off until disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, with these types: whatever else a table holds cannot clash with what is added."""
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in types.items()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored narrow table if it is counted to be small, else leave it to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def unit(*parts: Column | str) -> Column:
    """A number in (0, 1) that the given values decide: reruns agree, and so do retried tasks."""
    bits = F.shiftrightunsigned(F.xxhash64(*(F.lit(p) if isinstance(p, str) else p for p in parts)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def hash_order(*parts: Column) -> list[Column]:
    """A fixed random order of rows."""
    return [F.xxhash64(*parts), *parts]


def hashed_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows with the smallest hashes of `keys`. A histogram of hashes says which rows can be among them, so that
    no more than those few meet in one task."""
    step = F.shiftrightunsigned(F.xxhash64(*keys), 48)
    held = 0
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), key=lambda r: r["step"]):  # at most 65,536 rows
        held += r["count"]
        if held >= n:
            df = df.where(step <= r["step"])
            break
    if held <= n:
        return df
    return df.orderBy(F.shiftrightunsigned(F.xxhash64(*keys), 1), *keys).limit(n)


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def shared_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Write bytes into the cluster's shared folder and have Spark ship the file to every executor once."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    jvm = context._jvm
    path = jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    context.addFile(path.toString())
    return path.getName()


def shared_arrays(spark: SparkSession, name: str, **arrays: np.ndarray) -> str:
    """Ship arrays to every executor as one file; `load_arrays` reads it there."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return shared_file(spark, out.getvalue(), name)


@functools.lru_cache(maxsize=4)
def load_arrays(name: str) -> dict[str, np.ndarray]:
    with np.load(SparkFiles.get(name)) as held:
        return dict(held)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table as Parquet into the cluster's shared folder and read it back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def query_chunks(items: DataFrame, chars: int) -> Iterator[list[Row]]:
    """The rows of a query set (item_id, text), in chunks of about `chars` characters: what reaches the driver at once is bounded."""
    rows = columns(items, item_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    chunks = parts_for(rows.agg(F.sum(F.length("text"))).first()[0] or 0, chars)
    for i in range(chunks):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == i).orderBy("item_id", "text").collect()
