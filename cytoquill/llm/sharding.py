"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes, equal texts kept together.

A group (all rows of one text) is indivisible. Every group starts as a partial partition with its bytes in one of
the shards; the two partial partitions with the largest spread are combined in opposite order, until one is left.
Groups are dealt into blocks by hash, each block is differenced by one task, and the partial partitions that the
blocks end with are differenced again, level by level, so no task sees more than a block. A block of a level only
says which of its shards each child's shards go to, and these maps are joined back down the tree.

Slots number the rows of a shard without gaps: rows are numbered within small hash buckets of the shard, and buckets
start where the ones before them end.

Defined results: NULL text counts as a group of its own, of 1 byte per row and CRC 0; a NULL doc_id is a value like
any other; repeated rows share their text's shard and get slots of their own; an empty table gives an empty result; only doc_id
and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquill.llm.tables import columns, cut_lineage, parts_for

SHARDS = 8
#: Groups, or partial partitions of blocks, that one task differences.
BLOCK = 4096
#: Rows of a shard that are numbered together.
SLOT_ROWS = 20_000


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over n partial partitions of k shards (n x k loads): the shard that each child's shards go to
    (n x k), and the loads of the final shards, descending."""
    n, k = loads.shape
    order = np.argsort(-loads, axis=1, kind="stable")
    heap = []
    for i in range(n):
        row = loads[i, order[i]]
        heap.append((-int(row[0] - row[-1]), i, row, order[i]))
    heapq.heapify(heap)
    merges, node = [], n
    while len(heap) > 1:
        _, a, left, left_order = heapq.heappop(heap)
        _, b, right, right_order = heapq.heappop(heap)
        total = left + right[::-1]
        rank = np.argsort(-total, kind="stable")
        total = total[rank]
        place = np.empty(k, np.int64)
        place[rank] = np.arange(k)
        # place: position in the combined order of each of the left's positions; the right's are reversed.
        merges.append((node, a, place, b, place[::-1]))
        heapq.heappush(heap, (-int(total[0] - total[-1]), node, total, None))
        node += 1
    _, root, final, _ = heap[0]
    where = {root: np.arange(k)}
    for parent, a, left_place, b, right_place in reversed(merges):
        at = where.pop(parent)
        where[a], where[b] = at[left_place], at[right_place]
    goes = np.empty((n, k), np.int64)
    for i in range(n):
        goes[i, order[i]] = where[i]
    return goes, final


def _difference_block(shards: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("child", kind="stable", ignore_index=True)
        loads = np.stack(block["loads"].to_numpy()).astype(np.int64)
        goes, final = difference(loads)
        return pd.DataFrame({"block": block["block"], "child": block["child"], "goes": list(goes), "total": [final] * len(block)})

    return run


_DIFFERENCED = "block bigint, child string, goes array<bigint>, total array<bigint>"


def assign_groups(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """Shard of every group: reads (child string, bytes) with distinct children, returns (child, shard)."""
    count = groups.count()
    blocks = parts_for(count, block)
    alone = F.concat(F.array(F.col("bytes")), F.array_repeat(F.lit(0).cast("bigint"), shards - 1))
    level = groups.select(F.pmod(F.xxhash64("child"), F.lit(blocks)).alias("block"), "child", alone.alias("loads"))
    levels = []
    while True:
        done = cut_lineage(level.groupBy("block").applyInPandas(_difference_block(shards), _DIFFERENCED))
        levels.append(done)
        if blocks <= 1:
            break
        blocks = parts_for(blocks, block)
        nodes = done.groupBy("block").agg(F.first("total").alias("loads"))
        level = nodes.select(F.pmod(F.col("block"), F.lit(blocks)).alias("parent"), F.col("block").cast("string").alias("child"), "loads").withColumnRenamed("parent", "block")
    maps = levels[-1].select("child", "goes")
    for lower in reversed(levels[:-1]):
        upper = maps.select(F.col("child").alias("block"), F.col("goes").alias("up"))
        joined = lower.select(F.col("block").cast("string").alias("block"), "child", "goes").join(upper, "block")
        maps = joined.select("child", F.transform("goes", lambda g: F.get("up", g.cast("int"))).alias("goes"))
    return maps.select("child", F.get("goes", F.lit(0)).cast("int").alias("shard"))


def number_slots(rows: DataFrame, shards: int, each: int = SLOT_ROWS) -> DataFrame:
    """Add `slot`: rows of a shard numbered from 0 without gaps. Reads shard and doc_id of stored rows."""
    buckets = parts_for(rows.count(), each * shards)
    placed = rows.withColumn("slot_bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "slot_bucket").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("shard").orderBy("slot_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "slot_bucket", F.coalesce(before, F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "slot_bucket").orderBy("doc_id", "row")) - 1
    numbered = placed.withColumn("nth", nth)
    return numbered.join(starts, ["shard", "slot_bucket"]).withColumn("slot", F.col("start") + F.col("nth")).drop("start", "nth", "slot_bucket")


def shard(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, shard, slot."""
    text = columns(docs, doc_id="bigint", text="string")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    group = F.coalesce(F.md5("text"), F.lit("null"))
    rows = cut_lineage(text.select("doc_id", size.alias("size"), crc.alias("text_crc32"), group.alias("child"), F.monotonically_increasing_id().alias("row")))
    groups = cut_lineage(rows.groupBy("child").agg(F.sum("size").alias("bytes")))
    placed = cut_lineage(rows.join(assign_groups(groups, shards, block), "child").select("doc_id", "size", "text_crc32", "shard", "row"))
    return number_slots(placed, shards).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"))
