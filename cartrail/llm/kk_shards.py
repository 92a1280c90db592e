"""Even shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that must not be split. Groups larger than a fixed
share of all bytes, of which there can be only ``HEAVY_GROUPS``, enter the
differencing one by one. All others are first gathered into ``BINS`` bins by a
hash of the text. So at most ``HEAVY_GROUPS + BINS`` items are differenced,
however large the table, and the assignment of a row is a lookup in two tables
of bounded size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartrail.llm.common import stored, stored_partitions

SHARDS = 16
HEAVY_GROUPS = 8192
BINS = 4096
ROWS_PER_CELL = 50_000


def difference(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item, by differencing.

    Every item starts as a partial partition with all in one part. The two with
    the largest spread are combined again and again, the largest part of one
    with the smallest of the other. Ties go by item number, so the result
    depends on the sizes alone.
    """
    if not sizes:
        return []
    parts: list[list[int]] = [[size] + [0] * (shards - 1) for size in sizes]
    # A combined node keeps its two children and, for each of its parts, the
    # part of either child that went into it.
    children: list[tuple[int, int, list[int], list[int]] | None] = [None] * len(sizes)
    queue = [(-size, node) for node, size in enumerate(sizes)]
    heapq.heapify(queue)
    while len(queue) > 1:
        _, one = heapq.heappop(queue)
        _, two = heapq.heappop(queue)
        sums = [a + b for a, b in zip(parts[one], reversed(parts[two]))]
        order = sorted(range(shards), key=lambda k: (-sums[k], k))
        made = [sums[k] for k in order]
        children.append((one, two, order, [shards - 1 - k for k in order]))
        parts[one] = parts[two] = []
        parts.append(made)
        heapq.heappush(queue, (made[-1] - made[0], len(parts) - 1))
    shard = [0] * len(sizes)
    labels: dict[int, list[int]] = {len(parts) - 1: list(range(shards))}
    for node in range(len(parts) - 1, -1, -1):
        label = labels.pop(node)
        if children[node] is None:
            shard[node] = label[0]
            continue
        one, two, from_one, from_two = children[node]
        left, right = [0] * shards, [0] * shards
        for k in range(shards):
            left[from_one[k]] = label[k]
            right[from_two[k]] = label[k]
        labels[one], labels[two] = left, right
    return shard


def assign_items(items: DataFrame, shards: int) -> DataFrame:
    """``items`` (``item``, ``bytes``), at most HEAVY_GROUPS + BINS of them, with ``shard``."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "item"], ascending=[False, True])
        return pd.DataFrame(
            {"item": frame["item"], "shard": np.array(difference(frame["bytes"].tolist(), shards), dtype=np.int32)}
        )

    return items.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, "item string, shard int")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document with its shard and its slot in it.

    A null text is a group of its own, of size 1, apart from the empty texts of
    the same size; the checksum of both is 0. Repeated rows are rows like any
    other. A group above a shard's even share makes that shard larger, as it may
    not be split. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored_partitions(
        docs.select(
            "doc_id",
            F.coalesce(F.sha2("text", 256), F.lit("null")).alias("_group"),
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
        ),
        ROWS_PER_CELL,
    )
    in_bin = F.concat(F.lit("bin"), F.pmod(F.xxhash64("_group"), F.lit(BINS)).cast("string"))
    groups = rows.groupBy("_group").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = stored(groups.filter(F.col("bytes") > total // HEAVY_GROUPS))
    light = (
        rows.join(F.broadcast(heavy.select("_group")), "_group", "left_anti")
        .groupBy(in_bin.alias("item"))
        .agg(F.sum("size").alias("bytes"))
    )
    items = heavy.select(F.col("_group").alias("item"), "bytes").unionByName(light)
    placed = F.broadcast(stored(assign_items(items, shards)))
    sharded = (
        rows.join(F.broadcast(heavy.select("_group", F.lit(True).alias("_heavy"))), "_group", "left")
        .withColumn("item", F.when(F.col("_heavy"), F.col("_group")).otherwise(in_bin))
        .join(placed, "item")
        .select("doc_id", "size", "text_crc32", "shard", "_mid", "_cell")
    )
    before = (
        sharded.groupBy("shard", "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0).cast("bigint"),
            ),
        )
        .drop("_n")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_mid"))
    return (
        sharded.withColumn("_rank", rank)
        .join(before, ["shard", "_cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_before") + F.col("_rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
