"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays in one shard. Groups, the largest first, go to
the least-loaded shard through a heap (law ``bytes``). Groups that hold at least 1/``units`` of all
bytes are scheduled one by one, so there are at most ``units`` of them; the others are first tied
into ``units`` bundles by a hash of the text, which keeps groups whole. So the heap sees at most
2 x ``units`` items however many rows there are, and all work over rows stays in Spark.

Edge cases: a null text counts as empty (size 1, crc32 0) and shares a group with empty texts. Equal
rows keep separate slots; null doc_ids sort first within a slot run. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Longest processing time first: (item, size) pairs to shards; ties by item."""
    loads = [(0, s) for s in range(shards)]
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(loads)
        placed[item] = s
        heapq.heappush(loads, (load + size, s))
    return placed


def shard_documents(docs: DataFrame, shards: int = 8, units: int = 8192, slot_runs: int = 512) -> DataFrame:
    """Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    Slots are gapless from 0 in each shard: rows are dealt to ``slot_runs`` runs by doc_id, runs are
    laid end to end by their counts, and rows are numbered inside a run, so that no task numbers a
    whole shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(slot_runs)).cast("int").alias("run"),
    )
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("size"))
    total = docs.select(F.sum(F.octet_length(text).cast("long") + 1)).first()[0] or 0
    heavy_from = max(1, -(-total // units))
    bundle = F.pmod(F.col("text_key"), F.lit(units)).cast("int")
    weighed = groups.groupBy((F.col("size") >= heavy_from).alias("heavy"), F.when(F.col("size") >= heavy_from, F.col("text_key")).otherwise(bundle.cast("long")).alias("unit"))
    sizes = weighed.agg(F.sum("size").alias("size")).collect()  # at most 2 x units rows
    items = {i: (r["heavy"], r["unit"]) for i, r in enumerate(sorted(sizes, key=lambda r: (r["heavy"], r["unit"])))}
    by_unit = {(r["heavy"], r["unit"]): r["size"] for r in sizes}
    placed = schedule([(i, by_unit[u]) for i, u in items.items()], shards)
    plan = [(u[0], u[1], placed[i]) for i, u in items.items()]
    heavy = spark.createDataFrame([(u, s) for h, u, s in plan if h], "text_key long, heavy_shard int")
    light = spark.createDataFrame([(u, s) for h, u, s in plan if not h], "bundle long, light_shard int")
    dealt = (
        rows.join(F.broadcast(heavy), "text_key", "left")
        .withColumn("bundle", bundle.cast("long"))
        .join(F.broadcast(light), "bundle", "left")
        .select("doc_id", "size", "text_crc32", "run", F.coalesce("heavy_shard", "light_shard").alias("shard"))
    )
    counts = dealt.groupBy("shard", "run").agg(F.count("*").alias("n")).collect()  # at most shards x slot_runs rows
    starts, next_slot = [], dict.fromkeys(range(shards), 0)
    for r in sorted(counts, key=lambda r: (r["shard"], r["run"])):
        starts.append((r["shard"], r["run"], next_slot[r["shard"]]))
        next_slot[r["shard"]] += r["n"]
    offsets = spark.createDataFrame(starts, "shard int, run int, first_slot long")
    order = W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("row", F.row_number().over(order))
        .join(F.broadcast(offsets), ["shard", "run"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("row") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
