"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A row's hash gives its position on a ring of 65,536 positions, and it belongs to the next virtual node clockwise. No
shard takes more than its bound; rows that overflow a full shard go on clockwise to the next node with room. With the
bounds that make the row counts at most one apart (law `rows`), every shard ends exactly full. What overflows where
is settled on the row counts of the positions, which are as many at any input size; each row then finds its shard by
its position and its rank there. Where a position holds over a thousandth of all rows, as with many equal rows, its rows
are ranked within their input splits, so none is ranked in one task.

With bounds this tight, one shard more moves rows between old shards too (README has the share): the price of counts at
most one apart.

Edge cases: a null text counts as none, so its size is 8. Null ids and repeated rows are placed like any others, equal
rows in either order; an empty table gives no rows; other columns are ignored. Text length doesn't matter.
"""

from __future__ import annotations

import hashlib
from collections import deque
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm import common

POSITIONS = 1 << 16
#: A position with more rows than this, and over a thousandth of all, is ranked in so many parts.
LEAST_CROWD, SALTS = 4096, 64


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node in ring order; a shard's nodes don't depend on the number of shards unless two meet."""
    if shards * replicas > POSITIONS // 4:
        raise ValueError("too many virtual nodes for the ring")
    at: dict[int, int] = {}
    for shard in range(shards):
        for k in range(replicas):
            position = int.from_bytes(hashlib.md5(f"{shard}/{k}".encode()).digest()[:2], "big")
            while position in at:
                position = (position + 1) % POSITIONS
            at[position] = shard
    return sorted(at.items())


def place(counts: dict[int, int], shards: int, replicas: int) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each position go: (position, first rank, end rank, shard, slot of the first)."""
    nodes, total = ring(shards, replicas), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    waiting: deque[list[int]] = deque()
    own: list[list[list[int]]] = [[] for _ in nodes]
    node = 0
    for position in sorted(counts):
        while node < len(nodes) and nodes[node][0] < position:
            node += 1
        own[node % len(nodes)].append([position, 0, counts[position]])
    out = []
    for turn in range(2):  # in the second turn only what has overflowed is left
        for (_, shard), mine in zip(nodes, own):
            waiting.extend(mine if not turn else ())
            while waiting and used[shard] < room[shard]:
                position, first, end = waiting.popleft()
                n = min(end - first, room[shard] - used[shard])
                out.append((position, first, first + n, shard, used[shard]))
                used[shard] += n
                if first + n < end:
                    waiting.appendleft([position, first + n, end])
    return out


def assign(docs: DataFrame, shards: int = 24, replicas: int = 64) -> DataFrame:
    """A row for each document: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot (gapless in the shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "text_crc32")).withColumn("position", F.shiftrightunsigned("hash", 48).cast("int"))
    # Ranks count on each row's split, so rows are written with theirs: the input may be split otherwise when it is read again.
    rows = common.stash(rows.withColumn("split", F.spark_partition_id()), "rows")
    counts = {r["position"]: r["n"] for r in rows.groupBy("position").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    crowded = [p for p, n in counts.items() if n * 1000 > total and n > LEAST_CROWD]  # a thousand positions at most
    salt = F.when(F.col("position").isin(crowded), F.col("split") % SALTS).otherwise(F.lit(0)) if crowded else F.lit(0)
    rows = rows.withColumn("salt", salt)
    before = []
    if crowded:
        splits = rows.where(F.col("position").isin(crowded)).groupBy("position", "salt").agg(F.count(F.lit(1)).alias("n")).orderBy("position", "salt").collect()
        for position, parts in groupby(splits, key=lambda r: r["position"]):
            past = 0
            for r in parts:
                before.append((position, r["salt"], past))
                past += r["n"]
    spark = docs.sparkSession
    plan = spark.createDataFrame(place(counts, shards, replicas), "at int, first long, end long, shard int, base long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("position", "salt").orderBy("hash", "doc_id", "size")).cast("long") - 1)
    if before:
        past = spark.createDataFrame(before, "position int, salt int, past long")
        ranked = ranked.join(F.broadcast(past), ["position", "salt"], "left").withColumn("rank", F.col("rank") + F.coalesce("past", F.lit(0)))
    placed = ranked.join(F.broadcast(plan), (F.col("position") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
