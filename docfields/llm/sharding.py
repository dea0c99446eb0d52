"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing on levels.

Groups are dealt to pieces by a hash, a number of pieces that depends on the number of groups and not on the partitions. Every
piece is differenced into `BUNDLES` bundles: the two partial partitions of largest spread are combined, oppositely ordered,
until one is left. The bundles are the items of the next level, as long as there are more than `ITEMS` of them; the driver
differences the last ones into shards. A ramp of virtual sizes makes the bundles of a piece differ in size, which gives the
next level items fine enough to even out whatever one huge group upsets. There are `PIECES` pieces at least, so the last level
has 50 times as many items as shards, or all groups themselves.

Defined results: a null text counts as an empty one and shares its group; equal texts share a shard; an empty
table gives an empty one; rows that are repeated are all placed, each with a slot of its own; a null id is an id like any
other; a very long text is one group and never cut; other columns are not looked at, whatever their names.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import settled

BUNDLES = 64
# Pieces at least, groups in a piece at most on average, and items of the driver at most.
PIECES = 32
PIECE = 20_000
ITEMS = 1 << 16
SLOT_BUCKETS = 512
ROW_BYTES = 8


def difference(sizes: list[int], ways: int, ramp: bool = False) -> list[int]:
    """The way (0 to `ways` - 1) of each size.

    Nodes are partial partitions: `ways` sums in falling order. A combined node remembers where each way of
    its two parts went; the places of all sizes are read off from the last node downwards.
    """
    if not sizes:
        return []
    zero = (0,) * (ways - 1)
    sums = [(size, *zero) for size in sizes]
    parts: list[tuple | None] = [None] * len(sums)
    if ramp:
        step = sum(sizes) / ways / ways
        sums.append(tuple(int(step * (ways - i)) for i in range(ways)))
        parts.append(None)
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        added = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(range(ways), key=added.__getitem__, reverse=True)
        sums.append(tuple(added[i] for i in order))
        sums[a] = sums[b] = ()
        rank = bytearray(ways)
        for place, i in enumerate(order):
            rank[i] = place
        parts.append((a, b, bytes(rank)))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    where: list[bytes | None] = [None] * len(parts)
    where[-1] = bytes(range(ways))
    for node in range(len(parts) - 1, -1, -1):
        if parts[node] is not None:
            a, b, rank = parts[node]
            where[a] = bytes(where[node][i] for i in rank)
            where[b] = where[a][::-1]
            where[node] = None
    return [where[i][0] for i in range(len(sizes))]


def bundled(items: DataFrame, pieces: int, bundles: int) -> DataFrame:
    """`items(key, bytes)` with `bundle`, a number over all pieces; every piece is differenced by itself."""
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("bytes").to_numpy()
        order = np.argsort(-sizes, kind="stable")
        bundle = np.empty(len(sizes), np.int64)
        bundle[order] = difference(sizes[order].tolist(), bundles, ramp=True)
        return pa.table({"key": table.column("key"), "bytes": table.column("bytes"),
                         "bundle": bundle + table.column("piece")[0].as_py() * bundles})

    dealt = items.withColumn("piece", F.pmod(F.xxhash64("key"), F.lit(pieces)))
    return dealt.groupBy("piece").applyInArrow(run, f"key {items.schema['key'].dataType.simpleString()}, bytes long, bundle long")


def shard(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", *,
          bundles: int = BUNDLES) -> DataFrame:
    """`id, size, text_crc32, shard, slot`: every row in one shard, equal texts together."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    items = settled(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    n, chosen = items.count(), None
    while chosen is None or n > ITEMS:
        placed = settled(bundled(items, max(PIECES, -(-n // PIECE)), bundles)).select("key", "bytes", "bundle")
        items = settled(placed.groupBy(F.col("bundle").alias("key")).agg(F.sum("bytes").alias("bytes")))
        here = placed.select("key", "bundle")
        chosen = here if chosen is None else chosen.join(here.toDF("bundle", "next"), "bundle").select("key", F.col("next").alias("bundle"))
        n = items.count()
    last = items.orderBy(F.col("bytes").desc(), "key").collect()
    ways = difference([r["bytes"] for r in last], shards)
    where = spark.createDataFrame([(r["key"], w) for r, w in zip(last, ways)], "bundle long, shard int")
    named = chosen.join(where, "bundle").select("key", "shard")
    return slots(rows.join(named, "key").drop("key")).withColumnRenamed("id", id_column)


def slots(rows: DataFrame) -> DataFrame:
    """`rows(id, …, shard)` with gapless `slot` numbers per shard.

    A shard is numbered in buckets of hashed rows, so that no task holds a shard, nor all rows of one id; the rows before a bucket
    are added up over `shards` x `SLOT_BUCKETS` counts.
    """
    bucket = F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(SLOT_BUCKETS)).cast("int")
    dealt = settled(rows.withColumn("bucket", bucket))
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr(
        "shard", "bucket", "sum(n) over (partition by shard order by bucket) - n as before")
    local = dealt.selectExpr(
        "*", "row_number() over (partition by shard, bucket order by id, text_crc32, size) - 1 as local")
    return (local.join(before, ["shard", "bucket"])
            .withColumn("slot", (F.col("before") + F.col("local")).cast("long"))
            .drop("before", "local", "bucket"))
