"""Shards of near equal bytes, equal texts kept together, by Karmarkar-Karp differencing.

A partial partition is one sum per shard. Differencing takes the two partial partitions of largest spread and puts them
together oppositely ordered, largest on smallest. Groups are dealt to buckets by their digest; each bucket is differenced
in one task to one partial partition, and those are differenced again, a bounded number at a time, until one is left. So
no task sees all groups, and nothing goes through the driver.
"""

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import plain_text
from quoteflow.sources.store import stored

SHARDS = 24
# Groups differenced in one task, partial partitions put together in one task, and pieces a hot group is numbered in.
BUCKET_GROUPS = 20_000
FAN_IN = 512
SALTS = 256


def difference(partials: list[list[int]], shards: int) -> list[list[int]]:
    """For each partial partition (`shards` sums), the final shard of each of its sums."""
    nodes: list[tuple] = []
    heap = []
    for number, sums in enumerate(partials):
        order = sorted(range(shards), key=lambda slot: -sums[slot])
        ranked = [sums[slot] for slot in order]
        heap.append((ranked[-1] - ranked[0], number, ranked))
        nodes.append((None, None, order))
    if not heap:
        return []
    heapq.heapify(heap)
    while len(heap) > 1:
        _, one, large = heapq.heappop(heap)
        _, other, small = heapq.heappop(heap)
        joined = [x + y for x, y in zip(large, reversed(small))]
        order = sorted(range(shards), key=lambda slot: -joined[slot])
        ranked = [joined[slot] for slot in order]
        nodes.append((one, other, order))
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))
    places: list = [None] * len(nodes)
    places[-1] = list(range(shards))
    for node in range(len(nodes) - 1, -1, -1):
        one, other, order = nodes[node]
        own = [0] * shards
        if one is None:
            for rank, slot in enumerate(order):
                own[slot] = places[node][rank]
            places[node] = own
            continue
        opposite = [0] * shards
        for rank, slot in enumerate(order):
            own[slot] = opposite[shards - 1 - slot] = places[node][rank]
        places[one], places[other] = own, opposite
        places[node] = None
    return places[: len(partials)]


def _pack_groups(shards: int):
    def pack(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["digest", "text_crc32", "size", "salt"], ignore_index=True)
        group = units.groupby(["digest", "text_crc32", "size"], sort=False).ngroup().to_numpy()
        sizes = (units["size"] * units["rows"]).groupby(group).sum().to_list()
        places = difference([[size] + [0] * (shards - 1) for size in sizes], shards)
        units["bin"] = pd.Series([places[g][0] for g in group], dtype="int32")
        units["start"] = units.groupby("bin")["rows"].cumsum() - units["rows"]
        return units[["digest", "text_crc32", "size", "salt", "rows", "bucket", "bin", "start"]]

    return pack


def _pack_bins(shards: int):
    def pack(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["bucket", "bin"], ignore_index=True)
        sums = bins.pivot_table(index="bucket", columns="bin", values="bytes", fill_value=0, aggfunc="sum")
        sums = sums.reindex(columns=range(shards), fill_value=0)
        places = dict(zip(sums.index, difference(sums.astype("int64").to_numpy().tolist(), shards)))
        bins["to_bin"] = pd.Series([places[b][i] for b, i in zip(bins["bucket"], bins["bin"])], dtype="int32")
        bins["to_start"] = bins.groupby("to_bin")["rows"].cumsum() - bins["rows"]
        return bins[["bucket", "bin", "bytes", "rows", "parent", "to_bin", "to_start"]]

    return pack


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """`key`, `size`, `text_crc32`, `shard` and `slot` (gapless from 0 in each shard) of every row.

    Size is the UTF-8 bytes of the text plus 8; a null text counts as empty, and all empty texts are one group. Equal
    texts share a shard, so a group larger than a shard's share makes that shard as large as the group. Repeated rows
    get slots of their own. An empty table gives no rows; other columns, whatever their names, are left out.
    """
    rows = df.select(
        F.col(key).alias("key"),
        (F.octet_length(plain_text(text)).cast("long") + 8).alias("size"),
        F.crc32(plain_text(text)).alias("text_crc32"),
        F.xxhash64(plain_text(text)).alias("digest"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int").alias("salt"),
    )
    unit = ["digest", "text_crc32", "size", "salt"]
    units = stored(rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows")), "units")
    buckets = max(1, math.ceil(units.count() / BUCKET_GROUPS))
    packed = stored(
        units.withColumn("bucket", F.pmod(F.col("digest"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(
            _pack_groups(shards),
            "digest long, text_crc32 long, size long, salt int, rows long, bucket long, bin int, start long",
        ),
        "packed",
    )
    bins = packed.groupBy("bucket", "bin").agg(
        F.sum(F.col("size") * F.col("rows")).alias("bytes"), F.sum("rows").alias("rows")
    )
    # `found` maps the bins of a bucket to a bin, and a first slot, of the partial partition it has gone into.
    found = packed.select(F.col("bucket").alias("b"), F.col("bin").alias("i")).distinct().select(
        "b", "i", F.col("b").alias("bucket"), F.col("i").alias("bin"), F.lit(0).cast("long").alias("shift")
    )
    while True:
        met = stored(
            bins.withColumn("parent", F.floor(F.col("bucket") / FAN_IN).cast("long"))
            .groupBy("parent")
            .applyInPandas(
                _pack_bins(shards),
                "bucket long, bin int, bytes long, rows long, parent long, to_bin int, to_start long",
            ),
            "bins",
        )
        found = found.join(met.select("bucket", "bin", "parent", "to_bin", "to_start"), ["bucket", "bin"]).select(
            "b", "i", F.col("parent").alias("bucket"), F.col("to_bin").alias("bin"),
            (F.col("shift") + F.col("to_start")).alias("shift"),
        )
        if buckets <= 1:
            break
        buckets = math.ceil(buckets / FAN_IN)
        bins = met.groupBy(F.col("parent").alias("bucket"), F.col("to_bin").alias("bin")).agg(
            F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")
        )
    placed = packed.join(
        found.select(F.col("b").alias("bucket"), F.col("i").alias("bin"), F.col("bin").alias("shard"), "shift"),
        ["bucket", "bin"],
    ).select(*unit, "shard", (F.col("start") + F.col("shift")).alias("first"))
    inside = Window.partitionBy(*unit).orderBy("key")
    return rows.withColumn("place", F.row_number().over(inside)).join(placed, unit).select(
        F.col("key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("place") - 1).cast("long").alias("slot"),
    )
