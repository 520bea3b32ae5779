"""Jaccard join of shingle sets by T-occurrence search, and the classes its links make.

Texts with equal sets are one class first. A set of n shingles is cut into parts by hashing, more parts than two similar
sets can differ in, so that similar sets share at least one whole part (pigeonhole); parts of several shingles are
shared by hardly anything else. Blocks of sets are searched with DivideSkip: short inverted lists are merged by a heap,
long ones probed by bisection, and sets that occur often enough are linked.

First each set is looked for from the lowest set it shares a part with, which joins groups of copies in one pass over
their members. Of sets that share a part and are not joined yet, all pairs are taken where they are few. Pairs are sifted
before any set is moved: a bit tells whether a bucket of shingles holds an odd number, sets differ by at least as many
shingles as bits, and those that differ by more than links allow go. The sift lets no link go.

Where pairs are too many, families, in which shared parts hang together, are dealt to blocks by size; every member
outside a family's largest joined group is looked for in the blocks of its own and neighbouring sizes. So no pair is a
row there, and members that are joined already are not compared again.
"""

import heapq
import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.llm.common import components, map_batches, plain_text
from quoteflow.sources.store import stored

WIDTH = 3
PERCENT = 90
# Words remembered by a task, parts that may be empty before an empty part counts, and records of one block.
CACHED_WORDS = 500_000
EMPTY_PARTS = 3
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
BROADCAST_ROWS, BROADCAST_COPIES = 500_000, 100_000
FIRST_QUERIES, MORE_QUERIES = 1, 4
# Pairs a member left, up to which all pairs of a group are compared at once.
ALL_PAIRS = 64
ODD = [np.uint64(one) for one in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mixed(numbers: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    out = numbers.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    return out ^ out >> np.uint64(33)


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes (64 bits)."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.known: dict[bytes, int] = {}

    def number(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            found = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        numbers = np.fromiter(map(self.number, words), np.uint64, len(words))
        width = min(self.width, len(words))
        out = np.full(len(words) - width + 1, len(words) if len(words) < self.width else 0, np.uint64)
        for at in range(width):
            out = mixed(out * ODD[0] + numbers[at : at + len(out)] * ODD[1] + ODD[2])
        return np.unique(out)


def needed(one: int, other: int, percent: int = PERCENT) -> int:
    """Least overlap of two sets of these sizes that links them: 100 * i >= percent * (one + other - i)."""
    return -(-percent * (one + other) // (100 + percent))


def size_class(size: int, percent: int = PERCENT) -> int:
    """Classes of sizes; sets that link are in the same class or in neighbouring ones."""
    return int(math.log(size) / math.log(100 / percent) + 1e-9)


def parts(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Digests of the parts of a set, in its own class of sizes and the one below.

    Two linked sets whose sizes are in class c or c+1 differ by at most d shingles, d from the greatest such sizes; of
    d + 1 + EMPTY_PARTS parts at least 1 + EMPTY_PARTS are equal. So a set may leave out its empty parts unless it has
    more than EMPTY_PARTS of them.
    """
    if not len(shingles):
        return np.empty(0, np.int64)
    found = []
    own = size_class(len(shingles), percent)
    for level in (own, own - 1):
        largest = (100 / percent) ** (level + 2) + 1
        differing = int((100 - percent) * 2 * largest / (100 + percent))
        count = differing + 1 + EMPTY_PARTS
        part = (mixed(shingles + ODD[2]) % np.uint64(count)).astype(np.int64)
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, part, mixed(shingles ^ ODD[1]))
        full = np.bincount(part, minlength=count) > 0
        keep = np.ones(count, bool) if count - full.sum() > EMPTY_PARTS else full
        name = np.arange(count, dtype=np.uint64) * ODD[0] + np.array([level + 2], np.uint64) * ODD[1]
        found.append(mixed(sums * ODD[2] + mixed(name))[keep])
    return np.concatenate(found).view(np.int64)


def odd_buckets(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of about as many buckets as shingles, set where the bucket holds an odd number of them (as words)."""
    buckets = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    held = np.bincount((mixed(shingles ^ ODD[0]) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").view(np.int64)


def may_link(n: Column, odd: Column, other_n: Column, other_odd: Column, percent: int) -> Column:
    """False only for sets that differ by more shingles than linked sets of their sizes can.

    A shingle in one of two sets changes one bit, so at least as many shingles differ as bits. The longer of two words
    of bits is folded to the buckets of the shorter one; sizes of linked sets differ by one fold, unless `percent` is low.
    """
    both = n + other_n
    allowed = both - 2 * F.ceil(F.lit(percent) * both / (100 + percent))
    words = F.least(F.size(odd), F.size(other_odd))

    def folded(bits: Column) -> Column:
        halves = F.zip_with(F.slice(bits, 1, words), F.slice(bits, words + 1, words), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(bits) > words, halves).otherwise(bits)

    unlike = F.zip_with(folded(odd), folded(other_odd), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differing = F.aggregate(unlike, F.lit(0), lambda sum, one: sum + one)
    uneven = F.greatest(F.size(odd), F.size(other_odd)) > 2 * words
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & (uneven | (differing <= allowed))


class Index:
    """Inverted lists of a block of sets."""

    def __init__(self, records: list[np.ndarray]):
        self.sizes = [len(one) for one in records]
        held = np.concatenate([np.empty(0, np.uint64), *records])
        order = np.argsort(held, kind="stable")
        self.held = held[order]
        self.owner = np.repeat(np.arange(len(records)), self.sizes)[order]

    def lists(self, query: np.ndarray) -> list[list[int]]:
        starts = np.searchsorted(self.held, query, "left")
        stops = np.searchsorted(self.held, query, "right")
        return sorted((self.owner[a:b].tolist() for a, b in zip(starts, stops) if a < b), key=len)

    def search(self, query: np.ndarray, percent: int = PERCENT) -> list[int]:
        """Which records link with the query (DivideSkip)."""
        size = len(query)
        fits = [one for one in self.sizes if one and needed(size, one, percent) <= min(size, one)]
        lists = self.lists(query) if fits else []
        if not lists:
            return []
        least = needed(size, min(fits), percent)
        # The longest lists are left out of the merge: with L of them a record needs `least - L` short ones at least.
        left_out = min(len(lists), least - 1, int(least / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - left_out], lists[len(lists) - left_out :]
        wanted = least - left_out
        linked = []
        heap = [(entry[0], number, 0) for number, entry in enumerate(short)]
        heapq.heapify(heap)
        while len(heap) >= wanted:
            record = heap[0][0]
            met = []
            while heap and heap[0][0] == record:
                met.append(heapq.heappop(heap))
            skip = record + 1
            if len(met) >= wanted:
                if self.enough(record, len(met), long, needed(size, self.sizes[record], percent)):
                    linked.append(record)
            else:
                # No record before that of the wanted-th list from here can be in so many lists.
                while len(met) < wanted - 1:
                    met.append(heapq.heappop(heap))
                skip = max(skip, heap[0][0])
            for _, number, place in met:
                entry = short[number]
                place = bisect_left(entry, skip, place)
                if place < len(entry):
                    heapq.heappush(heap, (entry[place], number, place))
        return linked

    @staticmethod
    def enough(record: int, count: int, long: list[list[int]], target: int) -> bool:
        """The record's count reaches the target with the long lists, which are probed as long as that can be."""
        for done, entry in enumerate(long):
            if count >= target or count + len(long) - done < target:
                break
            place = bisect_left(entry, record)
            count += place < len(entry) and entry[place] == record
        return count >= target


def described(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """key, n_shingles, a digest of the set, the digests of its parts, and its odd buckets."""

    def task():
        shingler = Shingler(width)

        def listed(arrays: list[np.ndarray]) -> pa.ListArray:
            ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))

        def describe(piece):
            sets = [shingler.shingles(one) for one in piece.column(1).to_pylist()]
            found = [parts(one, percent) for one in sets]
            odd = [odd_buckets(one) for one in sets]
            yield {
                "key": piece.column(0),
                "n": [len(one) for one in sets],
                "digest": [xxhash.xxh3_128_digest(one.tobytes()) for one in sets],
                "parts": listed(found),
                "odd": listed(odd),
            }

        return describe

    return map_batches(
        docs.select(F.col(key).alias("key"), plain_text(text)), "key long, n long, digest binary, parts array<long>, odd array<long>",
        task,
    )


def sets_of(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """key, size, class of sizes and the set as bytes."""

    def task():
        shingler = Shingler(width)

        def make(piece):
            found = [shingler.shingles(one) for one in piece.column(1).to_pylist()]
            yield {
                "key": piece.column(0),
                "n": [len(one) for one in found],
                "class": [size_class(len(one), percent) if len(one) else 0 for one in found],
                "shingles": [one.tobytes() for one in found],
            }

        return make

    return map_batches(
        docs.select(F.col(key).alias("key"), plain_text(text)), "key long, n long, class int, shingles binary", task
    )


def search_blocks(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (`a`, `b`) among pairs (`query`, `record`), both numbers of sets.

    The records of a query are dealt to blocks of bounded size, and the query's set goes to each of its blocks.
    """
    blocks = pairs.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    dealt = pairs.join(blocks, "query").select(
        "query", F.col("record").alias("key"), F.pmod(F.xxhash64("record"), F.col("blocks")).alias("block")
    )
    asked = blocks.select("query", F.col("query").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    rows = (
        dealt.withColumn("role", F.lit(1)).unionByName(asked.withColumn("role", F.lit(0)))
        .join(sets, "key")
        .repartition("query", "block").sortWithinPartitions("query", "block", "role", "key")
        .select("query", "key", "role", "shingles")
    )

    def task():
        state = {"sets": [], "key": None, "asked": False}

        def search(piece):
            linked: list[tuple[int, int]] = []
            block: list[tuple[int, np.ndarray]] = []

            def finish():
                if block:
                    index = Index([one for _, one in block])
                    for one in state["sets"]:
                        linked.extend((state["key"], block[i][0]) for i in index.search(one, percent))
                    block.clear()

            for query, key, role, held in zip(*(piece.column(i).to_pylist() for i in range(4))):
                shingles = np.frombuffer(held, np.uint64)
                if role == 0:
                    finish()
                    # A number that stands for several sets asks with each of them.
                    if state["asked"] or state["key"] != query:
                        state.update(sets=[], key=query, asked=False)
                    state["sets"].append(shingles)
                else:
                    state["asked"] = True
                    block.append((key, shingles))
            finish()
            yield {"a": [a for a, _ in linked], "b": [b for _, b in linked]}

        return search

    return map_batches(rows, "a long, b long", task)


def search_families(rows: DataFrame, percent: int) -> DataFrame:
    """Links (`a`, `b`) between sets of different roots in the same block.

    `rows`: family, class and bucket of the block; role 0 (record) or 1 (query), key, root, shingles. A block's records
    are bounded and indexed; its queries pass by.
    """
    block = ["family", "class", "bucket"]
    sorted_rows = rows.repartition(*block).sortWithinPartitions(*block, "role", "key").select(
        *block, "role", "key", "root", "shingles"
    )

    def task():
        state = {"block": None, "records": [], "index": None}

        def search(piece):
            found: list[tuple[int, int]] = []
            for family, size, bucket, role, key, root, held in zip(*(piece.column(i).to_pylist() for i in range(7))):
                if state["block"] != (family, size, bucket):
                    state.update(block=(family, size, bucket), records=[], index=None)
                shingles = np.frombuffer(held, np.uint64)
                if role == 0:
                    state["records"].append((key, root, shingles))
                    continue
                if state["index"] is None:
                    state["index"] = Index([one for _, _, one in state["records"]])
                for i in state["index"].search(shingles, percent):
                    if state["records"][i][1] != root:
                        found.append((key, state["records"][i][0]))
            yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

        return search

    return map_batches(sorted_rows, "a long, b long", task)


def family_rows(members: DataFrame) -> DataFrame:
    """Blocks of families: family, class, bucket, role, key, root. `members`: family, id, root, class, n."""
    giants = members.groupBy("family", "root").count().groupBy("family").agg(
        F.max(F.struct("count", "root"))["root"].alias("giant")
    )
    weight = F.greatest(F.max("n"), F.lit(BLOCK_SHINGLES // BLOCK_ROWS))
    buckets = members.groupBy("family", "class").agg(
        F.ceil(F.count(F.lit(1)) * weight / BLOCK_SHINGLES).cast("long").alias("buckets")
    )
    records = members.join(buckets, ["family", "class"]).select(
        "family", "class", F.pmod(F.xxhash64("id"), F.col("buckets")).alias("bucket"), F.lit(0).alias("role"),
        F.col("id").alias("key"), "root",
    )
    asked = members.join(giants, "family").where(F.col("root") != F.col("giant")).select(
        "family", F.explode(F.array(*[F.col("class") + step for step in (-1, 0, 1)])).alias("class"), "id", "root"
    )
    queries = asked.join(buckets, ["family", "class"]).select(
        "family", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"),
        F.lit(1).alias("role"), F.col("id").alias("key"), "root",
    )
    return records.unionByName(queries)


def joined_within(groups: DataFrame, told: DataFrame, sets, percent: int) -> DataFrame | None:
    """(`node`, `root`) of all sets (`id`) that links join; `groups`: part, id. Sets without links may be left out.

    `told` gives `n` and `odd` of each id, `sets` the sets of some ids.
    """

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        held = pairs.select(F.explode(F.array("query", "record")).alias("id")).distinct()
        return stored(search_blocks(pairs, sets(held).select("key", "shingles"), percent), "links")

    others = told.withColumnsRenamed({"id": "query", "n": "other_n", "odd": "other_odd"})

    def sifted(met: DataFrame) -> DataFrame:
        likely = may_link(F.col("n"), F.col("odd"), F.col("other_n"), F.col("other_odd"), percent)
        described = met.select("query", "id").distinct().join(told, "id").join(others, "query")
        return described.where(likely).select("query", F.col("id").alias("record")).distinct()

    lows = groups.groupBy("part").agg(F.min("id").alias("query"))
    links = linked(sifted(groups.join(lows, "part").where(F.col("id") != F.col("query"))))
    roots = components(links)
    rooted = stored(
        groups.join(roots.withColumnRenamed("node", "id"), "id", "left").select("part", "id", F.coalesce("root", "id").alias("root")),
        "rooted",
    )
    still_open = rooted.groupBy("part").agg(
        F.min("id").alias("low"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("members")
    ).where("r0 <> r1")
    left = stored(rooted.join(still_open.select("part", "low", "members"), "part"), "left")
    rows, pairs = left.agg(F.count(F.lit(1)), F.sum((F.col("members") - 1) / 2)).first()
    if not rows:
        return roots
    if pairs <= ALL_PAIRS * rows:
        here = left.select("part", "id", "root")
        there = here.withColumnsRenamed({"id": "query", "root": "query_root"})
        apart = (F.col("id") > F.col("query")) & (F.col("root") != F.col("query_root"))
        more = linked(sifted(here.join(there, "part").where(apart)))
        return components(links.unionByName(more))
    families = components(left.select(F.col("low").alias("a"), F.col("id").alias("b")))
    held = stored(sets(left.select("id").distinct()), "sets")
    members = stored(
        left.select("id", "root").distinct()
        .join(families.select(F.col("node").alias("id"), F.col("root").alias("family")), "id")
        .join(held.select(F.col("key").alias("id"), "n", "class").distinct(), "id"),
        "members",
    )
    more = stored(search_families(family_rows(members).join(held.select("key", "shingles"), "key"), percent), "links")
    return components(links.unionByName(more))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of one number a row, broadcast if it has few rows, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def links_within(groups: DataFrame, compare, label: str, likely) -> DataFrame | None:
    """(`node`, `root`) of all members (`id`) that the links inside groups (`part`) join; members without links are left out.

    `compare` gives the links (`a`, `b`) among pairs (`query`, `record`), of which `likely` tells by the part and the
    members' `sketch` whether they are worth it. In each round the lowest members of a group
    not yet asked are the queries, and the records are members not known to be joined with them; groups in which all
    are joined are done. A group of copies so costs one pass over its members, never all its pairs; only members that
    share a part and are not joined by anything are compared one by one, which no exact answer can do without. As soon
    as those pairs are few for the members left, all are compared in one join and the rounds end.
    """
    live = stored(groups.withColumn("root", F.col("id")), label)
    links = None
    roots = None
    queries = FIRST_QUERIES
    query = [F.col("id").alias("query"), F.col("root").alias("qroot"), F.col("sketch").alias("qsketch")]
    while True:
        sizes = live.groupBy("part").agg(
            F.min("id").alias("low"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")
        ).where("r0 <> r1")
        if queries == FIRST_QUERIES:
            rows = None
            asked = live.join(sizes.select("part", "low"), "part").where(F.col("id") == F.col("low")).select("part", *query)
        else:
            still_open = stored(sizes.select("part", "n"), label)
            rows, left = still_open.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
            if not rows:
                break
            live = stored(live.join(still_open.select("part"), "part"), label)
            if left <= ALL_PAIRS * rows:
                asked = live.select("part", *query)
            else:
                rows = None
                # The lowest of each slice of a group, by hash, so that no window sorts a group.
                asked = stored(
                    live.groupBy("part", F.pmod(F.xxhash64("id"), F.lit(queries)).alias("slice"))
                    .agg(F.min_by(F.struct("id", "root", "sketch"), "id").alias("one")).select("part", "one.*").select("part", *query),
                    label,
                )
        apart = F.col("id") > F.col("query") if rows else F.col("id") != F.col("query")
        met = live.join(asked, "part").where((F.col("root") != F.col("qroot")) & apart)
        pairs = met.where(likely(F.col("part"), F.col("sketch"), F.col("qsketch"))).select("query", F.col("id").alias("record"))
        new = stored(compare(pairs.distinct()), label)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            roots = stored(components(links, label), label)
        if rows:
            break
        live = live.join(asked.select("part", F.col("query").alias("id")), ["part", "id"], "left_anti").select("part", "id", "sketch")
        if roots is not None:
            live = live.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
                "part", "id", "sketch", F.coalesce("root", "id").alias("root")
            )
        else:
            live = live.withColumn("root", F.col("id"))
        live = stored(live, label)
        queries = MORE_QUERIES if queries == FIRST_QUERIES else queries * MORE_QUERIES
    return roots


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """`key`, `n_shingles` and `component_id` (smallest key reachable by links, itself included) of every row.

    Words are runs of signs that are no ASCII white space, A-Z lower-cased; a text of fewer than `width` words is one
    shingle, and a null, empty or blank text has none and is linked with nothing. `key` is an integer. Rows of the same
    key are told apart by nothing: each gets the count of its own text, and they are one node of the links. A null key
    can't be a node: such a row gets the component of an equal text, else null. An empty table gives no rows; other
    columns are left out.
    """
    told = stored(described(docs, key, text, width, percent), "sets")
    named = told.where((F.col("n") > 0) & F.col("key").isNotNull())
    # One set stands for all texts with that set: the one of the lowest key.
    classes = stored(named.groupBy("digest").agg(F.min("key").alias("id")), "classes")
    # The others are told by key and digest, so that no parts are moved where these are few.
    others = named.select("key", "digest").join(classes, "digest").where(F.col("key") != F.col("id")).select("key", "digest")
    stands = named.join(small_side(stored(others.distinct(), "copies"), BROADCAST_COPIES), ["key", "digest"], "left_anti")
    parted = stands.select(F.explode("parts").alias("part"), F.col("key").alias("id"))
    # Parts of one set only are dropped where they meet, so that no table of them goes through the driver.
    ends = Window.partitionBy("part")
    shared = parted.withColumns({"low": F.min("id").over(ends), "high": F.max("id").over(ends)}).where("low < high")
    groups = stored(shared.select("part", "id").distinct(), "parts")
    wanted = stored(groups.select("id").distinct(), "wanted")
    odd = stored(stands.select(F.col("key").alias("id"), "n", "odd").join(wanted, "id", "left_semi").distinct(), "odd")

    def sets(ids: DataFrame) -> DataFrame:
        asked = docs.select(key, text).join(ids.select(F.col("id").alias(key)), key, "left_semi")
        return sets_of(asked, key, text, width, percent)

    roots = joined_within(groups, odd, sets, percent)
    joined = classes
    if roots is not None:
        joined = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("id"))
    return told.join(joined, "digest", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("id", "key").alias("component_id")
    )
