"""Lloyd's clustering with the dimensions dealt to shards.

A vector of whole numbers is stored as column blocks. In each round a task sees one block of the columns and the slice
of every centroid in that block, and gives partial squared distances; sums by vector add the blocks, and the least sum is
the vector's cluster. Every shard then moves its own slice: sums and counts of its columns by cluster. No task sees a whole
centroid, and only the slices (clusters x dimensions numbers) come to the driver. All sums are whole numbers, so neither the
order of rows nor the partitioning changes a result.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.sources.store import stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
SHARDS = 4
# Squared distances of components below this, over 64 dimensions, stay below 2^63.
GREATEST = 1 << 27


def whole_vectors(df: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(`key`, `whole`): vectors of the right length without null, NaN or infinite components, as floor(scale * x)."""
    parts = F.col(vector).cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.when(F.size(parts) == dimensions, finite)
    small = F.forall(parts, lambda x: F.abs(x * scale) < GREATEST)
    whole = F.when(small, F.transform(parts, lambda x: F.floor(x * scale).cast("int"))).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is {GREATEST} or more: its distances do not fit a long"))
    )
    return df.select(F.col(key).alias("key"), F.col(vector)).where(F.coalesce(fits, F.lit(False))).select("key", whole.alias("whole"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose keys have the least hashes, as rows; equal hashes by components, null keys last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    chosen = vectors.orderBy(digest.asc_nulls_last(), "whole").limit(clusters).select("whole").collect()
    return np.array([row["whole"] for row in chosen], np.int64)


def _partial_distances(blocks: DataFrame, slices: np.ndarray) -> DataFrame:
    """(`id`, `key`, `d0`..): squared distances of every block row to each centroid's slice of that block."""
    names = [f"d{number}" for number in range(len(slices))]
    schema = T.StructType([blocks.schema["id"], blocks.schema["key"], *[T.StructField(name, T.LongType()) for name in names]])

    def measure(batches):
        for batch in batches:
            held = batch.column(batch.schema.get_field_index("slice")).flatten()
            rows = held.to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            sums = [((rows - centre) ** 2).sum(axis=1) for centre in slices]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, sums)], names=["id", "key", *names])

    return blocks.mapInArrow(measure, schema)


def assign(vectors: DataFrame, centroids: np.ndarray, shards: list[slice]) -> DataFrame:
    """(`id`, `key`, `cluster`, `distance`): partial distances by column block, added by vector, the least taken.

    Only the first block carries the key.
    """
    parts = []
    for number, columns in enumerate(shards):
        key = F.col("key") if not number else F.lit(None).cast(vectors.schema["key"].dataType)
        block = vectors.select("id", key.alias("key"), F.col(f"b{number}").alias("slice"))
        parts.append(_partial_distances(block, centroids[:, columns]))
    sums = [F.sum(f"d{number}").alias(f"d{number}") for number in range(len(centroids))]
    total = reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.max("key").alias("key"), *sums)
    nearest = F.array_min(F.array(*[F.struct(F.col(f"d{i}").alias("distance"), F.lit(i).alias("cluster")) for i in range(len(centroids))]))
    return total.select("id", "key", nearest.alias("near")).select("id", "key", "near.cluster", "near.distance")


def move(vectors: DataFrame, assigned: DataFrame, centroids: np.ndarray, shards: list[slice]) -> np.ndarray:
    """Centroids with every shard's slice replaced by the floor of its mean; those without vectors stay.

    Floors are exact: the sum less its remainder is divided.
    """
    width = max(columns.stop - columns.start for columns in shards)
    blocks = F.array(*[F.struct(F.lit(number).alias("shard"), F.col(f"b{number}").alias("slice")) for number in range(len(shards))])
    own = vectors.join(assigned.select("id", "cluster"), "id").select("cluster", F.explode(blocks).alias("b")).select("cluster", "b.*")
    sums = own.groupBy("shard", "cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.try_element_at("slice", F.lit(place + 1))).alias(f"s{place}") for place in range(width)]
    )
    mean = [F.expr(f"(s{place} - pmod(s{place}, n)) div n").alias(f"s{place}") for place in range(width)]
    moved = centroids.copy()
    # One row per shard and cluster.
    for row in sums.select("shard", "cluster", *mean).collect():
        columns = shards[row["shard"]]
        moved[row["cluster"], columns] = row[2 : 2 + columns.stop - columns.start]
    return moved


def cluster(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = 1,
    shards: int = SHARDS,
) -> DataFrame:
    """`key`, `cluster`, `distance`, `cluster_inertia`, `inertia` and `centroid` (array) of every vector kept.

    Vectors of another length or with null, NaN or infinite components are left out; components become
    floor(scale * x). The first centroids are the vectors whose keys have the least sha256 (equal keys: least
    components); with fewer vectors there are fewer clusters, with none no rows. Equal distances go to the lower number,
    and a cluster that loses all its vectors keeps its centroid. Repeated rows are vectors of their own; a null key is
    clustered, but chosen as a first centroid last. Other columns, whatever their names, are left out. A component whose
    squares would not fit a long raises an error.
    """
    kept = whole_vectors(df, key, vector, dimensions, scale)
    width = -(-dimensions // shards)
    slices = [slice(start, min(start + width, dimensions)) for start in range(0, dimensions, width)]
    # A column for each block: a task reads its own block's only. Ids are fixed by being written.
    vectors = stored(
        kept.select(
            F.monotonically_increasing_id().alias("id"), "key", "whole",
            *[F.slice("whole", columns.start + 1, columns.stop - columns.start).alias(f"b{i}") for i, columns in enumerate(slices)],
        ).drop("whole"),
        "vectors",
    )
    whole = F.concat(*[f"b{i}" for i in range(len(slices))])
    centroids = first_centroids(vectors.select("key", whole.alias("whole")), clusters, seed)
    kinds = "id long, key {}, cluster int, distance long".format(vectors.schema["key"].dataType.simpleString())
    if not len(centroids):
        assigned = df.sparkSession.createDataFrame([], kinds)
    else:
        for _ in range(rounds):
            centroids = move(vectors, assign(vectors, centroids, slices), centroids, slices)
        assigned = stored(assign(vectors, centroids, slices), "assigned")
    by_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = assigned.agg(F.sum("distance").alias("inertia")).select("inertia").scalar()
    table = F.array(*[F.array(*map(F.lit, one)).cast("array<long>") for one in centroids.tolist()]) if len(centroids) else F.lit(None).cast("array<array<long>>")
    # At most one row per cluster.
    return assigned.join(F.broadcast(by_cluster), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", inertia.alias("inertia"),
        F.get(table, F.col("cluster")).alias("centroid"),
    )
