"""Shared shapes: first and last wins, skew-safe numbering, size-checked broadcast."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.sources.store import stored

# Orders are numbered in stretches of this width, so no task sorts more than one stretch of a group.
STRETCH = 1 << 16
BROADCAST_ROWS = 10_000


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key. A partial aggregate, so a hot key is reduced before the shuffle."""
    return _extreme(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _extreme(df, keys, order, F.max_by)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    columns = df.columns
    rest = [name for name in columns if name not in keys]
    best = pick(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*columns)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    ties: Sequence[str] = (),
    stretch: int = STRETCH,
) -> DataFrame:
    """1..n per key in the order of an integer column, without sorting a whole group in one task.

    The order column is cut into stretches; rows are numbered inside a stretch and shifted by the counts of the
    stretches before it. With no keys this numbers the whole table the same way.
    """
    # One key of all, in which nulls are equal: rows lie by it for the numbers and stay there for the join.
    place = F.struct(*keys, F.floor(F.col(order) / F.lit(stretch)).cast("long").alias("_stretch"))
    cut = df.withColumn("_in", place).drop(*keys)
    before = Window.partitionBy(*[f"_in.{key}" for key in keys]).orderBy("_in._stretch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = cut.groupBy("_in").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_in", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("_in").orderBy(order, *ties)
    joined = cut.withColumn("_row", F.row_number().over(inside)).join(shifts, "_in", "left")
    rows = [F.col(f"_in.{one}") if one in keys else F.col(one) for one in df.columns]
    return joined.select(*rows, (F.col("_row") + F.col("_shift")).cast("long").alias(name))


def number_all(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """1..n over a whole table in the given (total) order.

    The table is range partitioned and written, so partitions follow each other and hold still; rows are numbered
    inside each and shifted by the sizes of the ones before. Only one row per partition is ever looked at together.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = stored(ranged, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = placed.withColumn("_row", F.row_number().over(inside)).join(shifts, "_part")
    return numbered.select(*df.columns, (F.col("_row") + F.col("_shift")).cast("long").alias(name))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, stretch: int = STRETCH
) -> DataFrame:
    """Sum of `value` over the rows before and including this one, in stretches like `number_rows`."""
    cut = df.withColumn("_stretch", F.floor(F.col(order) / F.lit(stretch)).cast("long"))
    parts = [*keys, "_stretch"]
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = cut.groupBy(*parts).agg(F.sum(value).alias("_sum")).select(
        *[F.col(part).alias(f"_k_{part}") for part in parts],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"),
    )
    inside = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("_upto", F.sum(value).over(inside))
    match = [F.col(part).eqNullSafe(F.col(f"_k_{part}")) for part in parts]
    joined = summed.join(shifts, match, "left")
    return joined.select(*df.columns, (F.col("_upto") + F.col("_shift")).alias(name))


def ordered_list(value: Column, *order: Column | str) -> Column:
    """An aggregate: the values as an array in the given order. For groups bounded by their nature only."""
    keys = [F.col(one) if isinstance(one, str) else one for one in order]
    entry = F.struct(*[key.alias(f"k{i}") for i, key in enumerate(keys)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(entry)), lambda one: one["v"])


def left_join_filled(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """A left join on a text key in which null and blank keys, which match nothing, do not all go to one task.

    They are dealt by the rest of their row under keys that no text has, so `rows` is read once.
    """
    plain = [name for name, kind in rows.dtypes if name != key and "map<" not in kind]
    apart = F.concat(F.lit("\u0000"), F.xxhash64(F.lit(0), *plain).cast("string"))
    filled = F.when(F.coalesce(F.col(key), F.lit("")) != "", F.col(key)).otherwise(apart)
    # A name of its own on either side, as one input may be made of the other.
    met = named.withColumnRenamed(key, "_met")
    joined = rows.withColumn("_asked", filled).join(met, F.col("_asked") == F.col("_met"), "left").drop("_asked", "_met")
    return joined.select(key, *[name for name in joined.columns if name != key])


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a rule table read from storage once its size is checked; else leave the join to Spark."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df
