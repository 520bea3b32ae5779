"""Shared shapes of the text operators: reading tables, Arrow columns in bounded batches, connected components."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quoteflow.sources.store import stored

# Rows of one Arrow batch are worked on in slices of about this many bytes, whatever the length of a text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain_text(name: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded size; one row is never cut."""
    rows = batch.num_rows
    step = max(1, min(rows, rows * SLICE_BYTES // max(1, batch.nbytes)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def map_batches(
    df: DataFrame,
    schema: str | T.StructType,
    task: Callable[[], Callable[[pa.RecordBatch], Iterator[dict | pa.RecordBatch]]],
) -> DataFrame:
    """`task()` is made once per task and gives a function from a slice of rows to dictionaries of output columns."""
    wanted = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(wanted)

    def run(batches):
        work = task()
        for batch in batches:
            for piece in slices(batch):
                for out in work(piece):
                    if isinstance(out, dict):
                        out = pa.RecordBatch.from_arrays(
                            [pa.array(out[field.name], field.type) if not isinstance(out[field.name], (pa.Array, pa.ChunkedArray))
                             else out[field.name].cast(field.type) for field in arrow],
                            schema=arrow,
                        )
                    yield out

    return df.mapInArrow(run, wanted)


def with_column_in_batches(
    df: DataFrame, source: str, name: str, kind: T.DataType, task, arrow: bool = False
) -> DataFrame:
    """All columns of `df` and one more, made from the values of `source`; a column of that name is replaced.

    `task()` is made once per task and gives a function from a list of values (with `arrow`, an Arrow array) to a list
    (or Arrow array) of results.
    """
    kept = [column for column in df.columns if column != name]
    schema = T.StructType([*[df.schema[column] for column in kept], T.StructField(name, kind)])

    def start():
        work = task()

        def one(piece):
            values = piece.column(piece.schema.get_field_index(source))
            values = values if arrow else values.to_pylist()
            yield {**{column: piece.column(piece.schema.get_field_index(column)) for column in kept}, name: work(values)}

        return one

    return map_batches(df, schema, start)


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(`node`, `root`): for every node of the undirected links (`a`, `b`), the smallest node it can reach.

    Large-star and small-star steps by turns, until every node has one link, to its root; the longest path halves each
    time. A node with very many neighbours is only ever a minimum in a partial aggregate and a join key; the join is
    left to skew handling. Links are written to the shared folder at each turn, so a lost executor costs one turn.
    """
    edges = stored(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").where(F.col("a") != F.col("b")).distinct()
        edges = stored(small, label)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """No node has two links upwards, or one while others link to it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return seen.where("up > 1 or (up = 1 and least = 0)").isEmpty()
