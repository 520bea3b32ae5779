"""Tables written to the cluster's shared folder, to cut lineage where a result is read several times."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# The folders of tables that go with a step, from the outermost step to the innermost.
_PASSING: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("passing", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder `spark.checkpoint.dir` names. Only a local session may go without: it gets one of its own."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="quoteflow-")
    spark.conf.set(SETTING, folder)
    return folder


@contextmanager
def passing() -> Iterator[None]:
    """Tables stored inside are removed at the end, except those stored to `outlive` it.

    Only what is stored to outlive it may be used afterwards: other results are still to be read from what is gone.
    """
    tables: list[tuple[SparkSession, str]] = []
    before = _PASSING.set((*_PASSING.get(), tables))
    try:
        yield
    finally:
        _PASSING.reset(before)
        for spark, path in tables:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(
    df: DataFrame, label: str = "table", by: str | None = None, codec: str | None = None, outlive: bool = False
) -> DataFrame:
    """The same rows, read back from a table of their own; with `by`, one folder for each value of that last column.

    `codec`: how the files are compressed, if not as the session says. `outlive`: the table stays when the innermost
    `passing` step ends.
    """
    path = f"{shared_folder(df.sparkSession)}/quoteflow/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer = writer.option("compression", codec) if codec else writer
    steps = _PASSING.get()[:-1] if outlive else _PASSING.get()
    if steps:
        steps[-1].append((df.sparkSession, path))
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
