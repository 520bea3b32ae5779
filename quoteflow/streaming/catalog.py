"""Lines looked up in whatever copy of the product list is current when they arrive."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quoteflow.operators.catalog import catalog_items, code_index, lookup_code
from quoteflow.sources.files import copy_fault


class Copies:
    """The copies of a list that have been looked at: each is checked and indexed once, when it is first taken up."""

    def __init__(self, folder: str):
        self.folder = folder
        self.faults: dict[str, str] = {}
        self.indexes: dict[str, tuple[str, int]] = {}

    def fault(self, spark: SparkSession, path: str) -> str:
        if path not in self.faults:
            self.faults[path] = copy_fault(spark, path)
        return self.faults[path]

    def current(self, spark: SparkSession) -> tuple[DataFrame, int]:
        """The code index of the newest copy that is as it was written, and how many items it holds.

        A copy gone wrong leaves the one before it in use.
        """
        notes = spark.read.parquet(f"{self.folder}/notes").orderBy(F.desc("taken_at"), F.desc("path")).select("path", "items")
        for note in notes.toLocalIterator():
            path = note["path"]
            if self.fault(spark, path):
                continue
            if path not in self.indexes:
                index = f"{path}.index-{uuid.uuid4().hex}"
                code_index(catalog_items(spark.read.parquet(path))).write.parquet(index)
                self.indexes[path] = index, note["items"]
            index, items = self.indexes[path]
            return spark.read.parquet(index), items
        raise ValueError(f"no copy under {self.folder} can be used")


def lookup_stream(lines: DataFrame, snapshots: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Each batch of lines against the copy current at its start, marked with the number of that copy's items."""
    copies = Copies(snapshots)

    def look_up(batch: DataFrame, batch_id: int) -> None:
        index, items = copies.current(batch.sparkSession)
        found = lookup_code(batch, index).withColumn("catalog_items", F.lit(items).cast("long"))
        found.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return lines.writeStream.foreachBatch(look_up).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
