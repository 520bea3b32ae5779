"""Change notifications as they arrive, and the change feed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def accept_notifications(notifications: DataFrame, client_state: str, remember: str = "1 day") -> DataFrame:
    """Trusted, identifiable notifications, each message id once.

    `notifications` carries `client_state`, `message_id`, `received_at`. A repeat is dropped within `remember` of the
    first one's event time: a bound in time, so that state stays small however many ids there are.
    """
    trusted = notifications.where((F.col("client_state") == client_state) & F.col("message_id").isNotNull())
    return trusted.withWatermark("received_at", remember).dropDuplicatesWithinWatermark(["message_id"])


def changed_records(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Per micro-batch the records something happened to and when it last did, without saying what.

    `changes` carries `record_id` and `changed_at`. A batch that is run again writes the same files again.
    """

    def announce(batch: DataFrame, batch_id: int) -> None:
        changed = batch.groupBy("record_id").agg(F.max("changed_at").alias("changed_at"))
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return changes.writeStream.foreachBatch(announce).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
