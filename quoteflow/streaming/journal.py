"""The journal folded as its lines arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quoteflow.operators.records import last_line, stamped_labels


def fold_journal_stream(lines: DataFrame, earned: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep every decision with its last extraction, its last delivery and its labels.

    The three kinds of line are one streaming aggregate by decision, in update mode: Spark's state store holds the last
    lines by `ord`, so lines may come late, before their decision, or twice. Each batch writes only the decisions it
    touched. `lines` and `earned` have the columns that `fold_journal` takes.
    """
    kinds = lines.withColumn("type", F.coalesce("type", F.lit("decision")))
    folded = kinds.groupBy("decision_id").agg(
        last_line("extraction", "value").alias("extraction"),
        last_line("delivery", "value", "labels").alias("delivery"),
        F.collect_set(F.when(F.col("type") == "decision", F.struct("ord", "value"))).alias("decisions"),
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        records = batch.select("*", F.inline("decisions")).join(earned, "decision_id", "left").select(
            "decision_id", "ord", "value", F.col("extraction.value").alias("extraction_value"),
            F.col("delivery.value").alias("delivery_value"),
            stamped_labels(F.col("delivery.labels"), F.col("earned")).alias("labels"),
        )
        records.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        folded.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every decision as the last batch that touched it left it."""
    written = spark.read.parquet(folder)
    rest = [name for name in written.columns if name not in ("decision_id", "ord", "batch")]
    newest = F.max_by(F.struct(*rest), F.col("batch"))
    return written.groupBy("decision_id", "ord").agg(newest.alias("r")).select("decision_id", "ord", "r.*")
