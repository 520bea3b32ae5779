"""The streaming jobs run over the test tables until nothing is left, beside what a batch gives (survey 2.I)."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.plans.base import Inputs, Query
from quoteflow.plans.matching import CODES, CODED, codes_of
from quoteflow.plans.quoting import (
    ASKED_BEFORE, CONFIRMED, COURSE, EXISTING, FOLDED, STEPPED, earned_labels, journal_lines, labelled, stepped,
)
from quoteflow.sources.files import publish_snapshot
from quoteflow.sources.store import shared_folder
from quoteflow.streaming import actions, catalog, journal, notifications

FILES = 3


def _place(t: Inputs, label: str) -> str:
    return f"{shared_folder(t.spark)}/quoteflow/{label}-{uuid.uuid4().hex}"


def _arriving(t: Inputs, df: DataFrame, order: str, label: str) -> DataFrame:
    """A table as a stream of a few files, in the order of a column, one file to a batch."""
    folder = _place(t, label)
    ranged = df.repartitionByRange(FILES, order)
    placed = ranged.withColumn("_part", F.spark_partition_id())
    placed.write.parquet(f"{folder}/all")
    # Files are taken by modification time, so the parts are written one after the other.
    for part in range(FILES):
        one = t.spark.read.schema(placed.schema).parquet(f"{folder}/all").where(F.col("_part") == part)
        one.drop("_part").coalesce(1).write.mode("append").parquet(f"{folder}/stream")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/stream")


def accepted(t: Inputs) -> DataFrame:
    """Events as notifications about users, most of them repeats."""
    sent = t.events.select(
        F.when(F.col("event_type") == "error", "other").otherwise("ours").alias("client_state"),
        F.when(F.col("event_id") % 50 != 0, F.concat_ws("-", "user_id", "event_type")).alias("message_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
        "event_id",
    )
    stream = _arriving(t, sent, "event_id", "notifications")
    out = _place(t, "accepted")
    kept = notifications.accept_notifications(stream, "ours", remember="400 days").select("message_id")
    query = kept.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return t.spark.read.parquet(out)


def changed(t: Inputs) -> DataFrame:
    touched = t.events.select(F.col("user_id").alias("record_id"), F.col("ts").alias("changed_at"), "event_id")
    out = _place(t, "changes")
    notifications.changed_records(_arriving(t, touched, "event_id", "touched"), out, f"{out}-log").awaitTermination()
    told = t.spark.read.parquet(out)
    return told.groupBy("record_id").agg(F.max("changed_at").alias("changed_at"))


def folded(t: Inputs) -> DataFrame:
    # Out of order, and one line in ten twice.
    lines = journal_lines(t)
    shuffled = lines.unionByName(lines.where("ord % 10 = 0")).withColumn("arrives", F.col("ord") * 7919 % 1000)
    stream = _arriving(t, shuffled, "arrives", "journal")
    out = _place(t, "records")
    journal.fold_journal_stream(stream, earned_labels(t), out, f"{out}-log").awaitTermination()
    return labelled(journal.current_records(t.spark, out))


def looked_up(t: Inputs) -> DataFrame:
    snapshots = _place(t, "snapshots")
    publish_snapshot(t.catalog_rows.where("position < 0"), snapshots).count()
    publish_snapshot(t.catalog_rows, snapshots).count()
    publish_snapshot(t.catalog_rows.withColumn("code", F.lit(" ")), snapshots).count()
    lines = t.rfq_lines.select("rfq_id", "line_index", "customer_code")
    out = _place(t, "looked-up")
    catalog.lookup_stream(_arriving(t, lines, "rfq_id", "lines"), snapshots, out, f"{out}-log").awaitTermination()
    return t.spark.read.parquet(out).select("rfq_id", "line_index", "customer_code", "found_code", "catalog_items")


def actions_of(t: Inputs) -> DataFrame:
    """All actions as one table, letters and prices inside their action."""
    keys = ["rfq_id", "ord"]
    lines = stepped(t, "letter_lines").groupBy(*keys, "supplier").agg(F.sort_array(F.collect_set("line_index")).alias("lines"))
    letters = stepped(t, "letters").join(lines, [*keys, "supplier"], "left").groupBy(*keys).agg(
        F.collect_list(F.struct("supplier", F.coalesce("lines", F.array().cast("array<bigint>")).alias("lines"))).alias("letters")
    )
    prices = stepped(t, "prices").groupBy(*keys).agg(
        F.collect_list(F.struct("line_index", F.col("unit_price").cast("decimal(14,2)").alias("unit_price"))).alias("prices")
    )
    confirmations = stepped(t, "confirmations").withColumn("acted_at", F.col("acted_at").cast("timestamp_ntz"))
    offered = stepped(t, "offers").withColumn("acted_at", F.col("acted_at").cast("timestamp_ntz"))
    approvals = stepped(t, "approvals").join(prices, keys, "left").withColumn("acted_at", F.col("approved_at").cast("timestamp_ntz"))
    parts = [
        (actions.INQUIRY, letters.join(confirmations.select("rfq_id", (F.col("ord") - 3).alias("ord"), "acted_at"), keys)),
        (actions.OFFER, offered),
        (actions.APPROVAL, approvals.withColumn("prices", F.coalesce("prices", F.array().cast(prices.schema["prices"].dataType)))),
        (actions.CONFIRMATION, confirmations),
    ]
    kinds = t.spark.createDataFrame([], actions.ACTIONS).schema
    shown = [
        part.withColumn("kind", F.lit(kind)).select(
            *[(F.col(f.name) if f.name in part.columns or f.name == "kind" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]
        )
        for kind, part in parts
    ]
    return reduce(DataFrame.unionByName, shown)


def acted(t: Inputs) -> DataFrame:
    out = _place(t, "actions")
    rfqs = t.orders.select(F.col("o_orderkey").alias("rfq_id"))
    stream = _arriving(t, actions_of(t), "ord", "events")
    actions.actions_stream(stream, t.rfq_lines, rfqs, codes_of(t), t.sql(EXISTING), t.sql(ASKED_BEFORE), out, f"{out}-log").awaitTermination()
    read = t.spark.read.parquet(out)
    return read.select(
        "kind", "rfq_id", "line_index", "ord", F.col("status").cast("long").alias("status"), "stored_code", "supplier",
        "unit_price", "margin_stock", "offer_unit_price", "offer_received_at",
    )


QUERIES = [
    Query("I1", "accept_notifications", accepted,
          "SELECT DISTINCT CAST(user_id AS VARCHAR) || '-' || event_type AS message_id FROM events WHERE event_type <> 'error' AND event_id % 50 <> 0"),
    Query("I2", "fold_journal_stream", folded, FOLDED),
    Query("I3", "changed_records", changed, "SELECT user_id AS record_id, max(ts) AS changed_at FROM events GROUP BY user_id"),
    Query("I4", "refresh_catalog", looked_up,
          f"WITH {CODES},\n{CODED} SELECT rfq_id, line_index, customer_code, found_code, (SELECT count(*) FROM catalog_rows) AS catalog_items FROM coded"),
    Query("I5", "workflow_actions_stream", acted,
          f"""WITH {CONFIRMED},\n{COURSE}, told AS (
SELECT 'inquiry' AS kind, rfq_id, NULL AS line_index, b.ord, CASE WHEN s.ord IS NOT NULL THEN 204 ELSE 409 END AS status, NULL AS stored_code, NULL AS supplier, NULL AS unit_price, NULL AS margin_stock, NULL AS offer_unit_price, NULL AS offer_received_at FROM batches b LEFT JOIN sound s USING (rfq_id, ord)
UNION ALL SELECT 'letter', rfq_id, line_index, ord, NULL, NULL, supplier, NULL, NULL, NULL, NULL FROM sound JOIN ({STEPPED['letter_lines']}) x USING (rfq_id, ord)
UNION ALL SELECT 'offer', rfq_id, line_index, ord, status, NULL, NULL, NULL, NULL, NULL, NULL FROM offered
UNION ALL SELECT 'approval', rfq_id, NULL, a.ord, coalesce(a.refused, CASE WHEN t.ord = a.ord THEN 204 ELSE 409 END), NULL, NULL, NULL, a.margin_stock, NULL, NULL FROM approving a LEFT JOIN taken t USING (rfq_id)
UNION ALL SELECT 'frozen', rfq_id, line_index, ord, NULL, NULL, NULL, unit_price, margin_stock, offer_unit_price, offer_received_at FROM frozen
UNION ALL SELECT 'confirmation', rfq_id, line_index, ord * 4 + 3, status, CASE WHEN item_code IS NOT NULL THEN stored_code END, NULL, NULL, NULL, NULL, NULL FROM judged)
SELECT kind, rfq_id, CAST(line_index AS BIGINT) AS line_index, ord, CAST(status AS BIGINT) AS status, CAST(stored_code AS VARCHAR) AS stored_code, CAST(supplier AS VARCHAR) AS supplier, CAST(unit_price AS DECIMAL(14,2)) AS unit_price,
  CAST(margin_stock AS DOUBLE) AS margin_stock, CAST(offer_unit_price AS DECIMAL(14,2)) AS offer_unit_price, CAST(offer_received_at AS TIMESTAMP) AS offer_received_at FROM told"""),
]
