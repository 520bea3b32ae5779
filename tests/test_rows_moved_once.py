"""How often whole rows are moved to number them and to tell which are the same."""

import re

import pytest
from pyspark.sql import functions as F

from quoteflow.operators import common, extraction


@pytest.fixture
def exchanges(spark):
    """Columns that each shuffle of a plan sends, without broadcasts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def listed(df):
        plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return [one.split("\n")[1] for one in re.split(r"\n\(\d+\) ", plan) if one.startswith("Exchange")]

    yield listed
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(spark):
    return spark.range(40).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("rfq_id"), (F.col("id") % 2).alias("file_ord"), F.col("id").alias("ord"),
        F.concat(F.lit("  Thing "), F.col("id") % 5).alias("description"), F.lit(None).cast("string").alias("customer_item_code"),
        F.lit("2").alias("quantity"), F.concat(F.lit("f"), F.col("id") % 2, F.lit("#row")).alias("source"),
    )


def test_rows_are_moved_once_to_be_numbered(spark, exchanges):
    numbered = common.number_rows(rows(spark), ["rfq_id"], "ord", "n", stretch=8)
    assert sum("description" in one for one in exchanges(numbered)) == 1
    without = [r.n for r in numbered.where("rfq_id is null").orderBy("ord").collect()]
    assert without == list(range(1, 7)) and numbered.count() == 40


def test_rows_are_moved_once_to_be_told_apart(spark, exchanges):
    merged = extraction.merge_sources(rows(spark))
    found = [(r.rfq_id, r.sr_no, r.ord) for r in merged.orderBy("rfq_id", "sr_no").collect()]
    plain = {}
    for r in rows(spark).where("rfq_id is not null").collect():
        plain.setdefault((r.rfq_id, r.description), []).append((r.file_ord, r.ord))
    kept = sorted((key[0], o) for key, seen in plain.items() for f, o in seen if f == min(seen)[0])
    wanted = [(rfq, [one for one in kept if one[0] == rfq].index((rfq, o)) + 1, o) for rfq, o in kept]
    assert found == wanted
    sent = exchanges(extraction.quantity_conflicts(merged))
    assert not any("id_description" in one for one in sent)


def test_stitched_rows_are_moved_once_more(spark, exchanges):
    items = rows(spark).where("rfq_id is not null").select(
        F.col("rfq_id").alias("doc_id"), F.col("file_ord").alias("part_no"), "ord", "description", "customer_item_code", "quantity",
        F.when(F.col("ord") % 2 == 0, F.lit(" p0 ")).otherwise("p0").alias("page"),
    )
    labels = spark.createDataFrame([(one, part, f"p{part}") for one in range(3) for part in (0, 1)], "doc_id long, part_no long, label string")
    out = extraction.stitch_parts(items, labels)
    assert sum("description" in one for one in exchanges(out)) == 1
    assert {(r.part_no, r.source) for r in out.collect()} == {(0, "p0"), (1, "p1")}
