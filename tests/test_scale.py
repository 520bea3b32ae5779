"""Hot keys, numbering without one big sort, plans, and where intermediate tables go."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quoteflow.operators import cells, common, extraction, quotes, records
from quoteflow.plans.base import Inputs
from quoteflow.plans.registry import all_queries
from quoteflow.sources import files
from quoteflow.sources.store import shared_folder, stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows under one key."""
    return spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("key"), (F.col("id") * 7 % 9000).alias("ord")
    )


def test_numbering_a_hot_group_in_stretches(hot):
    plain = hot.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("ord")))
    mine = common.number_rows(hot, ["key"], "ord", "n", stretch=100)
    assert plain.select("key", "ord", F.col("n").cast("long")).exceptAll(mine.select("key", "ord", "n")).count() == 0


def test_numbering_a_whole_table(hot):
    mine = common.number_all(hot, ["ord"], "n")
    assert mine.where("n <> ord + 1").count() == 0 and mine.count() == 9000


def test_running_sums_in_stretches(hot):
    upto = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.withColumn("s", F.sum("ord").over(upto))
    mine = common.running_sum(hot, ["key"], "ord", "ord", "s", stretch=64)
    assert plain.select("key", "ord", "s").exceptAll(mine.select("key", "ord", "s")).count() == 0


def test_first_and_last_win(hot):
    tagged = hot.withColumn("tag", F.col("ord") * 2)
    assert common.first_wins(tagged, ["key"], ["ord"]).where("key = 0").first().tag == tagged.where("key = 0").agg(F.min("tag")).first()[0]
    assert common.last_wins(tagged, ["key"], ["ord"]).where("key = 0").first().tag == tagged.where("key = 0").agg(F.max("tag")).first()[0]


def test_a_long_grid_crosses_stretches(spark):
    """One grid of 1500 rows: headings at 0 and 700, the block between them ending where it should."""
    rows = []
    for row in range(1500):
        if row in (0, 700):
            rows += [(1, row, 0, "Item"), (1, row, 1, "Qty")]
        elif row not in (699, 698):
            rows += [(1, row, 0, f"thing {row}"), (1, row, 1, str(row))]
    rows.append((1, 698, 0, "TOTAL"))
    grid = spark.createDataFrame(rows, "grid_id long, row_no long, col_no int, value string")
    found = [(r.header_row, r.last_data_row) for r in cells.find_blocks(grid).orderBy("header_row").collect()]
    assert found == [(0, 697), (700, 1499)]
    profile = cells.profile_columns(grid, cells.find_blocks(grid)).where("col_no = 1").orderBy("header_row").collect()
    assert [(p.filled, p.numeric, p.distinct) for p in profile] == [(697, 697, 697), (799, 799, 799)]


def test_money_rounds_half_up(spark):
    lines = spark.createDataFrame([(1, 1, "0.125", "1"), (1, 2, "2.00", "2 coil"), (1, 3, None, "3")], "rfq_id long, line_index long, p string, quantity string")
    priced = lines.withColumn("unit_price", F.col("p").cast("decimal(12,3)"))
    totals = [r.total for r in quotes.line_totals(priced).orderBy("line_index").collect()]
    assert str(totals[0]) == "0.13" and totals[1] is None and totals[2] is None


def test_an_empty_copy_does_not_replace_the_list(spark, tmp_path):
    items = spark.createDataFrame([(1, "A")], "position long, code string")
    files.publish_snapshot(items, str(tmp_path)).collect()
    assert files.publish_snapshot(items.where("false"), str(tmp_path)).count() == 0
    assert files.current_snapshot(spark, str(tmp_path)).count() == 1


def test_journal_lines_without_type_are_decisions(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"decision_id": 1}\n\n{"decision_id": 1, "type": "delivery"}\n')
    out = files.read_journal(spark, str(tmp_path), "decision_id long, type string").collect()
    assert sorted(r.type for r in out) == ["decision", "delivery"]


def test_stored_tables_go_to_the_named_folder(spark):
    folder = shared_folder(spark)
    assert all(folder in name for name in stored(spark.range(3).toDF("a"), "probe").inputFiles())


@pytest.mark.parametrize("name", ["line_matches", "find_blocks", "merge_sources", "resolve_region", "quotation_totals", "per_class"])
def test_plans_stay_in_the_jvm_without_all_pairs(spark, name):
    query = next(one for one in all_queries() if one.name == name)
    plan = query.run(Inputs(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    query = next(one for one in all_queries() if one.name == "quotation_totals")
    plan = query.run(Inputs(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "rfq_lines" in line and "ReadSchema" in line]
    assert scans and all("description" not in line.split("ReadSchema")[1] for line in scans)


def test_a_far_page_reads_its_own_range(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("record_id"), F.lit(True).alias("is_rfq"), F.timestamp_seconds(F.col("id") * 7919 % 5000).alias("received_at"),
        F.lit("c").alias("customer"), F.array(F.lit("x")).alias("labels"),
    )
    directory = quotes.page_directory(rows, range_rows=500)
    wanted = [r.record_id for r in rows.orderBy(F.desc("received_at"), F.desc("record_id")).collect()]
    for page in (1, 40, 100, 200):
        shown = quotes.read_page(directory, page, 25)
        assert [r.record_id for r in shown.collect()] == wanted[(page - 1) * 25 : page * 25]
        plan = shown._jdf.queryExecution().executedPlan().toString()
        kept = plan.split("PartitionFilters: ")[1].split("]")[0]
        assert "range_no" in kept
        read = {r[0] for r in directory.rows.where(F.col("record_id").isin([r.record_id for r in shown.collect()])).select("range_no").collect()}
        assert len(read) <= 2
    assert quotes.read_page(directory, 201, 25).collect() == []
    assert quotes.read_page(quotes.page_directory(rows.where("false")), 1).collect() == []


def test_every_page_of_a_record_has_its_email(spark):
    emails = spark.createDataFrame([(1, "a"), (2, "b")], "email_id long, subject string")
    lines = spark.range(1, 1502).select(F.lit(1).cast("long").alias("email_id"), F.col("id").alias("line_index"), F.lit("x").alias("description"))
    files = spark.range(1, 2502).select(F.lit(1).cast("long").alias("email_id"), F.col("id").alias("ord"), F.lit("f").alias("filename"))
    candidates = spark.createDataFrame([(1, 1501, 1, "c", 5)], "email_id long, line_index long, rank int, item_code string, confidence int")
    inquiries = spark.createDataFrame([(2, 1, "s"), (3, 1, "unknown")], "email_id long, ord long, supplier string")
    found = records.assemble_records(emails, lines, candidates, files, inquiries).orderBy("email_id", "page_no").collect()
    assert [(r.email_id, r.subject, r.page_no, len(r.lines or []), len(r.files or []), len(r.inquiries or [])) for r in found] == [
        (1, "a", 0, 1000, 1000, 0), (1, "a", 1, 501, 1000, 0), (1, "a", 2, 0, 501, 0), (2, "b", 0, 0, 0, 1),
    ]
    assert found[1].lines[500].candidates[0].item_code == "c"


def test_a_form_may_have_no_end(spark):
    items = spark.range(1, 5001).select(
        F.lit(1).alias("rfq_id"), F.col("id").alias("sr_no"), F.lit("c").alias("customer_item_code"), F.lit("2").alias("quantity"),
        F.lit("d").alias("description"), F.lit("pc").alias("uom"),
    )
    header = spark.createDataFrame([], "rfq_id int, field string, text string, day date")
    assert extraction.form_cells(header, items).count() == 4977 * 5 and extraction.form_warnings(items).count() == 1
    assert extraction.form_cells(header, items, last_row=None).count() == 25_000


def test_a_directory_of_a_large_table_has_no_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(quotes, "MOST_RANGES", 8, raising=False)
    rows = spark.range(2000).select(
        F.col("id").alias("record_id"), F.lit(True).alias("is_rfq"), F.timestamp_seconds(F.col("id") * 7919 % 2000).alias("received_at"),
        F.lit("c").alias("customer"), F.array(F.lit("x")).alias("labels"),
    )
    directory = quotes.page_directory(rows, range_rows=20)
    assert directory.ranges.count() <= 8 and directory.rows.count() == 2000
    wanted = [r.record_id for r in rows.orderBy(F.desc("received_at"), F.desc("record_id")).collect()]
    for page in (1, 33, 80):
        assert [r.record_id for r in quotes.read_page(directory, page, 25).collect()] == wanted[(page - 1) * 25 : page * 25]
