"""Column profiles of short blocks, made where the cells meet them, beside those of blocks over many stretches of rows."""

from quoteflow.operators import cells


def sheet(grid, rows, start=0):
    head = [(grid, start, 0, "item code"), (grid, start, 1, "qty")]
    body = [(grid, start + 1 + i, c, f"v{i % 7}" if c == 0 else str(i % 3)) for i in range(rows) for c in (0, 1) if c == 0 or i % 2 == 0]
    return head + body + [(grid, start + rows + 1, c, "1") for c in (0, 1)]


def expected(rows):
    first = [f"v{i % 7}" for i in range(rows)] + ["1"]
    second = [str(i % 3) for i in range(0, rows, 2)] + ["1"]
    told = []
    for letter, header, values in (("A", "item code", first), ("B", "qty", second)):
        different = list(dict.fromkeys(values))
        numeric = sum(one.isdigit() for one in values)
        told.append((letter, header, rows + 1, len(values), numeric, max(map(len, values)), len(different), ", ".join(different[:5])))
    return told


def profiles(spark, rows):
    df = spark.createDataFrame(rows, "grid_id long, row_no long, col_no int, value string")
    found = cells.profile_columns(df, cells.find_blocks(df))
    return found.select("grid_id", "letter", "header", "total", "filled", "numeric", "longest", "distinct", "samples")


def test_short_and_long_blocks_say_the_same_kind_of_thing(spark):
    # The last sheet is short, but lies over the end of a stretch.
    found = profiles(spark, sheet(1, 9) + sheet(2, 900) + sheet(3, 9, start=250)).orderBy("grid_id", "letter").collect()
    wanted = [(grid, *one) for grid, rows in ((1, 9), (2, 900), (3, 9)) for one in expected(rows)]
    assert [tuple(row) for row in found] == wanted


def test_a_heading_given_twice_is_told_as_often_as_before(spark):
    found = profiles(spark, sheet(1, 9) + [(1, 0, 1, "quantity")]).groupBy("header").count().collect()
    assert sorted((row["header"], row["count"]) for row in found) == [("item code", 1), ("qty", 2), ("quantity", 2)]


def test_cells_are_moved_once(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(sheet(1, 9), "grid_id long, row_no long, col_no int, value string")
    found = cells.profile_columns(df, cells.find_blocks(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(grid_id") - plan.count("(stretch") <= 3 and "SortMergeJoin" not in plan.split("Scan parquet")[0]
    assert found.where(F.col("filled") > 0).count() == 2
