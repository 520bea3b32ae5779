"""Rows of grids as words of bits: wide rows, places given twice, and nothing that has to be sorted."""

from quoteflow.operators import cells

SCHEMA = "grid_id long, row_no long, col_no int, value string"


def grid(spark, wide=0, twice=False):
    """Heading in row 1, three data rows of which the last fills one headed column."""
    at = [0, 1, wide + 2] if not wide else [wide, wide + 1, wide + 2]
    rows = [(7, 1, c, w) for c, w in zip(at, ("item code", "description", "qty"))]
    rows += [(7, r, c, f"{r}.{c}") for r in (2, 3) for c in at] + [(7, 4, at[0], "note"), (7, 0, 0, "title")]
    return spark.createDataFrame(rows + ([(7, 4, at[0], "again")] if twice else []), SCHEMA)


def found(df):
    return [tuple(row) for row in cells.find_blocks(df).collect()]


def test_rows_are_numbers_added_up_in_place(spark):
    rows = cells.grid_rows(grid(spark))
    assert {kind for _, kind in rows.dtypes} <= {"bigint", "int"}
    headers = cells._headers(rows)
    plan = cells.blocks_under(rows, headers, headers)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_blocks_of_wide_rows(spark):
    assert found(grid(spark)) == [(7, 1, 2, 3, 2, [0, 1, 2])]
    # Columns 62 to 64 stand in two words.
    assert found(grid(spark, wide=62)) == [(7, 1, 2, 3, 2, [62, 63, 64])]
    assert found(grid(spark, wide=16_380)) == [(7, 1, 2, 3, 2, [16_380, 16_381, 16_382])]


def test_a_place_given_twice_counts_twice(spark):
    assert found(grid(spark, twice=True)) == [(7, 1, 2, 4, 3, [0, 1, 2])]
    rows = cells.grid_rows(grid(spark, twice=True)).where("row_no = 4").orderBy("layer").select("layer", "filled").collect()
    assert [tuple(row) for row in rows] == [(0, 1), (1, 1)]


def test_headings_are_told_by_their_first_signs_first(spark):
    said = ["Code", " # q'TY", "U / M", "u/m", "S/N.", "\tno\t.", "c o d e", "'code", "1 code", "qty1", "Item", "pcs", "", "ﬁ", "Kode", "*(Ref)*"]
    df = spark.createDataFrame([(value,) for value in [*said, *cells.HEADER_WORDS, None]], "value string")
    plain = cells.strip(cells.F.regexp_replace(cells.F.lower(cells.strip("value")), cells.NOT_HEADER_SIGN, "")).isin(cells.HEADER_WORDS)
    rows = df.select("value", cells.header_word(cells.F.col("value")).alias("told"), plain.alias("plain"), cells.F.lower("value").rlike(cells.HEADER_START).alias("start")).collect()
    assert [row["told"] for row in rows] == [row["plain"] for row in rows]
    assert not any(row["start"] for row in rows if row["value"] in ("pcs", "1 code", "'code", ""))


def test_only_cells_at_row_numbers_of_headings_are_moved(spark, monkeypatch):
    moved = []
    plain = cells.grid_rows
    monkeypatch.setattr(cells, "grid_rows", lambda df: moved.append(df) or plain(df))
    df = grid(spark)
    assert [tuple(row) for row in cells.table_columns(df, cells.header_rows(df)).collect()] == [(7, 1, [0, 1, 2])]
    # The cells are read past the few row numbers of headings before they are joined with the headings.
    plan = moved[0]._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join LeftSemi") == 2


def test_rows_at_hand_are_not_made_again(spark, monkeypatch):
    df = spark.createDataFrame([(7, r, c, f"{r}.{c}") for r in range(3) for c in range(2)], SCHEMA)
    rows = cells.grid_rows(df)
    monkeypatch.setattr(cells, "grid_rows", None)
    found = cells.fallback_blocks(df, cells.find_blocks(df, rows), rows).collect()
    assert [tuple(row) for row in found] == [(7, 0, 1, 2, 2, [0, 1])]
