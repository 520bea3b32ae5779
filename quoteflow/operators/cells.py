"""Tables inside cell grids: heading rows, blocks, column profiles, mappings and the rows they give.

A grid is a long table `cells(grid_id, row_no, col_no, value)` of filled cells, rows and columns counted from zero.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions.values import let, strip
from quoteflow.functions.words import shortened
from quoteflow.operators.common import broadcast_if_small, number_rows, ordered_list
from quoteflow.sources.store import stored

# Fixed values.
HEADER_WORDS = [
    "code", "item", "items", "item code", "item no", "itemno",
    "impa", "issa", "part", "part no", "partno", "part number", "ref",
    "description", "desc", "item description", "material", "goods",
    "qty", "q'ty", "qnty", "quantity", "req qty", "required",
    "uom", "u/m", "unit", "units", "unit of measure", "measure", "item unit",
    "sr", "sr no", "sl", "sl no", "s/n", "no", "no.", "pos", "line",
    "remark", "remarks", "note", "notes", "maker", "brand",
]
NOT_HEADER_SIGN = "[^a-z0-9/' ]+"
# The first letter of a heading word, and one more sign that follows it in some word, after signs that do not count.
HEADER_START = "^[^a-z0-9/']*+(?:" + "|".join(
    first + "[^a-z0-9/' ]*+[" + "".join(sorted({word[1] for word in HEADER_WORDS if word[0] == first})) + "]"
    for first in sorted({word[0] for word in HEADER_WORDS})
) + ")"
NUMERIC = r"^\s*\d+([.,]\d+)?"
MIN_HEADER_HITS = 2
SAMPLES = 5
RARE_SHARE = 0.2
NUMBERS_SHARE = 0.9
SAMPLE_CHARS = 40
MIN_NUMERIC_SHARE = 0.9
MIN_DESCRIPTION_SHARE = 0.5
WHOLE_TABLE_ROWS = 40
PREFACE_ROWS = 25
PREFACE_COLUMNS = 8
PREFACE_CHARS = 60
MIN_CHARS_PER_PAGE = 50
MIN_CHARS_PER_IMAGE_PAGE = 400
MIN_IMAGE_PAGE_SHARE = 0.5
ITEM_FIELDS = ["sr_no", "customer_item_code", "description", "quantity", "uom"]

# Rows per stretch when cells are put under their heading: few headings meet few cells in one stretch.
ROW_STRETCH = 256
# Columns of one word of bits; a row as wide as a sheet is several words.
WORD = 64
BLOCK = ["grid_id", "header_row"]


def clean_cells(cells: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Typed cells as the reader would see them.

    `cells` carries `kind` (text, number, boolean, datetime, date) beside the value as text. Blank cells go, so blank
    rows at the end of a grid go with them. All rows and columns stay unless a limit is given; `rows_truncated` marks
    grids that have cells past one.
    """
    text = strip("value")
    shown = (
        F.when(F.col("kind") == "number", F.regexp_replace(text, r"\.0+$", ""))
        .when(F.col("kind") == "boolean", F.upper(text))
        .when(F.col("kind") == "datetime", F.left(F.replace(text, F.lit("T"), F.lit(" ")), F.lit(16)))
        .otherwise(text)
    )
    inside = F.lit(True)
    for name, limit in (("row_no", max_rows), ("col_no", max_columns)):
        inside = inside if limit is None else inside & (F.col(name) < limit)
    shown_cells = cells.withColumn("value", shown).drop("kind")
    if max_rows is None and max_columns is None:
        return shown_cells.where("value <> ''").withColumn("rows_truncated", F.lit(False))
    grids = cells.groupBy("grid_id").agg(F.bool_or(~inside).alias("rows_truncated"))
    return shown_cells.where(inside & F.expr("value <> ''")).join(grids, "grid_id")


def header_word(value: Column) -> Column:
    """Whether a cell says something headings say.

    Most cells begin with a sign that no heading begins with, which is sooner told than what is left without other signs.
    """
    lowered = F.lower(value)
    said = strip(F.regexp_replace(strip(lowered), NOT_HEADER_SIGN, "")).isin(HEADER_WORDS)
    return F.when(lowered.rlike(HEADER_START), said).otherwise(F.when(value.isNotNull(), F.lit(False)))


def grid_rows(cells: DataFrame) -> DataFrame:
    """(grid_id, row_no, word, layer, filled, known): which columns of a row are filled, and which say heading words.

    Each is a number of 64 bits for every 64 columns, so that cells are added up in place and no list of them is sorted.
    Layer n holds the cells of a place past the n-th, where a place is given more than once. Stored.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod(col_no, {WORD}) as int))")
    told = cells.select(
        "grid_id", "row_no", "col_no", F.expr(f"col_no div {WORD}").cast(cells.schema["col_no"].dataType).alias("word"),
        bit.alias("bit"), F.when(header_word(F.col("value")), bit).otherwise(F.lit(0)).cast("long").alias("known_bit"),
    )
    row = ["grid_id", "row_no", "word"]
    bits = [F.bit_or("bit").alias("filled"), F.bit_or("known_bit").alias("known")]
    first = stored(
        told.groupBy(*row).agg(*bits, F.count(F.lit(1)).alias("cells")).withColumn("layer", F.lit(0).cast("long")), "grid-rows"
    )
    repeated = first.where(F.col("cells") > F.bit_count("filled")).select(*row)
    first = first.drop("cells")
    if repeated.isEmpty():
        return first
    places = told.join(repeated, row, "left_semi").groupBy(*row, "col_no", "bit").agg(
        F.count(F.lit(1)).alias("times"), F.sum((F.col("known_bit") != 0).cast("long")).alias("known_times")
    )
    more = places.where("times > 1").withColumn("layer", F.explode(F.expr("sequence(1L, times - 1)"))).withColumn(
        "known_bit", F.when(F.col("layer") < F.col("known_times"), F.col("bit")).otherwise(F.lit(0)).cast("long")
    )
    return stored(first.unionByName(more.groupBy(*row, "layer").agg(*bits)), "grid-rows")


def header_rows(cells: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """(grid_id, header_row): rows of two heading words or more; with a limit, if the first stands above that row."""
    hits = (
        cells.where(header_word(F.col("value")))
        .groupBy("grid_id", F.col("row_no").alias("header_row"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    return _near_the_top(hits.where(F.col("hits") >= MIN_HEADER_HITS).select(*BLOCK), scan_rows)


def _near_the_top(hits: DataFrame, rows: int | None = None) -> DataFrame:
    """All headings, or where a limit is given those of grids whose first heading stands above it."""
    if rows is None:
        return hits
    first = hits.groupBy("grid_id").agg(F.min("header_row").alias("first_header"))
    return hits.join(first, "grid_id").where(F.col("first_header") < rows).drop("first_header")


def _headers(rows: DataFrame) -> DataFrame:
    """The heading rows of a table of grid rows."""
    hits = rows.where("known <> 0").groupBy("grid_id", F.col("row_no").alias("header_row")).agg(F.sum(F.bit_count("known")).alias("hits"))
    return _near_the_top(hits.where(F.col("hits") >= MIN_HEADER_HITS).select(*BLOCK))


def run_of_headings(filled: Column) -> Column:
    """The columns of the unbroken run of filled headings around the recognised ones; all filled ones without any."""
    islands = F.transform(
        filled, lambda c, i: F.struct(c["col_no"].alias("col_no"), c["known"].alias("known"), (c["col_no"] - i).alias("island"))
    )

    def inside(cells: Column) -> Column:
        known = F.transform(F.filter(cells, lambda c: c["known"]), lambda c: c["island"])
        within = F.filter(
            cells,
            lambda c: (F.size(known) == 0) | c["island"].between(F.array_min(known), F.array_max(known)),
        )
        return F.transform(within, lambda c: c["col_no"])

    return let(islands, inside)


def table_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(grid_id, header_row, columns): the unbroken run of headings around the recognised ones."""
    headers = stored(headers, "headers")
    # Headings stand at few row numbers as a rule: cells of other rows are left where they are.
    places = headers.select(F.col("header_row").alias("row_no")).distinct()
    near = broadcast_if_small(places)
    likely = cells if near is places else cells.join(near, "row_no", "left_semi")
    heading = likely.withColumnRenamed("row_no", "header_row").join(headers.hint("shuffle_hash"), BLOCK, "left_semi")
    return _columns(grid_rows(heading.withColumnRenamed("header_row", "row_no")), headers)


def _columns(rows: DataFrame, headers: DataFrame) -> DataFrame:
    named = rows.withColumnRenamed("row_no", "header_row").join(headers, BLOCK, "left_semi")
    cells = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("filled", i) == 1),
        lambda i: F.struct((F.col("word") * WORD + i).alias("col_no"), (F.getbit("known", i) == 1).alias("known")),
    )
    filled = F.array_sort(F.flatten(F.collect_list(cells)))
    return named.groupBy(*BLOCK).agg(filled.alias("filled")).select(*BLOCK, run_of_headings(F.col("filled")).alias("columns"))


def _words(columns: str) -> Column:
    """An array of columns as a map from word to bits."""
    bits = f"aggregate(filter({columns}, c -> c div {WORD} = w), 0L, (a, c) -> a | shiftleft(1L, cast(c % {WORD} as int)))"
    return F.expr(f"map_from_entries(transform(array_distinct(transform({columns}, c -> c div {WORD})), w -> struct(w, {bits})))")


def blocks_under(rows: DataFrame, named: DataFrame, recognised: DataFrame) -> DataFrame:
    """The block under each named heading row, ending before the next recognised one.

    `rows` is a table of `grid_rows`. Trailing rows empty in the headed columns are cut; if any row fills two columns,
    trailing rows filling fewer than two are cut as well. A heading with no rows under it gives no block.
    """
    heights = rows.groupBy("grid_id").agg((F.max("row_no") + 1).alias("height"))
    marks = named.withColumn("is_named", F.lit(True)).join(
        recognised.withColumn("is_known", F.lit(True)), BLOCK, "full"
    )
    after = Window.partitionBy("grid_id").orderBy("header_row").rowsBetween(1, Window.unboundedFollowing)
    next_known = F.first(F.when(F.col("is_known"), F.col("header_row")), ignorenulls=True).over(after)
    spans = (
        marks.withColumn("next_known", next_known)
        .where("is_named")
        .join(heights, "grid_id")
        .select(*BLOCK, F.coalesce("next_known", "height").alias("ends_before"))
    )
    headed = _columns(rows, named).join(spans, BLOCK)
    first_stretch = F.floor((F.col("header_row") + 1) / ROW_STRETCH)
    last_stretch = F.greatest(F.floor((F.col("ends_before") - 1) / ROW_STRETCH), first_stretch)
    stretches = headed.withColumn("words", _words("columns")).withColumn(
        "stretch", F.explode(F.sequence(first_stretch, last_stretch))
    )
    placed = rows.select("grid_id", "row_no", "word", "filled", F.floor(F.col("row_no") / ROW_STRETCH).alias("stretch"))
    # Headings are few beside rows: they are hashed, and the rows pass by unsorted.
    under = placed.join(stretches.hint("shuffle_hash"), ["grid_id", "stretch"]).where(
        (F.col("row_no") > F.col("header_row")) & (F.col("row_no") < F.col("ends_before"))
    )
    count = F.bit_count(F.col("filled").bitwiseAND(F.try_element_at("words", F.col("word").cast("long"))))
    # With the stretch among the keys the words of a row meet where they are.
    counts = (
        under.select(*BLOCK, "stretch", "row_no", "columns", count.alias("count"))
        .where("count > 0")
        .groupBy(*BLOCK, "stretch", "row_no", "columns")
        .agg(F.sum("count").alias("count"))
    )
    last = counts.groupBy(*BLOCK, "columns").agg(
        F.coalesce(F.max(F.when(F.col("count") >= 2, F.col("row_no"))), F.max("row_no")).alias("last_data_row")
    )
    return last.select(
        *BLOCK,
        (F.col("header_row") + 1).alias("first_data_row"),
        "last_data_row",
        (F.col("last_data_row") - F.col("header_row")).alias("height"),
        "columns",
    )


def find_blocks(cells: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The block under each recognised heading row; `rows` are the cells' `grid_rows`, if they are at hand."""
    rows = grid_rows(cells) if rows is None else rows
    headers = _headers(rows)
    return blocks_under(rows, headers, headers)


def fallback_blocks(cells: DataFrame, blocks: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """For grids of at least two by two without any block: the first row taken as heading.

    `rows` are the cells' `grid_rows`, if they are at hand.
    """
    rows = grid_rows(cells) if rows is None else rows
    shapes = rows.groupBy("grid_id").agg(
        F.max("row_no").alias("last_row"),
        F.max(F.col("word") * WORD + F.length(F.bin("filled")) - 1).alias("last_column"),
    )
    tabular = shapes.where("last_row >= 1 and last_column >= 1").join(blocks, "grid_id", "left_anti")
    named = tabular.select("grid_id", F.lit(0).cast("long").alias("header_row"))
    return blocks_under(rows, named, _headers(rows))


def named_blocks(cells: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks at heading rows an answer names, counted from one; rows outside the grid give none."""
    rows = grid_rows(cells)
    named = answers.select("grid_id", (F.col("header_row") - 1).cast("long").alias("header_row")).where(
        "header_row >= 0"
    ).distinct()
    return blocks_under(rows, named, _headers(rows))


def block_titles(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """(grid_id, header_row, title): the nearest filled row of the two above the heading."""
    above = blocks.select(
        *BLOCK, F.explode(F.array(F.col("header_row") - 1, F.col("header_row") - 2)).alias("row_no")
    )
    # Headings stand at few row numbers as a rule: cells of other rows are left where they are.
    places = above.select("row_no").distinct()
    near = broadcast_if_small(places)
    rows = (
        (cells if near is places else cells.join(near, "row_no", "left_semi"))
        .join(above.hint("shuffle_hash"), ["grid_id", "row_no"])
        .groupBy(*BLOCK, "row_no")
        .agg(F.array_join(ordered_list(F.col("value"), "col_no"), " ").alias("said"))
        .groupBy(*BLOCK)
        .agg(F.max_by("said", "row_no").alias("title"))
    )
    return blocks.select(*BLOCK).join(rows, BLOCK, "left").select(
        *BLOCK, F.coalesce("title", F.lit("")).alias("title")
    )


def _met_cells(cells: DataFrame, blocks: DataFrame, first_row: str) -> DataFrame:
    """Filled cells of the headed columns in the rows of each block from `first_row` on, with the block's columns."""
    spread = blocks.withColumn(
        "stretch",
        F.explode(F.sequence(F.floor(F.col(first_row) / ROW_STRETCH), F.floor(F.col("last_data_row") / ROW_STRETCH))),
    )
    placed = cells.withColumn("stretch", F.floor(F.col("row_no") / ROW_STRETCH))
    # Blocks are few beside cells: they are hashed, and the cells pass by unsorted.
    return placed.join(spread.hint("shuffle_hash"), ["grid_id", "stretch"]).where(
        F.col("row_no").between(F.col(first_row), F.col("last_data_row")) & F.array_contains("columns", F.col("col_no"))
    )


def block_cells(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Filled cells of the headed columns in the data rows of each block."""
    return _met_cells(cells, blocks, "first_data_row").select(*BLOCK, "row_no", "col_no", "value")


def column_letter(index: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA."""

    def letter(at: Column) -> Column:
        return F.char(F.lit(65) + at % 26)

    two = F.floor(index / 26) - 1
    three = F.floor(two / 26) - 1
    return (
        F.when(index < 26, letter(index))
        .when(index < 26 + 26 * 26, F.concat(letter(two), letter(index)))
        .otherwise(F.concat(letter(three), letter(two), letter(index)))
    )


def _column_values(met: DataFrame, keys: list[str]) -> DataFrame:
    """The different values of each column, in the heading row and in the data rows: how often, and where first."""
    return met.groupBy(*keys, "height", (F.col("row_no") > F.col("header_row")).alias("is_data"), "value").agg(
        F.count(F.lit(1)).alias("times"), F.min("row_no").alias("first_row")
    )


def _repeated_headings(values: DataFrame, given: Column) -> DataFrame:
    """A heading for each time it is there and each time its place is named; once, unless a place is given twice."""
    return values.where("not is_data").withColumn(
        "header", F.explode(F.array_repeat("value", (F.col("times") * given).cast("int")))
    )


def _described_in_place(values: DataFrame, keys: list[str]) -> DataFrame:
    """What `_described` gives, over columns of bounded height: one sort, and every number on the row of the heading."""
    column = Window.partitionBy(*keys)
    data, value = F.col("is_data"), F.col("value")
    ordered = values.withColumn("nth", F.row_number().over(column.orderBy("is_data", "first_row")) - 1)
    data_nth = F.col("nth") - F.col("different_headings")
    told = (
        ordered.withColumn("different_headings", F.sum((~data).cast("long")).over(column))
        .withColumn("given", F.sum(F.when(~data, F.col("times"))).over(column))
        .withColumn("filled", F.sum(F.when(data, F.col("times"))).over(column))
        .withColumn("numeric", F.sum(F.when(data, F.when(value.rlike(NUMERIC), F.col("times")).otherwise(0))).over(column))
        .withColumn("longest", F.max(F.when(data, F.length("value"))).over(column))
        .withColumn("distinct", F.sum(F.when(data, F.lit(1))).over(column))
        .withColumn("first_filled_row", F.min(F.when(data, F.col("first_row"))).over(column))
    )
    shown = shortened(value, SAMPLE_CHARS)
    samples = F.array_compact(F.array(*[F.max(F.when(data & (data_nth == n), shown)).over(column) for n in range(SAMPLES)]))
    return _repeated_headings(told.withColumn("samples", samples), F.col("given")).select(
        *keys, "height", "header", "filled", "numeric", "longest", "distinct", "first_filled_row", "samples"
    )


def _described(values: DataFrame, keys: list[str]) -> DataFrame:
    """Headings with the numbers and the first values of their columns, however high those are."""
    given = values.where("not is_data").groupBy(*keys).agg(F.sum("times").alias("given"))
    headings = _repeated_headings(values.join(given, keys), F.col("given")).select(*keys, "height", "header")
    values = values.where("is_data")
    numbers = values.groupBy(*keys).agg(
        F.sum("times").alias("filled"),
        F.sum(F.when(F.col("value").rlike(NUMERIC), F.col("times")).otherwise(0)).alias("numeric"),
        F.max(F.length("value")).alias("longest"),
        F.count(F.lit(1)).alias("distinct"),
        F.min("first_row").alias("first_filled_row"),
    )
    seen = Window.partitionBy(*keys).orderBy("first_row")
    # One column for each of the few samples, as a list would be sorted once more.
    nth = [F.max(F.when(F.col("nth") == n + 1, shortened(F.col("value"), SAMPLE_CHARS))).alias(f"s{n}") for n in range(SAMPLES)]
    samples = (
        values.withColumn("nth", F.row_number().over(seen))
        .where(F.col("nth") <= SAMPLES)
        .groupBy(*keys)
        .agg(*nth)
        .select(*keys, F.array_compact(F.array(*[f"s{n}" for n in range(SAMPLES)])).alias("samples"))
    )
    return headings.join(numbers, keys, "left").join(samples, keys, "left")


def profile_columns(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per headed column: how full, how numeric, how varied, and its first five values.

    A block that lies in one stretch of rows is described where its cells meet it. Values of longer ones are moved once
    more, so that no task holds a whole block.
    """
    column = [*BLOCK, "col_no"]
    near = F.floor(F.col("header_row") / ROW_STRETCH) == F.floor(F.col("last_data_row") / ROW_STRETCH)
    placed = ["stretch", *column]
    full = _described_in_place(_column_values(_met_cells(cells, blocks.where(near), "header_row"), placed), placed).drop("stretch")
    far = blocks.where(~near)
    if not far.isEmpty():
        values = stored(_column_values(_met_cells(cells, far, "header_row"), column), "values")
        full = full.unionByName(_described(values, column))
    filled = F.coalesce("filled", F.lit(0))
    share = filled / F.col("height")
    numeric_share = F.when(filled > 0, F.col("numeric") / filled).otherwise(0.0)
    return full.select(
        *column,
        column_letter(F.col("col_no")).alias("letter"),
        "header",
        F.col("height").alias("total"),
        filled.alias("filled"),
        F.coalesce("numeric", F.lit(0)).alias("numeric"),
        F.coalesce("longest", F.lit(0)).alias("longest"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "first_filled_row",
        share.alias("fill_share"),
        numeric_share.alias("numeric_share"),
        (filled == 0).alias("is_empty"),
        ((filled > 0) & (share <= RARE_SHARE)).alias("is_rare"),
        F.when(numeric_share > NUMBERS_SHARE, "numbers").otherwise("text").alias("kind"),
        F.coalesce(F.array_join("samples", ", "), F.lit("")).alias("samples"),
    )


def sample_rows(blocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(grid_id, header_row, row_no): rows worth showing of each block."""
    rows = F.col("height")
    last = F.lit(SAMPLES - 1)
    spread = F.concat(
        F.sequence(F.lit(0).cast("long"), last.cast("long")),
        F.sequence(F.floor(rows / 2), F.floor(rows / 2) + last),
        F.sequence(rows - SAMPLES, rows - 1),
    )
    places = F.when(rows <= 3 * SAMPLES, F.sequence(F.lit(0).cast("long"), rows - 1)).otherwise(spread)
    fixed = blocks.select(*BLOCK, F.explode(F.array_distinct(places)).alias("at")).select(
        *BLOCK, (F.col("header_row") + 1 + F.col("at")).alias("row_no")
    )
    rare = profiles.where("is_rare").where(F.col("total") > 3 * SAMPLES).select(
        *BLOCK, F.col("first_filled_row").alias("row_no")
    )
    return fixed.unionByName(rare).distinct()


def verify_mapping(profiles: DataFrame, answers: DataFrame) -> DataFrame:
    """(grid_id, header_row, problem): the first thing wrong with each block's column answers, '' when nothing is.

    `answers` carries `ord`, `letter` and `field` per block.
    """
    known = profiles.select(*BLOCK, "letter", "is_empty", "fill_share", "numeric_share", F.lit(True).alias("known"))
    joined = answers.join(known, [*BLOCK, "letter"], "left")

    def first_short(field: str, share: str, least: float) -> Column:
        short = (F.col("field") == field) & F.col("known") & (F.col(share) < least)
        return F.min(F.when(short, F.struct("ord", "letter", F.col(share).alias("share"))))

    def share_text(first: str, field: str, what: str, least: float) -> Column:
        text = F.format_string(
            "column %s was given to %s, but only %d%% of its values are %s (expected at least %d%%)",
            F.col(f"{first}.letter"), F.lit(field), F.bround(F.col(f"{first}.share") * 100, 0).cast("int"), F.lit(what),
            F.lit(round(least * 100)),
        )
        return F.when(F.col(first).isNotNull(), text)

    flags = joined.groupBy(*BLOCK).agg(
        (F.count(F.lit(1)) > F.size(F.collect_set("letter"))).alias("column_twice"),
        (F.count(F.lit(1)) > F.size(F.collect_set("field"))).alias("field_twice"),
        F.min_by("letter", F.when(F.col("known").isNull(), F.col("ord"))).alias("unknown"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("is_empty"), F.struct("ord", "letter")))), lambda e: e["letter"]
            ),
            ", ",
        ).alias("empty"),
        first_short("quantity", "numeric_share", MIN_NUMERIC_SHARE).alias("few_numbers"),
        first_short("description", "fill_share", MIN_DESCRIPTION_SHARE).alias("few_descriptions"),
        F.max(F.col("known").isNull()).alias("any_unknown"),
    )
    problem = (
        F.when(F.col("column_twice"), F.lit("the same column was given two fields"))
        .when(F.col("field_twice"), F.lit("the same field was taken from two columns"))
        .when(F.col("any_unknown"), F.format_string("column %s is not in this table", "unknown"))
        .when(F.col("empty") != "", F.format_string("column %s is empty in every row", "empty"))
        .otherwise(
            F.coalesce(
                share_text("few_numbers", "quantity", "numeric", MIN_NUMERIC_SHARE),
                share_text("few_descriptions", "description", "filled", MIN_DESCRIPTION_SHARE),
                F.lit(""),
            )
        )
    )
    return flags.select(*BLOCK, problem.alias("problem"))


def copy_rows(cells: DataFrame, blocks: DataFrame, answers: DataFrame, origins: DataFrame) -> DataFrame:
    """Requested lines, values moved unchanged, numbered through the blocks of a grid.

    `origins` carries the name of each grid. Rows with neither description nor code are no lines; where a quantity
    column was named, rows without quantity, code and unit are none either.
    """
    mapped = answers.where(F.col("field").isin(ITEM_FIELDS)).select(*BLOCK, "letter", "field")
    lettered = block_cells(cells, blocks).withColumn("letter", column_letter(F.col("col_no")))
    quantified = mapped.groupBy(*BLOCK).agg(F.max(F.col("field") == "quantity").alias("quantified"))
    picked = [F.max(F.when(F.col("field") == one, F.col("value"))).alias(one) for one in ITEM_FIELDS if one != "sr_no"]
    rows = lettered.join(mapped, [*BLOCK, "letter"]).groupBy(*BLOCK, "row_no").agg(*picked)
    named = F.col("description").isNotNull() | F.col("customer_item_code").isNotNull()
    counted = (
        ~F.col("quantified")
        | F.col("quantity").isNotNull()
        | F.col("customer_item_code").isNotNull()
        | F.col("uom").isNotNull()
    )
    lines = rows.join(quantified, BLOCK).where(named & counted).drop("quantified")
    numbered = number_rows(lines, ["grid_id"], "row_no", "sr_no")
    return numbered.join(origins, "grid_id").select(
        "grid_id",
        "sr_no",
        "description",
        "customer_item_code",
        "quantity",
        "uom",
        F.format_string("%s row %d", F.col("origin"), F.col("row_no") + 1).alias("source"),
    )


def unmapped_columns(profiles: DataFrame, answers: DataFrame) -> DataFrame:
    """Filled columns of answered blocks that no field takes, as `F (REMARKS)`."""
    answered = profiles.join(answers.select(*BLOCK).distinct(), BLOCK, "left_semi")
    left = answered.where("not is_empty").join(answers.select(*BLOCK, "letter"), [*BLOCK, "letter"], "left_anti")
    return left.select(*BLOCK, "col_no", F.format_string("%s (%s)", "letter", "header").alias("unmapped"))


def document_roles(documents: DataFrame, blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, role): what each document is good for; an unanswered one is unread, never assumed.

    `documents` carries `has_content`; `blocks` says which documents hold tables; `answers` carries `has_item_list`.
    """
    holding = blocks.select("doc_id").distinct().withColumn("has_blocks", F.lit(True))
    told = answers.select("doc_id", "has_item_list")
    joined = documents.join(holding, "doc_id", "left").join(told, "doc_id", "left")
    role = (
        F.when(~F.col("has_content"), "EMPTY")
        .when(F.col("has_item_list").isNull(), "UNREAD")
        .when(~F.col("has_item_list"), "SUPPORTING")
        .when(F.col("has_blocks"), "ITEM_GRID")
        .otherwise("ITEM_TEXT")
    )
    return joined.select("doc_id", role.alias("role"))


def preface_rows(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """(grid_id, row_no, said): the rows down to the first block's heading, at most 25 rows of 8 cells."""
    stops = blocks.groupBy("grid_id").agg((F.min("header_row") + 1).alias("stop"))
    shapes = cells.groupBy("grid_id").agg(
        (F.max("row_no") + 1).alias("height"), (F.max("col_no") + 1).alias("width")
    )
    shown = F.least(F.coalesce("stop", F.lit(PREFACE_ROWS)), F.lit(PREFACE_ROWS), "height")
    rows = shapes.join(stops, "grid_id", "left").select(
        "grid_id", "width", F.explode(F.sequence(F.lit(0).cast("long"), shown - 1)).alias("row_no")
    )
    near = cells.where((F.col("row_no") < PREFACE_ROWS) & (F.col("col_no") < PREFACE_COLUMNS)).withColumn(
        "value", shortened(F.col("value"), PREFACE_CHARS)
    )
    said = (
        rows.join(near, ["grid_id", "row_no"], "left")
        .groupBy("grid_id", "row_no", "width")
        .agg(F.map_from_entries(F.collect_list(F.when(F.col("col_no").isNotNull(), F.struct("col_no", "value")))).alias("row"))
    )
    places = F.sequence(F.lit(0), F.least("width", F.lit(PREFACE_COLUMNS)).cast("int") - 1)
    texts = F.transform(places, lambda c: F.coalesce(F.try_element_at("row", c), F.lit("")))
    return said.select("grid_id", "row_no", F.array_join(texts, " | ").alias("said"))


def picture_documents(pages: DataFrame) -> DataFrame:
    """Documents whose content is in their pictures: hardly any text, or little text on mostly image pages."""
    per_page = F.avg(F.length("text"))
    image_share = F.avg(F.col("has_image").cast("int"))
    pictures = (per_page < MIN_CHARS_PER_PAGE) | (
        (image_share >= MIN_IMAGE_PAGE_SHARE) & (per_page < MIN_CHARS_PER_IMAGE_PAGE)
    )
    return pages.groupBy("doc_id").agg(
        F.round(per_page, 4).alias("chars_per_page"), pictures.alias("is_pictures")
    )


def table_digest(
    cells: DataFrame, blocks: DataFrame, profiles: DataFrame, whole_rows: int = WHOLE_TABLE_ROWS
) -> DataFrame:
    """(grid_id, header_row, part, line_no, line): small tables row by row, larger ones as profiles and samples."""
    whole = blocks.where(F.col("height") <= whole_rows).select(
        *BLOCK, F.explode(F.sequence("first_data_row", "last_data_row")).alias("row_no")
    )
    large = blocks.where(F.col("height") > whole_rows)
    sampled = sample_rows(large, profiles.join(large.select(*BLOCK), BLOCK, "left_semi"))
    wanted = whole.unionByName(sampled)
    filled = block_cells(cells, blocks).join(wanted, [*BLOCK, "row_no"])
    joined = ordered_list(F.concat_ws(" ", column_letter(F.col("col_no")), shortened(F.col("value"), 48)), "col_no")
    rows = filled.groupBy(*BLOCK, "row_no").agg(F.array_join(joined, " | ").alias("line"))
    lines = wanted.join(rows, [*BLOCK, "row_no"], "left").select(
        *BLOCK, F.lit("rows").alias("part"), F.col("row_no").alias("line_no"), F.coalesce("line", F.lit("")).alias("line")
    )
    described = F.when(F.col("is_empty"), F.format_string("%s %s empty", "letter", "header")).otherwise(
        F.format_string(
            "%s %s %d/%d filled, %s, %d distinct %s", "letter", "header", "filled", "total", "kind", "distinct", "samples"
        )
    )
    columns = profiles.join(large.select(*BLOCK), BLOCK, "left_semi").select(
        *BLOCK, F.lit("columns").alias("part"), F.col("col_no").cast("long").alias("line_no"), described.alias("line")
    )
    return columns.unionByName(lines)
