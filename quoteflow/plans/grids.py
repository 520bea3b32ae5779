"""Cell grids over the test tables (survey 2.D and A10) and their check SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.operators import cells as c
from quoteflow.plans.base import Inputs, Query
from quoteflow.sources.store import stored

# --- check SQL ----------------------------------------------------------------------------------------------------

WORDS = ", ".join("'" + word.replace("'", "''") + "'" for word in c.HEADER_WORDS)
KNOWN = f"trim(regexp_replace(lower(trim(value)), '[^a-z0-9/'' ]+', '', 'g')) IN ({WORDS})"
HEADERS = f"""hits AS (SELECT grid_id, row_no AS header_row FROM cells WHERE {KNOWN} GROUP BY ALL HAVING count(*) >= 2),
headers AS (SELECT * FROM hits),
heights AS (SELECT grid_id, max(row_no) + 1 AS height, max(col_no) + 1 AS width FROM cells GROUP BY grid_id)"""


def blocks_sql(named: str) -> str:
    """Blocks under the heading rows of the relation `named`."""
    return f"""heading AS (SELECT c.grid_id, n.header_row, c.col_no, {KNOWN} AS known,
    c.col_no - row_number() OVER (PARTITION BY c.grid_id, n.header_row ORDER BY c.col_no) AS island
    FROM cells c JOIN {named} n ON n.grid_id = c.grid_id AND n.header_row = c.row_no),
spans AS (SELECT grid_id, header_row, min(island) FILTER (known) AS lo, max(island) FILTER (known) AS hi FROM heading GROUP BY ALL),
headed AS (SELECT h.grid_id, h.header_row, col_no FROM heading h JOIN spans s USING (grid_id, header_row) WHERE lo IS NULL OR island BETWEEN lo AND hi),
ends AS (SELECT n.grid_id, n.header_row, coalesce(min(h.header_row), any_value(g.height)) AS ends_before FROM {named} n
    JOIN heights g ON g.grid_id = n.grid_id LEFT JOIN headers h ON h.grid_id = n.grid_id AND h.header_row > n.header_row GROUP BY ALL),
filled AS (SELECT e.grid_id, e.header_row, c.row_no, count(*) AS filled FROM ends e JOIN cells c ON c.grid_id = e.grid_id
    AND c.row_no > e.header_row AND c.row_no < e.ends_before
    JOIN headed d ON d.grid_id = e.grid_id AND d.header_row = e.header_row AND d.col_no = c.col_no GROUP BY ALL),
blocks AS (SELECT grid_id, header_row, header_row + 1 AS first_data_row,
    coalesce(max(row_no) FILTER (filled >= 2), max(row_no)) AS last_data_row FROM filled GROUP BY ALL)"""


BLOCKS = f"WITH {HEADERS},\n{blocks_sql('headers')}"
LETTER = "CASE WHEN col_no < 26 THEN chr(65 + col_no) ELSE chr(64 + col_no // 26) || chr(65 + col_no % 26) END"
PROFILES = f"""{BLOCKS},
inside AS (SELECT b.grid_id, b.header_row, c.row_no, c.col_no, c.value FROM blocks b JOIN cells c ON c.grid_id = b.grid_id
    AND c.row_no BETWEEN b.first_data_row AND b.last_data_row JOIN headed d ON d.grid_id = b.grid_id AND d.header_row = b.header_row AND d.col_no = c.col_no),
vals AS (SELECT grid_id, header_row, col_no, value, count(*) AS times, min(row_no) AS first_row FROM inside GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY grid_id, header_row, col_no ORDER BY first_row) AS n FROM vals),
stats AS (SELECT grid_id, header_row, col_no, CAST(sum(times) AS BIGINT) AS filled,
    CAST(sum(CASE WHEN regexp_matches(value, '^\\s*\\d+([.,]\\d+)?') THEN times ELSE 0 END) AS BIGINT) AS numbers,
    max(length(value)) AS longest, count(*) AS different, min(first_row) AS first_filled_row,
    string_agg(CASE WHEN length(value) <= 40 THEN value ELSE left(value, 39) || '…' END, ', ' ORDER BY n) FILTER (n <= 5) AS samples FROM nth GROUP BY ALL),
profiles AS (SELECT d.grid_id, d.header_row, d.col_no, {LETTER.replace('col_no', 'd.col_no')} AS letter, h.value AS header, b.last_data_row - b.header_row AS total,
    coalesce(filled, 0) AS filled, coalesce(numbers, 0) AS numbers, coalesce(longest, 0) AS longest, coalesce(different, 0) AS different, first_filled_row,
    coalesce(filled, 0) / (b.last_data_row - b.header_row) AS fill_share, CASE WHEN filled > 0 THEN numbers / filled ELSE 0 END AS numeric_share,
    coalesce(samples, '') AS samples FROM headed d JOIN blocks b USING (grid_id, header_row)
    JOIN cells h ON h.grid_id = d.grid_id AND h.row_no = d.header_row AND h.col_no = d.col_no
    LEFT JOIN stats s ON s.grid_id = d.grid_id AND s.header_row = d.header_row AND s.col_no = d.col_no)"""
# Stand-in column answers: right ones and every kind of wrong one, by the grid's number.
ANSWERS = """answers AS (SELECT b.grid_id, b.header_row, v.ord, v.letter, v.field FROM blocks b JOIN (VALUES
    (0, 1, 'A', 'customer_item_code'), (0, 2, 'B', 'description'), (0, 3, 'C', 'quantity'), (0, 4, 'D', 'uom'),
    (1, 1, 'B', 'description'), (1, 2, 'B', 'quantity'),
    (2, 1, 'B', 'description'), (2, 2, 'C', 'description'),
    (3, 1, 'B', 'description'), (3, 2, 'Z', 'quantity'),
    (4, 1, 'B', 'description'), (4, 2, 'E', 'sr_no'),
    (5, 1, 'A', 'description'), (5, 2, 'B', 'quantity'),
    (6, 1, 'B', 'description'), (6, 2, 'C', 'quantity'),
    (7, 1, 'E', 'description')
    ) v(variant, ord, letter, field) ON v.variant = b.grid_id % 8)"""
DOCUMENT_ANSWERS = "SELECT o_orderkey AS doc_id, o_orderkey % 5 <> 2 AS has_item_list FROM orders WHERE o_orderkey % 6 <> 1"

# --- jobs -----------------------------------------------------------------------------------------------------------

ANSWER_ROWS = [
    (0, 1, "A", "customer_item_code"), (0, 2, "B", "description"), (0, 3, "C", "quantity"), (0, 4, "D", "uom"),
    (1, 1, "B", "description"), (1, 2, "B", "quantity"),
    (2, 1, "B", "description"), (2, 2, "C", "description"),
    (3, 1, "B", "description"), (3, 2, "Z", "quantity"),
    (4, 1, "B", "description"), (4, 2, "E", "sr_no"),
    (5, 1, "A", "description"), (5, 2, "B", "quantity"),
    (6, 1, "B", "description"), (6, 2, "C", "quantity"),
    (7, 1, "E", "description"),
]


def _answers(t: Inputs, blocks: DataFrame) -> DataFrame:
    rules = t.spark.createDataFrame(ANSWER_ROWS, "variant long, ord int, letter string, field string")
    chosen = blocks.select("grid_id", "header_row").withColumn("variant", F.col("grid_id") % 8)
    return chosen.join(F.broadcast(rules), "variant").drop("variant")


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) if k == "int" else F.col(n) for n, k in df.dtypes])


def _blocks(t: Inputs) -> DataFrame:
    """Blocks of the shared cells, found once."""
    return t.kept("blocks", lambda: stored(c.find_blocks(t.cells), "blocks"))


def blocks(t: Inputs) -> DataFrame:
    found = c.find_blocks(t.cells)
    return found.select("grid_id", "header_row", "first_data_row", "last_data_row")


def columns(t: Inputs) -> DataFrame:
    cells = t.cells
    out = c.table_columns(cells, c.header_rows(cells))
    return out.select("grid_id", "header_row", F.array_join(F.col("columns").cast("array<string>"), ",").alias("columns"))


def named(t: Inputs) -> DataFrame:
    """Every grid answered with a heading row of its own: some recognised, some past the end."""
    grids = t.orders.select(
        F.col("o_orderkey").alias("grid_id"), (F.col("o_orderkey") % 4 + 1).alias("header_row")
    )
    return c.named_blocks(t.cells, grids).select("grid_id", "header_row", "first_data_row", "last_data_row")


def fallback(t: Inputs) -> DataFrame:
    """Every grid's headings lose their words, so that where no others follow the first row has to do."""
    plain = t.sql(PLAIN_HEADINGS)
    rows = c.grid_rows(plain)
    return c.fallback_blocks(plain, c.find_blocks(plain, rows), rows).select(
        "grid_id", "header_row", "first_data_row", "last_data_row"
    )


def titles(t: Inputs) -> DataFrame:
    cells = t.cells
    return c.block_titles(cells, _blocks(t))


def profiles(t: Inputs) -> DataFrame:
    cells = t.cells
    out = _longs(c.profile_columns(cells, _blocks(t)))
    return out.select(
        "grid_id", "header_row", "letter", "header", "total", "filled", F.col("numeric").alias("numbers"), "longest",
        F.col("distinct").alias("different"), F.round("fill_share", 6).alias("fill_share"),
        F.round("numeric_share", 6).alias("numeric_share"), "is_empty", "is_rare", "kind", "samples",
    )


def samples(t: Inputs) -> DataFrame:
    cells = t.cells
    found = _blocks(t)
    return c.sample_rows(found, c.profile_columns(cells, found))


def problems(t: Inputs) -> DataFrame:
    cells = t.cells
    found = _blocks(t)
    return c.verify_mapping(c.profile_columns(cells, found), _answers(t, found))


def copied(t: Inputs) -> DataFrame:
    cells = t.cells
    found = _blocks(t)
    origins = t.orders.select(
        F.col("o_orderkey").alias("grid_id"), F.format_string("order%d.xlsx#S", "o_orderkey").alias("origin")
    )
    return c.copy_rows(cells, found, _answers(t, found), origins)


def unmapped(t: Inputs) -> DataFrame:
    cells = t.cells
    found = _blocks(t)
    return c.unmapped_columns(c.profile_columns(cells, found), _answers(t, found)).select(
        "grid_id", "header_row", "unmapped"
    )


def roles(t: Inputs) -> DataFrame:
    documents = t.orders.select(
        F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 7 != 3).alias("has_content")
    )
    holding = _blocks(t).select(F.col("grid_id").alias("doc_id"))
    return c.document_roles(documents, holding, t.sql(DOCUMENT_ANSWERS))


def preface(t: Inputs) -> DataFrame:
    cells = t.cells
    return c.preface_rows(cells, _blocks(t))


def pictures(t: Inputs) -> DataFrame:
    """Conversations as documents, turns as pages; an assistant's page carries a picture."""
    pages = t.conversations.select(
        F.col("conv_id").alias("doc_id"), "text",
        (F.col("role") == "assistant").alias("has_image"),
    )
    return c.picture_documents(pages)


def digest(t: Inputs) -> DataFrame:
    cells = t.cells
    found = _blocks(t)
    # Tables of more than six rows are told by their columns and samples, so that both forms are met.
    return c.table_digest(cells, found, c.profile_columns(cells, found), whole_rows=6)


TYPED = """SELECT l_orderkey AS grid_id, l_linenumber + CASE WHEN l_partkey % 50 = 0 THEN 4997 ELSE 0 END AS row_no, k.col_no,
    CASE k.col_no WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' WHEN 3 THEN 'datetime' ELSE 'text' END AS kind,
    min(CASE k.col_no WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(10)) || CASE WHEN l_suppkey % 2 = 0 THEN '.0' ELSE '.25' END
         WHEN 2 THEN CASE WHEN l_tax > 0.04 THEN 'true' ELSE 'false' END
         WHEN 3 THEN '2024-01-' || CAST(l_suppkey % 19 + 10 AS VARCHAR(10)) || 'T10:15:00'
         WHEN 70 THEN 'too far right' ELSE CASE WHEN l_suppkey % 3 = 0 THEN '  ' ELSE ' ' || l_returnflag || ' ' END END) AS value
FROM lineitem CROSS JOIN (SELECT 0 AS col_no UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 70) k GROUP BY 1, 2, 3, 4"""


def cleaned(t: Inputs) -> DataFrame:
    return c.clean_cells(t.sql(TYPED)).select(
        "grid_id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "value", "rows_truncated"
    )


PLAIN_HEADINGS = """SELECT grid_id, greatest(row_no - 1, 0) AS row_no, CASE WHEN row_no = 0 THEN 7 ELSE col_no END AS col_no,
    CASE WHEN row_no = 1 THEN 'c' || CAST(col_no AS VARCHAR(10)) ELSE value END AS value FROM cells"""
OPEN = "grid_id, header_row, first_data_row, last_data_row"
QUERIES = [
    Query("A10", "clean_cells", cleaned, f"""WITH typed AS ({TYPED}),
shown AS (SELECT grid_id, row_no, col_no, CASE kind WHEN 'number' THEN regexp_replace(trim(value), '\\.0+$', '') WHEN 'boolean' THEN upper(trim(value))
  WHEN 'datetime' THEN left(replace(trim(value), 'T', ' '), 16) ELSE trim(value) END AS value, false AS rows_truncated FROM typed)
SELECT grid_id, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, value, rows_truncated FROM shown WHERE value <> ''"""),
    Query("D1", "header_rows", lambda t: c.header_rows(t.cells), f"WITH {HEADERS} SELECT grid_id, header_row FROM headers"),
    Query("D2", "table_columns", columns,
          f"{BLOCKS} SELECT grid_id, header_row, string_agg(CAST(col_no AS VARCHAR), ',' ORDER BY col_no) AS columns FROM headed GROUP BY ALL"),
    Query("D3", "find_blocks", blocks, f"{BLOCKS} SELECT {OPEN} FROM blocks"),
    Query("D4", "named_blocks", named,
          f"WITH {HEADERS},\nnamed AS (SELECT o_orderkey AS grid_id, o_orderkey % 4 AS header_row FROM orders),\n{blocks_sql('named')} SELECT {OPEN} FROM blocks"),
    Query("D4", "fallback_blocks", fallback,
          f"""WITH whole AS (SELECT * FROM cells), {('hits' + HEADERS.split('hits', 1)[1]).replace('FROM cells', 'FROM plain').replace('hits AS', f"plain AS ({PLAIN_HEADINGS.replace('FROM cells', 'FROM whole')}), hits AS", 1)},
named AS (SELECT grid_id, CAST(0 AS BIGINT) AS header_row FROM heights WHERE height >= 2 AND width >= 2 AND grid_id NOT IN (SELECT grid_id FROM (WITH {blocks_sql('headers').replace('FROM cells', 'FROM plain').replace('JOIN cells', 'JOIN plain')} SELECT grid_id FROM blocks) z)),
{blocks_sql('named').replace('FROM cells', 'FROM plain').replace('JOIN cells', 'JOIN plain')} SELECT {OPEN} FROM blocks"""),
    Query("D5", "block_titles", titles,
          f"""{BLOCKS},\nabove AS (SELECT b.grid_id, b.header_row, c.row_no, string_agg(c.value, ' ' ORDER BY c.col_no) AS said FROM blocks b JOIN cells c ON c.grid_id = b.grid_id
  AND c.row_no IN (b.header_row - 1, b.header_row - 2) GROUP BY ALL)
SELECT b.grid_id, b.header_row, coalesce((SELECT max_by(said, row_no) FROM above a WHERE a.grid_id = b.grid_id AND a.header_row = b.header_row), '') AS title FROM blocks b"""),
    Query("D6", "profile_columns", profiles,
          f"""{PROFILES} SELECT grid_id, header_row, letter, header, total, filled, numbers, longest, different, round(CAST(fill_share AS DOUBLE), 6) AS fill_share,
round(CAST(numeric_share AS DOUBLE), 6) AS numeric_share, filled = 0 AS is_empty, filled > 0 AND fill_share <= 0.2 AS is_rare, CASE WHEN numeric_share > 0.9 THEN 'numbers' ELSE 'text' END AS kind, samples FROM profiles"""),
    Query("D7", "sample_rows", samples,
          f"""{PROFILES}, sized AS (SELECT *, last_data_row - header_row AS n FROM blocks)
SELECT DISTINCT grid_id, header_row, row_no FROM (
  SELECT grid_id, header_row, header_row + 1 + place AS row_no FROM (SELECT grid_id, header_row, n, unnest(range(n)) AS place FROM sized) x
  WHERE n <= 15 OR place < 5 OR place >= n - 5 OR (place >= n // 2 AND place < n // 2 + 5)
  UNION ALL SELECT grid_id, header_row, first_filled_row FROM profiles WHERE filled > 0 AND fill_share <= 0.2 AND total > 15)"""),
    Query("D8", "verify_mapping", problems,
          f"""{PROFILES},\n{ANSWERS},
judged AS (SELECT a.*, p.letter IS NULL AS unknown, p.filled = 0 AS empty, p.fill_share, p.numeric_share FROM answers a LEFT JOIN profiles p USING (grid_id, header_row, letter))
SELECT grid_id, header_row, CASE WHEN count(*) > count(DISTINCT letter) THEN 'the same column was given two fields'
  WHEN count(*) > count(DISTINCT field) THEN 'the same field was taken from two columns'
  WHEN bool_or(unknown) THEN 'column ' || min_by(letter, ord) FILTER (unknown) || ' is not in this table'
  WHEN bool_or(empty) THEN 'column ' || string_agg(letter, ', ' ORDER BY ord) FILTER (empty) || ' is empty in every row'
  ELSE coalesce(min(printf('column %s was given to quantity, but only %.0f%% of its values are numeric (expected at least 90%%)', letter, 100.0::DOUBLE * numeric_share)) FILTER (field = 'quantity' AND numeric_share < 0.9),
    min(printf('column %s was given to description, but only %.0f%% of its values are filled (expected at least 50%%)', letter, 100.0::DOUBLE * fill_share)) FILTER (field = 'description' AND fill_share < 0.5), '') END AS problem
FROM judged GROUP BY ALL"""),
    Query("D9", "copy_rows", copied,
          f"""{PROFILES},\n{ANSWERS},
moved AS (SELECT i.grid_id, i.header_row, i.row_no, max(value) FILTER (field = 'description') AS description, max(value) FILTER (field = 'customer_item_code') AS customer_item_code,
  max(value) FILTER (field = 'quantity') AS quantity, max(value) FILTER (field = 'uom') AS uom FROM inside i JOIN answers a ON a.grid_id = i.grid_id AND a.header_row = i.header_row
  AND a.letter = {LETTER.replace('col_no', 'i.col_no')} GROUP BY ALL)
SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY row_no) AS sr_no, description, customer_item_code, quantity, uom,
  'order' || CAST(grid_id AS VARCHAR) || '.xlsx#S row ' || CAST(row_no + 1 AS VARCHAR) AS source
FROM moved m WHERE (description IS NOT NULL OR customer_item_code IS NOT NULL) AND (quantity IS NOT NULL OR customer_item_code IS NOT NULL OR uom IS NOT NULL
  OR NOT EXISTS (SELECT 1 FROM answers a WHERE a.grid_id = m.grid_id AND a.header_row = m.header_row AND a.field = 'quantity'))"""),
    Query("D10", "unmapped_columns", unmapped,
          f"""{PROFILES},\n{ANSWERS} SELECT grid_id, header_row, letter || ' (' || header || ')' AS unmapped FROM profiles p WHERE filled > 0
AND EXISTS (SELECT 1 FROM answers a WHERE a.grid_id = p.grid_id AND a.header_row = p.header_row)
AND NOT EXISTS (SELECT 1 FROM answers a WHERE a.grid_id = p.grid_id AND a.header_row = p.header_row AND a.letter = p.letter)"""),
    Query("D11", "column_letter",
          lambda t: t.part.select("p_partkey", c.column_letter(F.col("p_partkey") % 800).alias("letter")),
          "SELECT p_partkey, CASE WHEN n < 26 THEN chr(CAST(65 + n AS INT)) WHEN n < 702 THEN chr(CAST(64 + n // 26 AS INT)) || chr(CAST(65 + n % 26 AS INT)) ELSE 'A' || chr(CAST(65 + (n - 702) // 26 AS INT)) || chr(CAST(65 + n % 26 AS INT)) END AS letter FROM (SELECT p_partkey, p_partkey % 800 AS n FROM part)"),
    Query("D12", "document_roles", roles,
          f"""{BLOCKS},\ntold AS ({DOCUMENT_ANSWERS})
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 3 THEN 'EMPTY' WHEN has_item_list IS NULL THEN 'UNREAD' WHEN NOT has_item_list THEN 'SUPPORTING'
  WHEN EXISTS (SELECT 1 FROM blocks b WHERE b.grid_id = o_orderkey) THEN 'ITEM_GRID' ELSE 'ITEM_TEXT' END AS role
FROM orders LEFT JOIN told ON told.doc_id = o_orderkey"""),
    Query("D13", "preface_rows", preface,
          f"""{BLOCKS},\nstops AS (SELECT grid_id, min(header_row) + 1 AS stop FROM blocks GROUP BY grid_id),
rows AS (SELECT grid_id, width, unnest(range(least(coalesce(stop, 25), 25, height))) AS row_no FROM heights LEFT JOIN stops USING (grid_id)),
places AS (SELECT grid_id, row_no, unnest(range(least(width, 8))) AS col_no FROM rows)
SELECT p.grid_id, p.row_no, string_agg(coalesce(CASE WHEN length(value) <= 60 THEN value ELSE left(value, 59) || '…' END, ''), ' | ' ORDER BY p.col_no) AS said
FROM places p LEFT JOIN cells c ON c.grid_id = p.grid_id AND c.row_no = p.row_no AND c.col_no = p.col_no GROUP BY ALL"""),
    Query("D14", "picture_documents", pictures,
          """SELECT doc_id, round(avg(length(text)), 4) AS chars_per_page, avg(length(text)) < 50 OR (avg(CASE WHEN has_image THEN 1 ELSE 0 END) >= 0.5 AND avg(length(text)) < 400) AS is_pictures
FROM (SELECT conv_id AS doc_id, text, role = 'assistant' AS has_image FROM conversations) GROUP BY doc_id"""),
    Query("D15", "table_digest", digest,
          f"""{PROFILES}, sized AS (SELECT *, last_data_row - header_row AS n FROM blocks),
wanted AS (SELECT grid_id, header_row, unnest(range(first_data_row, last_data_row + 1)) AS row_no FROM sized WHERE n <= 6
  UNION SELECT grid_id, header_row, header_row + 1 + place FROM (SELECT grid_id, header_row, n, unnest(range(n)) AS place FROM sized WHERE n > 6) x WHERE n <= 15 OR place < 5 OR place >= n - 5 OR (place >= n // 2 AND place < n // 2 + 5)
  UNION SELECT grid_id, header_row, first_filled_row FROM profiles WHERE filled > 0 AND fill_share <= 0.2 AND total > 15),
shown AS (SELECT grid_id, header_row, row_no, string_agg({LETTER} || ' ' || CASE WHEN length(value) <= 48 THEN value ELSE left(value, 47) || '…' END, ' | ' ORDER BY col_no) AS line FROM inside GROUP BY ALL)
SELECT grid_id, header_row, 'rows' AS part, row_no AS line_no, coalesce(line, '') AS line FROM wanted LEFT JOIN shown USING (grid_id, header_row, row_no)
UNION ALL SELECT grid_id, header_row, 'columns', CAST(col_no AS BIGINT), letter || ' ' || header || CASE WHEN filled = 0 THEN ' empty' ELSE ' ' || filled || '/' || total || ' filled, ' || CASE WHEN numeric_share > 0.9 THEN 'numbers' ELSE 'text' END || ', ' || different || ' distinct ' || samples END FROM profiles WHERE total > 6"""),
]
