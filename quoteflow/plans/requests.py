"""Extraction over requests made of orders and order lines (survey 2.E) and its check SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.functions import values as v
from quoteflow.operators import extraction as e
from quoteflow.plans import sqltext as q
from quoteflow.plans.base import Inputs, Query
from quoteflow.sources.store import stored

TODAY = "2024-11-20"

# Answers about an order's header: every kind of value, right and wrong, by arithmetic.
HEADER = """SELECT o_orderkey AS rfq_id, f.ord, f.field,
    CASE f.ord
      WHEN 1 THEN CASE WHEN o_orderkey % 6 = 0 THEN ' TBC ' ELSE ' MV Vessel ' || CAST(o_custkey AS VARCHAR(10)) || ' ' END
      WHEN 2 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'IMO 9074729' WHEN o_orderkey % 9 = 1 THEN 'none' ELSE CAST(9000000 + o_orderkey % 5000 AS VARCHAR(10)) END
      WHEN 3 THEN CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE 'REF/' || CAST(o_orderkey AS VARCHAR(10)) END
      WHEN 4 THEN 'c' || CAST(o_custkey AS VARCHAR(10)) || '@ship.example'
      WHEN 5 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Dubai' ELSE 'Tuas' END
      WHEN 6 THEN CASE o_orderkey % 10 WHEN 0 THEN '31/12/24' WHEN 1 THEN '2/3/2024' WHEN 2 THEN '30-02-24' WHEN 3 THEN '2024-06-3x' WHEN 4 THEN '5.5.25' WHEN 5 THEN 'soon'
             WHEN 6 THEN '12/25/2024' WHEN 7 THEN ' 2024-02-30 ' WHEN 8 THEN '2024-01-09' ELSE '13/13/24' END
      WHEN 7 THEN CASE o_orderkey % 8 WHEN 0 THEN '12 Oct' WHEN 1 THEN 'Oct 12, 24' WHEN 2 THEN '1 Jan' WHEN 3 THEN '31.6' WHEN 4 THEN '5/4' WHEN 5 THEN '25/12' WHEN 6 THEN '3 Foo 2024' ELSE 'Sept. 3' END
      WHEN 8 THEN CASE o_orderkey % 9 WHEN 0 THEN 'usd' WHEN 1 THEN '$' WHEN 2 THEN 'US$ only' WHEN 3 THEN 'AED/USD' WHEN 4 THEN 'euro' WHEN 5 THEN 'DHS' WHEN 6 THEN 'n/a' WHEN 7 THEN 'usdollar' ELSE ' sgd ' END
      WHEN 9 THEN CASE o_orderkey % 7 WHEN 0 THEN 'deck' WHEN 1 THEN 'Deck and engine stores' WHEN 2 THEN 'fresh fruit' WHEN 3 THEN 'CABIN' WHEN 4 THEN '?' ELSE 'Tender 5' END
      WHEN 10 THEN 'S-1' ELSE 'MV Second' END AS value,
    CASE WHEN (o_orderkey + f.ord) % 11 = 0 THEN ' ' WHEN (o_orderkey + f.ord) % 13 = 0 THEN 'elsewhere' ELSE 'email.body' END AS source
FROM orders CROSS JOIN (SELECT 1 AS ord, 'vessel_name' AS field UNION ALL SELECT 2, 'imo' UNION ALL SELECT 3, 'rfq_reference' UNION ALL SELECT 4, 'customer_email'
    UNION ALL SELECT 5, 'delivery_port' UNION ALL SELECT 6, 'eta' UNION ALL SELECT 7, 'quote_before' UNION ALL SELECT 8, 'currency' UNION ALL SELECT 9, 'rfq_type'
    UNION ALL SELECT 10, 'sender_code' UNION ALL SELECT 11, 'vessel_name') f"""
SOURCES = """SELECT o_orderkey AS rfq_id, 'email.body part 1' AS label FROM orders UNION ALL SELECT o_orderkey, 'a.xlsx' FROM orders"""
EXPLAINED = """SELECT o_orderkey AS rfq_id, f.ord, f.field, CASE WHEN f.ord = 5 THEN '  ' ELSE ' not  found
in pass ' || CAST(f.ord AS VARCHAR(10)) || ' ' END AS why
FROM orders CROSS JOIN (SELECT 1 AS ord, 'vessel_name' AS field UNION ALL SELECT 2, 'imo' UNION ALL SELECT 3, 'imo' UNION ALL SELECT 4, 'eta' UNION ALL SELECT 5, 'currency' UNION ALL SELECT 6, 'rfq_reference') f"""
# Each order's lines as one file, a second file repeating some of them (some at another quantity), a full copy of the first.
ITEMS = """SELECT rfq_id, 1 AS file_ord, line_index AS ord, description, customer_code AS customer_item_code, quantity, uom, 'a.xlsx#S row ' || CAST(line_index AS VARCHAR(10)) AS source FROM rfq_lines
UNION ALL SELECT rfq_id, 2, 100000 + line_index, upper(replace(description, ' ', '  ')), customer_code, CASE WHEN line_index % 4 = 1 THEN '99' ELSE quantity END, uom, 'b.xlsx#S row ' || CAST(line_index AS VARCHAR(10)) FROM rfq_lines WHERE line_index % 4 <> 3
UNION ALL SELECT rfq_id, 3, 200000 + line_index, description, customer_code, quantity, uom, 'c.xlsx#S row ' || CAST(line_index AS VARCHAR(10)) FROM rfq_lines WHERE rfq_id % 5 = 0"""
# The items of one request in seventeen stand under another number.
MOVED_ITEMS = f"SELECT CASE WHEN rfq_id % 17 = 0 THEN -1 - rfq_id ELSE rfq_id END AS rfq_id, file_ord, ord, description, customer_item_code, quantity, uom, source FROM ({ITEMS}) w"
STITCHED = """SELECT rfq_id AS doc_id, 1 + line_index // 3 AS part_no, line_index * 10 AS ord, description, customer_code AS customer_item_code, quantity, ' p' || CAST(1 + line_index // 3 AS VARCHAR(10)) || ' ' AS page FROM rfq_lines
UNION ALL SELECT rfq_id, 2 + line_index // 3, line_index * 10 + 9, description, customer_code, quantity, 'p9' FROM rfq_lines WHERE line_index % 3 = 2
UNION ALL SELECT rfq_id, 1, 5 + line_index * 10, description, customer_code, quantity, NULL FROM rfq_lines WHERE line_index = 1"""
PART_LABELS = """SELECT rfq_id AS doc_id, 1 + line_index // 3 AS part_no, 'p' || CAST(1 + line_index // 3 AS VARCHAR(10)) AS label FROM rfq_lines GROUP BY 1, 2
UNION ALL SELECT rfq_id, 2 + line_index // 3, 'o' || CAST(2 + line_index // 3 AS VARCHAR(10)) FROM rfq_lines WHERE line_index % 3 = 2 GROUP BY 1, 2"""
DOCUMENTS = """SELECT rfq_id, line_index AS file_ord, 'file' || CAST(line_index AS VARCHAR(10)) || '.pdf' AS origin, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS items,
    CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS facts,
    CASE l_suppkey % 5 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'nothing_to_read' WHEN 2 THEN 'file_too_large,text_truncated,unreadable,file_too_large' WHEN 3 THEN 'text_truncated' ELSE 'nothing_to_read,password_protected' END AS codes FROM rfq_lines"""

def _accepted(t: Inputs) -> DataFrame:
    judged = e.accept_header_answers(t.sql(HEADER), t.sql(SOURCES))
    return t.kept("accepted", lambda: stored(judged.where("refused is null"), "accepted"))


def _header(t: Inputs) -> DataFrame:
    """The standardised header as the table later stages read."""
    return t.kept("header", lambda: stored(e.normalize_header(_accepted(t), F.lit(TODAY).cast("date")), "header"))


def answers(t: Inputs) -> DataFrame:
    out = e.accept_header_answers(t.sql(HEADER), t.sql(SOURCES))
    return out.select("rfq_id", F.col("ord").cast("long").alias("ord"), "field", "value", "refused", "unknown_source")


def explanations(t: Inputs) -> DataFrame:
    return e.accept_explanations(t.sql(EXPLAINED), _accepted(t))


def header(t: Inputs) -> DataFrame:
    return e.normalize_header(_accepted(t), F.lit(TODAY).cast("date")).select(
        "rfq_id", "field", "text", F.date_format("day", "yyyy-MM-dd").alias("day"), "dropped", "checked", "warning"
    )


def single_values(t: Inputs) -> DataFrame:
    """The value functions by themselves over the header answers."""
    said = t.sql(HEADER)
    value = F.col("value")
    return said.where("ord in (2, 8, 9)").select(
        "rfq_id", "field",
        F.when(F.col("ord") == 2, v.check_imo(value)).alias("imo"),
        F.when(F.col("ord") == 8, v.standardise_currency(value)).alias("currency"),
        F.when(F.col("ord") == 9, v.standardise_type(value)).alias("rfq_type"),
        F.when(F.col("ord") == 9, v.type_fell_back(value)).alias("fell_back"),
    )


def dates(t: Inputs) -> DataFrame:
    read = v.parse_due_date(F.col("value"), F.lit(TODAY).cast("date"))
    return t.sql(HEADER).where("ord in (6, 7)").withColumn("read", read).select(
        "rfq_id", "field", F.date_format("read.day", "yyyy-MM-dd").alias("day"), F.col("read.problem").alias("problem")
    )


def _merged(t: Inputs) -> DataFrame:
    return t.kept("merged_items", lambda: stored(e.merge_sources(t.sql(ITEMS)), "merged"))


def merged(t: Inputs) -> DataFrame:
    return e.merge_sources(t.sql(ITEMS)).select("rfq_id", "sr_no", "description", "quantity", "source")


def merge_notes(t: Inputs) -> DataFrame:
    items = t.sql(MOVED_ITEMS).withColumn("file_ord", F.col("file_ord").cast("long"))
    rfqs = t.orders.select(F.col("o_orderkey").alias("rfq_id"))
    return e.merge_warnings(items, e.merge_sources(items), rfqs)


def stitched(t: Inputs) -> DataFrame:
    out = e.stitch_parts(t.sql(STITCHED), t.sql(PART_LABELS))
    return out.select("doc_id", "sr_no", "description", "quantity", "source")


def complete(t: Inputs) -> DataFrame:
    rfqs = t.orders.select(F.col("o_orderkey").alias("rfq_id"))
    # One request in eight has its lines under another number.
    moved = F.when(F.col("rfq_id") % 8 == 0, -1 - F.col("rfq_id")).otherwise(F.col("rfq_id"))
    return e.completeness(rfqs, _header(t), t.rfq_lines.withColumn("rfq_id", moved))


def completeness(t: Inputs) -> DataFrame:
    return complete(t).select("rfq_id", F.array_join("missing", ",").alias("missing"), "has_items", "complete")


def _explained(t: Inputs) -> DataFrame:
    return e.accept_explanations(t.sql(EXPLAINED), _accepted(t))


def blanks(t: Inputs) -> DataFrame:
    return e.why_blank(complete(t), _header(t), _explained(t))


def _documents(t: Inputs) -> DataFrame:
    return t.sql(DOCUMENTS).withColumn("warnings", F.split("codes", ","))


def unread(t: Inputs) -> DataFrame:
    return e.unread_files(_documents(t))


def remarks(t: Inputs) -> DataFrame:
    """The unread files and the disagreeing quantities of each request as remark sections."""
    files = e.unread_files(_documents(t)).select(
        "rfq_id", F.lit(2).alias("section"), F.lit("Attached files nobody could read - check them by hand:").alias("heading"),
        F.col("file_ord").alias("ord"), F.col("said").alias("entry"),
    )
    lines = t.rfq_lines.select(
        "rfq_id", F.lit(1).alias("section"), F.lit("Lines:").alias("heading"), F.col("line_index").alias("ord"),
        F.col("description").alias("entry"),
    )
    wide = lines.unionByName(lines.withColumn("ord", F.col("ord") + 100)).unionByName(lines.withColumn("ord", F.col("ord") + 200))
    return e.remarks(files.unionByName(wide))


def numbers(t: Inputs) -> DataFrame:
    """Quantities and keys in every spelling a customer uses, as number or text."""
    written = F.when(F.col("line_index") % 5 == 0, F.concat(F.lit("00"), F.col("line_index").cast("string"))).when(
        F.col("line_index") % 5 == 1, F.concat(F.col("l_partkey").cast("string"), F.lit(".50"))
    ).when(F.col("line_index") % 5 == 2, F.concat(F.col("l_suppkey").cast("string"), F.lit(".0"))).when(
        F.col("line_index") % 5 == 3, F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" "))
    ).otherwise(F.col("quantity"))
    return t.rfq_lines.withColumn("written", written).select(
        "rfq_id", "line_index", "written", v.plain_number(F.col("written")).alias("number"), F.upper("uom").alias("unit")
    )


def cells(t: Inputs) -> DataFrame:
    items = t.rfq_lines.select(
        "rfq_id", F.col("line_index").alias("sr_no"), F.col("customer_code").alias("customer_item_code"), "description",
        "quantity", "uom",
    )
    far = items.withColumn("sr_no", F.col("sr_no") + 4970)
    return e.form_cells(_header(t), items.unionByName(far))


def references(t: Inputs) -> DataFrame:
    written = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("REF "), F.col("o_orderkey").cast("string")))
    decision = F.concat(F.lit("ab-"), F.lower(F.lpad(F.col("o_custkey").cast("string"), 8, "c")))
    return t.orders.select(
        "o_orderkey", v.reference_or_generated(written, F.col("o_orderdate"), decision).alias("reference")
    )


def filenames(t: Inputs) -> DataFrame:
    name = F.concat(F.lit('RFQ: "'), "text", F.lit("/?*"))
    return t.documents.select("doc_id", v.usable_filename(name).alias("name"))


def goods(t: Inputs) -> DataFrame:
    wide = t.rfq_lines.select("rfq_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("copy"), "line_index", "description")
    items = wide.select(
        "rfq_id", (F.col("copy") * 50 + F.col("line_index")).alias("sr_no"),
        F.when(F.col("copy") == 2, F.lit("")).otherwise(F.repeat("description", F.lit(1) + F.col("copy") * 2)).alias("description"),
    )
    return e.goods_sample(items)


def note(t: Inputs) -> DataFrame:
    forms = t.orders.select(
        F.col("o_orderkey").alias("rfq_id"), F.format_string("RFQ %d.xlsx", "o_orderkey").alias("filename"),
        (F.col("o_orderkey") % 4).cast("int").alias("items"), (F.col("o_orderkey") % 3 != 0).alias("attached"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).alias("decision_id"),
    )
    out = e.forward_note(forms, e.unread_files(_documents(t)), e.quantity_conflicts(_merged(t)), blanks(t))
    return out.withColumn("section", F.col("section").cast("long"))


def journal(t: Inputs) -> DataFrame:
    documents = _documents(t).select(
        "rfq_id", "file_ord", "origin", F.lit(1).alias("grids"), F.lit(0).alias("pages"), F.lit(0).alias("images"),
        F.length("codes").alias("text_chars"), F.lit("ITEM_GRID").alias("role"), "items",
    )
    return e.extraction_journal(documents, _header(t), complete(t), _merged(t))


# --- check SQL ------------------------------------------------------------------------------------------------------

PLACES = ", ".join(f"'{one}'" for one in e.PLACEHOLDERS)
JUDGED = f"""said AS ({HEADER}),
flags AS (SELECT *, field = 'sender_code' AS derived, trim(value) = '' OR lower(trim(value)) IN ({PLACES}) AS blank, trim(source) = '' AS unsourced FROM said),
firsts AS (SELECT rfq_id, field, min(ord) AS accepted FROM flags WHERE NOT derived AND NOT blank AND NOT unsourced GROUP BY ALL),
judged AS (SELECT rfq_id, ord, field, trim(value) AS value, trim(source) AS source,
    CASE WHEN derived THEN '{e.DERIVED}' WHEN accepted < ord THEN '{e.CLAIMED_TWICE}' WHEN blank THEN '{e.PLACEHOLDER}' WHEN unsourced THEN '{e.WITHOUT_SOURCE}' END AS refused
    FROM flags LEFT JOIN firsts USING (rfq_id, field)),
accepted AS (SELECT * FROM judged WHERE refused IS NULL)"""
CURRENCIES = ", ".join(f"'{one}'" for one in v.CURRENCY_CODES)


def currency_sql(value: str) -> str:
    w = f"upper(trim({value}))"
    leading = f"nullif(regexp_extract({w}, '^({'|'.join(v.CURRENCY_CODES)})([^\\p{{L}}\\p{{N}}_]|$)', 1), '')"
    symbol = " ".join(f"WHEN {w} = '{sign}' THEN '{code}'" for sign, code in v.CURRENCY_SYMBOLS)
    prefix = " ".join(f"WHEN starts_with({w}, '{sign}') THEN '{code}'" for sign, code in v.CURRENCY_SYMBOLS)
    return f"CASE WHEN {w} IN ({CURRENCIES}) THEN {w} {symbol} WHEN {leading} IS NOT NULL THEN {leading} {prefix} ELSE {w} END"


def type_sql(value: str) -> str:
    w = f"upper(trim({value}))"
    kinds = ", ".join(f"'{one}'" for one in v.RFQ_TYPES)
    held = " ".join(f"WHEN contains({w}, '{one}') THEN '{one}'" for one in v.RFQ_TYPES)
    return f"CASE WHEN {w} IN ({kinds}) THEN {w} {held} ELSE 'OTHERS' END"


def fell_sql(value: str) -> str:
    return "NOT (" + " OR ".join(f"contains(upper(trim({value})), '{one}')" for one in v.RFQ_TYPES) + ")"


def imo_sql(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    total = " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INT) * {7 - i}" for i in range(6))
    return f"CASE WHEN length({d}) = 7 THEN CASE WHEN ({total}) % 10 = CAST(substr({d}, 7, 1) AS INT) THEN {d} END END"


MONTH_NAMES = ", ".join(f"('{name}', {number})" for name, number in v.MONTHS)


def dates_sql(relation: str) -> str:
    """The relation with (day, problem) read from its `value`."""
    return f"""months(name, number) AS (VALUES {MONTH_NAMES}),
cut AS (SELECT *, regexp_replace(trim(value), '[ ./-]+$', '') AS x FROM {relation}),
split AS (SELECT *, regexp_extract(x, '^(\\d{{4}})-(\\d{{1,2}})-(\\d{{1,2}})', ['y', 'm', 'd']) AS iso, regexp_extract(x, '^(\\d{{1,2}})[./-](\\d{{1,2}})[./-](\\d{{2,4}})$', ['a', 'b', 'y']) AS num,
    regexp_extract(x, '^(\\d{{1,2}})[./-](\\d{{1,2}})$', ['a', 'b']) AS two, regexp_extract(x, '^(\\d{{1,2}})[\\s./-]*([A-Za-z]{{3,9}})\\.?[\\s,./-]*(\\d{{2,4}})?$', ['d', 'm', 'y']) AS dm,
    regexp_extract(x, '^([A-Za-z]{{3,9}})\\.?[\\s,./-]*(\\d{{1,2}})[\\s,./-]*(\\d{{2,4}})?$', ['m', 'd', 'y']) AS md FROM cut),
picked AS (SELECT s.*, CASE WHEN iso.y <> '' THEN 'iso' WHEN num.a <> '' THEN 'num' WHEN two.a <> '' THEN 'two' WHEN m1.number IS NOT NULL THEN 'dm' WHEN m2.number IS NOT NULL THEN 'md' END AS form,
    m1.number AS month1, m2.number AS month2 FROM split s LEFT JOIN months m1 ON m1.name = lower(dm.m) LEFT JOIN months m2 ON m2.name = lower(md.m)),
parts AS (SELECT *, CASE form WHEN 'iso' THEN try_cast(iso.d AS INT) WHEN 'num' THEN CASE WHEN try_cast(num.a AS INT) > 12 AND try_cast(num.b AS INT) <= 12 THEN try_cast(num.a AS INT) WHEN try_cast(num.b AS INT) > 12 AND try_cast(num.a AS INT) <= 12 THEN try_cast(num.b AS INT) WHEN try_cast(num.a AS INT) = try_cast(num.b AS INT) THEN try_cast(num.a AS INT) END
      WHEN 'two' THEN CASE WHEN try_cast(two.a AS INT) > 12 AND try_cast(two.b AS INT) <= 12 THEN try_cast(two.a AS INT) WHEN try_cast(two.b AS INT) > 12 AND try_cast(two.a AS INT) <= 12 THEN try_cast(two.b AS INT) END
      WHEN 'dm' THEN try_cast(dm.d AS INT) WHEN 'md' THEN try_cast(md.d AS INT) END AS d,
    CASE form WHEN 'iso' THEN try_cast(iso.m AS INT) WHEN 'num' THEN CASE WHEN try_cast(num.a AS INT) > 12 AND try_cast(num.b AS INT) <= 12 THEN try_cast(num.b AS INT) WHEN try_cast(num.b AS INT) > 12 AND try_cast(num.a AS INT) <= 12 THEN try_cast(num.a AS INT) WHEN try_cast(num.a AS INT) = try_cast(num.b AS INT) THEN try_cast(num.a AS INT) END
      WHEN 'two' THEN CASE WHEN try_cast(two.a AS INT) > 12 AND try_cast(two.b AS INT) <= 12 THEN try_cast(two.b AS INT) WHEN try_cast(two.b AS INT) > 12 AND try_cast(two.a AS INT) <= 12 THEN try_cast(two.a AS INT) END
      WHEN 'dm' THEN month1 WHEN 'md' THEN month2 END AS m,
    CASE form WHEN 'iso' THEN try_cast(iso.y AS INT) WHEN 'num' THEN try_cast(num.y AS INT) WHEN 'dm' THEN try_cast(nullif(dm.y, '') AS INT) WHEN 'md' THEN try_cast(nullif(md.y, '') AS INT) END AS y FROM picked),
days AS (SELECT *, CASE WHEN y IS NOT NULL THEN try_cast(printf('%04d-%02d-%02d', CASE WHEN y < 100 AND form <> 'iso' THEN y + 2000 ELSE y END, m, d) AS DATE)
    WHEN date_diff('day', try_cast(printf('2024-%02d-%02d', m, d) AS DATE), DATE '{TODAY}') > 60 THEN try_cast(printf('2025-%02d-%02d', m, d) AS DATE)
    ELSE try_cast(printf('2024-%02d-%02d', m, d) AS DATE) END AS day FROM parts),
dated AS (SELECT *, CASE WHEN form IS NULL THEN '{v.DATE_UNREADABLE}' WHEN d IS NULL THEN '{v.DATE_AMBIGUOUS}' WHEN day IS NULL THEN '{v.DATE_IMPOSSIBLE}' ELSE '' END AS problem FROM days)"""


NORMALISED = f"""{JUDGED},
{dates_sql("(SELECT * FROM accepted WHERE field IN ('eta', 'quote_before')) z")},
header AS (SELECT rfq_id, field, CASE field WHEN 'imo' THEN coalesce({imo_sql('value')}, value) WHEN 'currency' THEN {currency_sql('value')} WHEN 'rfq_type' THEN {type_sql('value')} ELSE value END AS text,
    NULL AS day, NULL AS dropped, CASE WHEN field = 'imo' AND {imo_sql('value')} IS NULL THEN '{e.IMO_INVALID}' END AS checked,
    CASE WHEN field = 'imo' AND {imo_sql('value')} IS NULL THEN '{e.IMO_INVALID}' WHEN field = 'rfq_type' AND {fell_sql('value')} THEN '{e.TYPE_FELL_BACK}' END AS warning
  FROM accepted WHERE field NOT IN ('eta', 'quote_before')
  UNION ALL SELECT rfq_id, field, NULL, strftime(day, '%Y-%m-%d'), nullif(problem, ''), NULL, nullif(problem, '') FROM dated)"""
IDENT = f"{q.collapsed('customer_item_code')} AS id_code, {q.collapsed('description')} AS id_description, {q.collapsed('quantity')} AS id_quantity"
MERGED = f"""items AS (SELECT *, {IDENT} FROM ({ITEMS})),
merged AS (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY ord) AS sr_no FROM (
    SELECT *, min(file_ord) OVER (PARTITION BY rfq_id, id_code, id_description, id_quantity) AS first_file FROM items) WHERE file_ord = first_file)"""
CONFLICTS = """named AS (SELECT *, split_part(source, '#', 1) AS file FROM merged),
firsts_of AS (SELECT rfq_id, id_code, id_description, min_by(id_quantity, sr_no) AS written, min_by(file, sr_no) AS place FROM named GROUP BY ALL),
conflicts AS (SELECT rfq_id, sr_no, left(coalesce(description, ''), 48) || ': ' || coalesce(quantity, 'None') || ' in "' || file || '", ' || written || ' in "' || place || '"' AS conflict
    FROM named JOIN firsts_of USING (rfq_id, id_code, id_description) WHERE file <> place AND id_quantity <> written)"""
REQUIRED = ", ".join(f"'{one}'" for one in e.REQUIRED_FIELDS)
COMPLETE = f"""starred AS (SELECT unnest([{REQUIRED}]) AS field, unnest(range({len(e.REQUIRED_FIELDS)})) AS place),
missing AS (SELECT o_orderkey AS rfq_id, field, place FROM orders, starred WHERE NOT EXISTS (SELECT 1 FROM header h WHERE h.rfq_id = o_orderkey AND h.field = starred.field AND (text IS NOT NULL OR day IS NOT NULL))),
complete AS (SELECT o_orderkey AS rfq_id, coalesce((SELECT string_agg(field, ',' ORDER BY place) FROM missing m WHERE m.rfq_id = o_orderkey), '') AS missing,
    o_orderkey % 8 <> 0 AND EXISTS (SELECT 1 FROM rfq_lines l WHERE l.rfq_id = o_orderkey) AS has_items FROM orders)"""
KEPT_REASONS = f"""told AS (SELECT rfq_id, field, ord, left(trim(regexp_replace(why, '\\s+', ' ', 'g')), 200) AS why FROM ({EXPLAINED})),
kept AS (SELECT rfq_id, field, max_by(why, ord) AS why FROM told t WHERE why <> '' AND field IN ({REQUIRED}) AND NOT EXISTS (SELECT 1 FROM accepted a WHERE a.rfq_id = t.rfq_id AND a.field = t.field) GROUP BY ALL)"""
LABEL = "CASE field " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in e.LABELS) + " ELSE field END"
REASON = "CASE dropped " + " ".join("WHEN '{}' THEN '{}'".format(k, x.replace("'", "''")) for k, x in e.REASONS) + " END"
PLACE = "list_position([" + ", ".join(f"'{one}'" for one in e.STANDARD_ORDER) + "], field) + 100"
BLANKS = f"""blank_fields AS (SELECT rfq_id, field, place FROM missing UNION ALL SELECT rfq_id, field, {PLACE} FROM header h WHERE dropped IS NOT NULL AND NOT EXISTS (SELECT 1 FROM missing m WHERE m.rfq_id = h.rfq_id AND m.field = h.field)),
blanks AS (SELECT rfq_id, row_number() OVER (PARTITION BY rfq_id ORDER BY place) AS line_no, {LABEL} || coalesce(': ' || coalesce({REASON}, why), '') AS line
    FROM blank_fields LEFT JOIN (SELECT rfq_id, field, dropped FROM header WHERE dropped IS NOT NULL) USING (rfq_id, field) LEFT JOIN kept USING (rfq_id, field))"""
FILE_REASON = "CASE code " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in e.FILE_REASONS) + " END"
UNREAD = f"""docs AS ({DOCUMENTS}),
codes_of AS (SELECT rfq_id, file_ord, code, min(nth) AS nth FROM (SELECT rfq_id, file_ord, unnest(string_split(codes, ',')) AS code, generate_subscripts(string_split(codes, ','), 1) AS nth FROM docs) GROUP BY ALL),
reasons AS (SELECT rfq_id, file_ord, string_agg({FILE_REASON}, ', ' ORDER BY nth) AS told, bool_or(code = 'nothing_to_read') AS nothing FROM codes_of GROUP BY ALL),
unread AS (SELECT rfq_id, file_ord, origin || ': ' || coalesce(told, '{e.NOTHING_IN_IT}') AS said FROM docs JOIN reasons USING (rfq_id, file_ord) WHERE items = 0 AND facts = 0 AND (told IS NOT NULL OR nothing))"""
PLAIN = "CASE WHEN regexp_full_match(trim({x}), '\\d+(\\.\\d+)?') AND (trim({x})::DOUBLE <> floor(trim({x})::DOUBLE) OR CAST(trim({x})::DOUBLE::BIGINT AS VARCHAR) = trim({x})) THEN trim({x})::DOUBLE END"
WRITTEN = """CASE line_index % 5 WHEN 0 THEN '00' || CAST(line_index AS VARCHAR) WHEN 1 THEN CAST(l_partkey AS VARCHAR) || '.50' WHEN 2 THEN CAST(l_suppkey AS VARCHAR) || '.0'
    WHEN 3 THEN ' ' || CAST(l_partkey AS VARCHAR) || ' ' ELSE quantity END"""
FORM_CELL = "CASE field " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in e.FORM_CELLS) + " END"


def _kind(x: str) -> str:
    return f"CASE WHEN {PLAIN.replace('{x}', x)} IS NOT NULL THEN 'number' ELSE 'text' END"


QUERIES = [
    Query("E1", "accept_header_answers", answers,
          f"""WITH {JUDGED} SELECT rfq_id, CAST(ord AS BIGINT) AS ord, field, value, refused, refused IS NULL AND NOT (contains(source, 'email.body part 1') OR contains('email.body part 1', source) OR contains(source, 'a.xlsx') OR contains('a.xlsx', source)) AS unknown_source FROM judged"""),
    Query("E2", "accept_explanations", explanations,
          f"""WITH {JUDGED},\n{KEPT_REASONS} SELECT rfq_id, field, why, NULL::VARCHAR AS warning FROM kept
UNION ALL SELECT DISTINCT rfq_id, field, NULL, '{e.EXPLAINED_FOUND}' FROM told t WHERE why <> '' AND EXISTS (SELECT 1 FROM accepted a WHERE a.rfq_id = t.rfq_id AND a.field = t.field)"""),
    Query("E3+E4+E5", "standardised_values", single_values,
          f"""WITH said AS ({HEADER}) SELECT rfq_id, field, CASE WHEN ord = 2 THEN {imo_sql('value')} END AS imo, CASE WHEN ord = 8 THEN {currency_sql('value')} END AS currency,
CASE WHEN ord = 9 THEN {type_sql('value')} END AS rfq_type, CASE WHEN ord = 9 THEN {fell_sql('value')} END AS fell_back FROM said WHERE ord IN (2, 8, 9)"""),
    Query("E6", "parse_due_date", dates,
          f"WITH said AS ({HEADER}),\n{dates_sql('(SELECT * FROM said WHERE ord IN (6, 7)) z')} SELECT rfq_id, field, strftime(day, '%Y-%m-%d') AS day, problem FROM dated"),
    Query("E7", "normalize_header", header, f"WITH {NORMALISED} SELECT rfq_id, field, text, day, dropped, checked, warning FROM header"),
    Query("E8", "merge_sources", merged, f"WITH {MERGED} SELECT rfq_id, sr_no, description, quantity, source FROM merged"),
    Query("E8", "merge_warnings", merge_notes,
          f"""WITH {MERGED.replace(ITEMS, MOVED_ITEMS)} SELECT DISTINCT rfq_id, CAST(file_ord AS BIGINT) AS file_ord, '{e.DUPLICATE_SOURCE}' AS warning FROM items i WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.rfq_id = i.rfq_id AND m.file_ord = i.file_ord)
UNION ALL SELECT o_orderkey, NULL, '{e.NO_ITEMS}' FROM orders WHERE o_orderkey NOT IN (SELECT rfq_id FROM items)"""),
    Query("E9", "quantity_conflicts", lambda t: e.quantity_conflicts(_merged(t)), f"WITH {MERGED},\n{CONFLICTS} SELECT rfq_id, sr_no, conflict FROM conflicts"),
    Query("E10", "stitch_parts", stitched,
          f"""WITH items AS (SELECT *, {IDENT} FROM ({STITCHED})), labels_of AS ({PART_LABELS}),
marked AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, id_code, id_description, id_quantity) AS first_ord, min(part_no) OVER (PARTITION BY doc_id) AS first_part FROM items),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS sr_no FROM marked WHERE part_no = first_part OR ord = first_ord)
SELECT doc_id, sr_no, description, quantity, CASE WHEN EXISTS (SELECT 1 FROM labels_of l WHERE l.doc_id = k.doc_id AND l.part_no = k.part_no AND l.label = trim(k.page)) THEN trim(page)
  ELSE coalesce((SELECT min(label) FROM labels_of l WHERE l.doc_id = k.doc_id AND l.part_no = k.part_no), '') END AS source FROM kept k"""),
    Query("E11", "completeness", completeness, f"WITH {NORMALISED},\n{COMPLETE} SELECT rfq_id, missing, has_items, has_items AND missing = '' AS complete FROM complete"),
    Query("E12", "why_blank", blanks, f"WITH {NORMALISED},\n{COMPLETE},\n{KEPT_REASONS},\n{BLANKS} SELECT rfq_id, line_no, line FROM blanks"),
    Query("E13", "unread_files", unread, f"WITH {UNREAD} SELECT rfq_id, file_ord, said FROM unread"),
    Query("E14", "remarks", remarks,
          f"""WITH {UNREAD},
entries AS (SELECT rfq_id, 2 AS section, 'Attached files nobody could read - check them by hand:' AS heading, file_ord AS ord, said AS entry FROM unread
  UNION ALL SELECT rfq_id, 1, 'Lines:', line_index + 100 * k, description FROM rfq_lines, (VALUES (0), (1), (2)) v(k)),
counted AS (SELECT *, row_number() OVER (PARTITION BY rfq_id, section ORDER BY ord) AS n, count(*) OVER (PARTITION BY rfq_id, section) AS total FROM entries),
sections AS (SELECT rfq_id, section, any_value(heading) || string_agg(chr(10) || '  - ' || entry, '' ORDER BY n) FILTER (n <= 12) || CASE WHEN any_value(total) > 12 THEN chr(10) || '  - and ' || CAST(any_value(total) - 12 AS VARCHAR) || ' more, see the forwarded email' ELSE '' END AS block FROM counted GROUP BY ALL)
SELECT rfq_id, string_agg(block, chr(10) ORDER BY section) AS remarks FROM sections GROUP BY rfq_id"""),
    Query("E15", "reference_or_generated", references,
          "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'REF ' || CAST(o_orderkey AS VARCHAR) ELSE 'POC-' || strftime(o_orderdate, '%Y%m%d') || '-' || upper(left(replace('ab-' || lpad(CAST(o_custkey AS VARCHAR), 8, 'c'), '-', ''), 6)) END AS reference FROM orders"),
    Query("E16", "number_or_text", numbers, f"SELECT rfq_id, line_index, {WRITTEN} AS written, {PLAIN.replace('{x}', WRITTEN)} AS number, upper(uom) AS unit FROM rfq_lines"),
    Query("E17", "form_cells", cells,
          f"""WITH {NORMALISED},
body AS (SELECT rfq_id, line_index + 4970 * k AS sr_no, customer_code, description, quantity, uom FROM rfq_lines, (VALUES (0), (1)) v(k))
SELECT rfq_id, {FORM_CELL} AS cell, CASE WHEN day IS NOT NULL THEN 'day' WHEN field = 'imo' AND {PLAIN.replace('{x}', 'text')} IS NOT NULL THEN 'number' ELSE 'text' END AS kind, coalesce(day, text) AS value FROM header WHERE text IS NOT NULL OR day IS NOT NULL
UNION ALL SELECT rfq_id, c || CAST(sr_no + 23 AS VARCHAR), CASE c WHEN 'A' THEN 'number' WHEN 'B' THEN {_kind('customer_code')} WHEN 'E' THEN {_kind('quantity')} ELSE 'text' END,
  CASE c WHEN 'A' THEN CAST(sr_no AS VARCHAR) WHEN 'B' THEN customer_code WHEN 'D' THEN description WHEN 'E' THEN quantity ELSE upper(uom) END AS value
FROM body, (VALUES ('A'), ('B'), ('D'), ('E'), ('F')) k(c) WHERE sr_no <= 4977 AND (c <> 'B' OR customer_code IS NOT NULL)"""),
    Query("E17", "form_warnings",
          lambda t: e.form_warnings(t.rfq_lines.select("rfq_id", (F.col("line_index") + 4970).alias("sr_no"))),
          f"SELECT DISTINCT rfq_id, '{e.ITEMS_TRUNCATED}' AS warning FROM rfq_lines WHERE line_index > 7"),
    Query("E18", "extraction_journal", journal,
          f"""WITH {NORMALISED},\n{COMPLETE}, {MERGED.replace("items AS (", "all_items AS (").replace("FROM items)", "FROM all_items)")}, docs AS ({DOCUMENTS}),
kept_header AS (SELECT h.*, a.value AS raw, a.source, coalesce(h.text, h.day) AS shown FROM header h JOIN accepted a USING (rfq_id, field)),
counts AS (SELECT rfq_id, count(*) AS items, count(DISTINCT source) AS sources FROM merged GROUP BY rfq_id)
SELECT c.rfq_id, 'request' AS part, CAST(0 AS BIGINT) AS ord, '{{"items":' || coalesce(n.items, 0) || ',"sources":' || coalesce(n.sources, 0) || ',"complete":' || CASE WHEN has_items AND missing = '' THEN 'true' ELSE 'false' END
  || ',"missing_required":[' || CASE WHEN missing = '' THEN '' ELSE '"' || replace(missing, ',', '","') || '"' END || ']}}' AS payload FROM complete c LEFT JOIN counts n USING (rfq_id)
UNION ALL SELECT rfq_id, 'document', file_ord, '{{' || concat_ws(',', '"origin":' || to_json(origin), '"grids":1,"pages":0,"images":0', '"text_chars":' || length(codes), '"role":"ITEM_GRID"', '"items":' || items) || '}}' FROM docs
UNION ALL SELECT rfq_id, 'header', list_position([{', '.join(f"'{one}'" for one in e.HEADER_FIELDS)}], field), '{{' || concat_ws(',', '"field":' || to_json(field), '"raw":' || to_json(raw), '"source":' || to_json(source), '"value":' || to_json(shown), '"dropped":' || to_json(dropped)) || '}}' FROM kept_header"""),
    Query("E19", "usable_filename", filenames,
          """SELECT doc_id, trim(left(trim(regexp_replace(regexp_replace('RFQ: "' || text || '/?*', '[<>:"/\\\\|?*\\x00-\\x1f]+', ' ', 'g'), '\\s+', ' ', 'g')), 60)) AS name FROM documents"""),
    Query("E20", "goods_sample", goods,
          """WITH items AS (SELECT rfq_id, k * 50 + line_index AS ord, CASE WHEN k = 2 THEN '' ELSE repeat(description, 1 + k * 2) END AS d FROM rfq_lines, (SELECT unnest(range(6)) AS k)),
listed AS (SELECT rfq_id, CASE WHEN length(d) <= 70 THEN d ELSE left(d, 69) || '…' END AS entry, row_number() OVER (PARTITION BY rfq_id ORDER BY ord) AS n, count(*) OVER (PARTITION BY rfq_id) AS total FROM items WHERE d <> '')
SELECT rfq_id, string_agg('- ' || entry, chr(10) ORDER BY n) FILTER (n <= 20) || CASE WHEN any_value(total) > 20 THEN chr(10) || '- ... and ' || CAST(any_value(total) - 20 AS VARCHAR) || ' more' ELSE '' END AS goods FROM listed GROUP BY rfq_id"""),
    Query("E21", "forward_note", note,
          f"""WITH {NORMALISED},\n{COMPLETE},\n{KEPT_REASONS},\n{BLANKS},\n{UNREAD},\n{MERGED},\n{CONFLICTS},
blank_counts AS (SELECT rfq_id, count(*) AS n FROM blanks GROUP BY ALL)
SELECT o_orderkey AS rfq_id, CAST(1 AS BIGINT) AS section, CAST(0 AS BIGINT) AS line_no, CASE WHEN o_orderkey % 3 <> 0 THEN 'Auto-filled RFQ form attached: RFQ ' || CAST(o_orderkey AS VARCHAR) || '.xlsx (' || CAST(o_orderkey % 4 AS VARCHAR) || ' item(s)).'
  ELSE 'An auto-filled RFQ form was produced but could not be attached to this forward. It is on the agent''s disk under decision ' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'unknown' END || '.' END AS line FROM orders
UNION ALL SELECT o_orderkey, 2, 0, 'No line items could be read out of this RFQ - the item grid is empty.' FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT rfq_id, 3, 0, CAST(count(*) AS VARCHAR) || ' attached file(s) could not be read - please check by hand:' FROM unread GROUP BY rfq_id
UNION ALL SELECT rfq_id, 4, file_ord, said FROM unread
UNION ALL SELECT DISTINCT rfq_id, 5, 0, 'Two attachments disagree on a quantity - check before quoting:' FROM conflicts
UNION ALL SELECT rfq_id, 6, sr_no, conflict FROM conflicts
UNION ALL SELECT rfq_id, 7, 0, 'Left blank, please complete by hand:' FROM blank_counts
UNION ALL SELECT rfq_id, 8, line_no, '- ' || line FROM blanks WHERE line_no <= 6
UNION ALL SELECT rfq_id, 8, 7, '- and ' || CAST(n - 6 AS VARCHAR) || ' more, in the block under the form' FROM blank_counts WHERE n > 6
UNION ALL SELECT o_orderkey, 9, 0, 'Filled by an automated agent - check it against the customer''s own files.' FROM orders"""),
]
