"""Quotes, actions, prices and records over orders and events (survey 2.G) and its check SQL."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.operators import quotes as g
from quoteflow.operators import records as r
from quoteflow.plans import sqltext as q
from quoteflow.plans.base import Inputs, Query
from quoteflow.plans.matching import CODES, codes_of

# --- sources both engines read -----------------------------------------------------------------------------------------

RECORDS = """SELECT v.email_id AS record_id, v.category IN ('NEW_RFQ', 'UPDATED_RFQ', 'PORTAL_RFQ_NOTIFICATION') AS is_rfq, v.received_at,
    CASE WHEN v.email_id % 9 = 0 THEN NULL ELSE lower(c.c_name) || '@' || lower(c.c_mktsegment) || '.example' END AS customer, 'Label ' || c.c_mktsegment AS label,
    CASE WHEN v.email_id % 5 = 0 THEN 'SENT' WHEN v.email_id % 5 = 1 THEN 'FAILED' END AS outcome, CASE WHEN v.email_id % 11 = 0 THEN NULL ELSE v.category END AS category, v.priority
FROM verdicts v JOIN customer c ON c.c_custkey = v.o_custkey"""
# An event is an action on an order: four to an order, each with a line of it, a product and a number.
ACTIONS = """SELECT e.event_id // 4 AS rfq_id, e.user_id % 4 + 1 AS line_index, e.event_id AS ord, e.ts AS acted_at, e.event_type, e.user_id,
    CASE WHEN e.event_id % 5 = 0 THEN NULL WHEN e.event_id % 5 = 1 THEN s.customer_code ELSE lower(s.code) END AS item_code FROM events e LEFT JOIN catalog_rows s ON s.position = e.user_id"""
OFFERS = f"""SELECT rfq_id, line_index, ord, acted_at, CASE WHEN user_id % 9 = 0 THEN CAST(0 AS DECIMAL(14,2)) WHEN user_id % 9 = 1 THEN CAST(10000001 AS DECIMAL(14,2)) ELSE CAST(user_id + 1 AS DECIMAL(14,2)) END AS unit_price,
    event_type = 'click' AS clears FROM ({ACTIONS}) a"""
LETTERS = f"""SELECT rfq_id, ord, 'supplier ' || CAST(user_id % 3 AS VARCHAR(10)) AS supplier FROM ({ACTIONS}) a
UNION ALL SELECT rfq_id, ord, 'supplier ' || CAST(user_id % 2 AS VARCHAR(10)) FROM ({ACTIONS}) b WHERE event_type <> 'view'"""
EXISTING = "SELECT o_orderkey AS rfq_id FROM orders WHERE o_orderkey % 6 = 0"
ASKED = "SELECT rfq_id, line_index FROM rfq_lines WHERE l_suppkey % 3 <> 0"
LETTER_LINES = f"""SELECT a.rfq_id, a.ord, a.supplier, l.line_index FROM ({LETTERS}) a JOIN rfq_lines l ON l.rfq_id = a.rfq_id AND (l.line_index + CAST(substr(a.supplier, 10) AS BIGINT)) % 2 = 0"""
APPROVALS = f"""SELECT rfq_id, ord, acted_at AS approved_at, CAST(user_id % 40 AS DOUBLE) AS margin_stock, CASE WHEN user_id % 13 = 0 THEN CAST(1001 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS margin_jit FROM ({ACTIONS}) a"""
PRICES = f"""SELECT a.rfq_id, a.ord, l.line_index, CASE WHEN a.user_id % 17 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE l.unit_price END AS unit_price
    FROM ({ACTIONS}) a JOIN rfq_lines l ON l.rfq_id = a.rfq_id AND (a.event_type <> 'error' OR l.line_index <> 2)"""
# The same actions one after the other: an event's letters, then its offer, its approval and its confirmation.
STEPPED = {name: f"SELECT * REPLACE (ord * 4 + {step} AS ord) FROM ({rows})" for name, step, rows in (
    ("letters", 0, LETTERS), ("letter_lines", 0, LETTER_LINES), ("offers", 1, OFFERS), ("approvals", 2, APPROVALS), ("prices", 2, PRICES), ("confirmations", 3, ACTIONS))}
# Lines of requests that had letters before any of these actions.
ASKED_BEFORE = f"SELECT rfq_id, line_index FROM ({ASKED}) z WHERE rfq_id IN ({EXISTING})"
HEADERS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"imo": {"value": "' || CAST(user_id AS VARCHAR(10)) || '", "raw": "x"}}' WHEN 1 THEN '{"imo": {"raw": "r' || CAST(user_id AS VARCHAR(10)) || '"}}'
    WHEN 2 THEN '{"imo": "bare ' || CAST(user_id AS VARCHAR(10)) || '"}' WHEN 3 THEN '{"imo": {"value": "", "raw": "second"}}' WHEN 4 THEN props ELSE '{"imo": {"value": null}}' END AS header FROM events"""
RECORDED = """SELECT l.rfq_id, l.line_index, CASE WHEN l.line_index % 2 = 0 THEN '' ELSE l.description END AS verbatim, 'asked: ' || l.description AS query,
    CASE l.l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN lower(s.code) WHEN 2 THEN 'GONE-' || CAST(l.l_partkey AS VARCHAR(10)) ELSE s.code END AS item_code, 'recorded ' || s.description AS item_description, CAST(l.l_partkey % 101 AS BIGINT) AS confidence,
    CASE l.l_partkey % 5 WHEN 0 THEN s.code WHEN 1 THEN lower(s.code) WHEN 2 THEN 'GONE-1' END AS confirmed_item_code
FROM rfq_lines l JOIN catalog_rows s ON s.position = l.l_partkey"""
SHORTLISTED = """SELECT l.rfq_id, l.line_index, k.rank, CASE WHEN k.rank = 2 AND l.line_index % 2 = 0 THEN s.code ELSE s.code || 'X' END AS item_code, CAST(l.l_suppkey % 100 AS BIGINT) AS confidence
FROM rfq_lines l JOIN catalog_rows s ON s.position = l.l_partkey CROSS JOIN (SELECT 1 AS rank UNION ALL SELECT 2 UNION ALL SELECT 3) k"""
QUOTED = "SELECT o_orderkey AS rfq_id, o_orderdate AS approved_at, o_orderkey % 2 = 0 AS taxed FROM orders"
# Batches that replace parts of records: the lines of an order's second batch stand, one order in ten is emptied.
PART_NOW = "SELECT rfq_id AS email_id, line_index AS ord, description AS part FROM rfq_lines"
PART_NEW = """SELECT rfq_id AS email_id, CAST(1 AS BIGINT) AS batch_no, line_index AS ord, 'first ' || description AS part FROM rfq_lines WHERE rfq_id % 3 = 0
UNION ALL SELECT rfq_id, 2, line_index, 'second ' || description FROM rfq_lines WHERE rfq_id % 6 = 0 AND line_index % 2 = 1
UNION ALL SELECT o_orderkey, 3, NULL, NULL FROM orders WHERE o_orderkey % 30 = 0"""
FILES = """SELECT rfq_id AS email_id, line_index AS ord, CASE l_suppkey % 7 WHEN 0 THEN 'C:\\\\temp\\\\' || description || '.xlsx' WHEN 1 THEN '../a?b.pdf' WHEN 2 THEN 'A_b.pdf' WHEN 3 THEN 'a_b (2).pdf' WHEN 4 THEN ' ..' WHEN 5 THEN 'body.txt' ELSE 'Attachment' END AS filename FROM rfq_lines"""
NOTED = """SELECT rfq_id AS email_id, line_index AS ord, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE description END AS data, CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN CAST(0 AS BIGINT) ELSE l_partkey END AS size_bytes, l_suppkey % 5 = 0 AS is_reference FROM rfq_lines"""
CALLS = """SELECT user_id AS email_id, CAST(floor(value * 10) AS BIGINT) AS ms, CASE WHEN event_type = 'error' THEN NULL ELSE event_id END AS input_tokens, CASE WHEN event_type = 'view' THEN NULL ELSE event_id % 100 END AS output_tokens FROM events"""


# --- jobs -----------------------------------------------------------------------------------------------------------------

def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) if k == "int" else F.col(n) for n, k in df.dtypes])


def _records(t: Inputs) -> DataFrame:
    return t.sql(RECORDS).withColumn("labels", F.array("label", F.lit("Checked")))


def listed(t: Inputs) -> DataFrame:
    page = g.list_quotes(_records(t), search=" LABEL m", page=3, page_size=20)
    return page.select("record_id", "customer", "label", "total")


def listed_far_back(t: Inputs) -> DataFrame:
    """Three pages of one directory of small ranges: the first, one across two ranges, and the last."""
    directory = g.page_directory(_records(t), "label", range_rows=64)
    total = directory.ranges.agg(F.max("total")).first()[0]
    shown = [g.read_page(directory, page, 30).withColumn("page", F.lit(page).cast("long")) for page in (1, 3, -(-total // 30))]
    return reduce(DataFrame.unionByName, shown).select("page", "record_id", "customer", "total")


def statuses(t: Inputs) -> DataFrame:
    return t.sql(RECORDS).select(
        "record_id", g.quote_status(F.col("outcome"), F.col("category")).alias("status"),
        g.quote_priority(F.col("priority")).alias("priority"),
    )


def details(t: Inputs) -> DataFrame:
    return g.rfq_detail_lines(t.sql(RECORDED), t.sql(SHORTLISTED), codes_of(t))


def header_values(t: Inputs) -> DataFrame:
    return t.sql(HEADERS).select("event_id", g.header_value(F.col("header"), "imo").alias("imo"))


def _confirmed(t: Inputs) -> DataFrame:
    return g.confirm_lines(t.sql(ACTIONS), t.rfq_lines, codes_of(t))


def confirmations(t: Inputs) -> DataFrame:
    return _longs(_confirmed(t).select("rfq_id", "line_index", "ord", "stored_code", "status"))


def settled(t: Inputs) -> DataFrame:
    return g.final_confirmations(_confirmed(t))


def inquiries(t: Inputs) -> DataFrame:
    rfqs = t.orders.select(F.col("o_orderkey").alias("rfq_id"))
    return _longs(g.record_inquiries(t.sql(LETTERS), rfqs, t.sql(EXISTING)))


def _offered(t: Inputs) -> DataFrame:
    return g.record_offers(t.sql(OFFERS), t.rfq_lines, t.sql(ASKED))


def offers(t: Inputs) -> DataFrame:
    return _longs(_offered(t).select("rfq_id", "line_index", "ord", "status"))


def offers_now(t: Inputs) -> DataFrame:
    return g.final_offers(_offered(t))


def approvals(t: Inputs) -> DataFrame:
    out = g.approve_pricing(t.sql(APPROVALS), t.sql(PRICES), t.rfq_lines)
    return _longs(out.select("rfq_id", "ord", "status", "missing"))


def stepped(t: Inputs, name: str) -> DataFrame:
    """The actions of a kind with their place among all actions."""
    kinds = {"letters": (LETTERS, 0), "letter_lines": (LETTER_LINES, 0), "offers": (OFFERS, 1), "approvals": (APPROVALS, 2), "prices": (PRICES, 2), "confirmations": (ACTIONS, 3)}
    rows, step = kinds[name]
    return t.sql(rows).withColumn("ord", F.col("ord") * 4 + step)


def letters_that_stand(t: Inputs) -> DataFrame:
    rfqs = t.orders.select(F.col("o_orderkey").alias("rfq_id"))
    return g.standing_letters(t.sql(LETTER_LINES), g.record_inquiries(t.sql(LETTERS), rfqs, t.sql(EXISTING)))


def frozen(t: Inputs) -> DataFrame:
    """Letters, offers and approvals in the order they were made, down to the prices frozen."""
    rfqs = t.orders.select(F.col("o_orderkey").alias("rfq_id"))
    judged = g.record_inquiries(stepped(t, "letters"), rfqs, t.sql(EXISTING))
    asked = g.asked_lines(g.standing_letters(stepped(t, "letter_lines"), judged))
    before = t.sql(ASKED_BEFORE).withColumn("asked_ord", F.lit(-1).cast("long"))
    offered = g.record_offers(stepped(t, "offers"), t.rfq_lines, asked.unionByName(before))
    prices = stepped(t, "prices")
    return g.frozen_prices(g.approve_pricing(stepped(t, "approvals"), prices, t.rfq_lines), prices, t.rfq_lines, offered)


def unpriced(t: Inputs) -> DataFrame:
    return g.unpriced_lines(t.sql(APPROVALS), t.sql(PRICES), t.rfq_lines)


def totals_of_lines(t: Inputs) -> DataFrame:
    return g.line_totals(t.rfq_lines).select("rfq_id", "line_index", "total", "discount", "tax", "net")


def quantities(t: Inputs) -> DataFrame:
    said = F.when(F.col("line_index") % 5 == 1, F.concat(F.lit(" "), F.replace("quantity", F.lit(",5"), F.lit(" 000,25")))).when(
        F.col("line_index") % 5 == 2, F.lit("1_000")
    ).when(F.col("line_index") % 5 == 3, F.lit("-4")).otherwise(F.col("quantity"))
    return t.rfq_lines.select("rfq_id", "line_index", g.quantity_number(said).alias("amount"))


def quotations(t: Inputs) -> DataFrame:
    out = g.quotation_totals(g.line_totals(t.rfq_lines), t.sql(QUOTED))
    return out.withColumn("valid_till", F.date_format("valid_till", "yyyy-MM-dd"))


def views_of_lines(t: Inputs) -> DataFrame:
    sheet = t.catalog_rows.select(
        "position", "code", F.col("description").alias("ours"),
        F.create_map(
            F.lit("UOM"), F.lit("EA"), F.lit("Customer  Code"), F.col("customer_code"),
            F.lit("customerdescription"), F.col("customer_description"),
        ).alias("item"),
    )
    lines = t.rfq_lines.select(
        "rfq_id", "line_index", F.when(F.col("uom") == "pcs", F.lit("")).otherwise(F.col("uom")).alias("uom"),
        F.col("l_partkey").alias("position"),
    ).join(sheet, "position").withColumnsRenamed({"code": "item_code", "ours": "item_description"})
    headings = {"uom": "uom", "customer_code": "Customer Code", "customer_description": "Customer Description"}
    return g.quoted_lines(lines, headings)


def assembled(t: Inputs) -> DataFrame:
    emails = t.orders.select(F.col("o_orderkey").alias("email_id"))
    lines = t.rfq_lines.select(F.col("rfq_id").alias("email_id"), "line_index", "description")
    candidates = t.sql(SHORTLISTED).withColumnRenamed("rfq_id", "email_id")
    files = t.sql(FILES)
    letters = t.sql(LETTERS).withColumnRenamed("rfq_id", "email_id").join(emails, "email_id", "left_semi")
    letters = letters.groupBy("email_id", "supplier").agg(F.min("ord").alias("sent")).withColumn(
        "ord", F.substring("supplier", 10, 1).cast("long") + 1
    )
    whole = r.assemble_records(emails, lines, candidates, files, letters)
    return whole.select(
        "email_id", "page_no", F.size(F.coalesce("lines", F.array())).cast("long").alias("lines"),
        F.aggregate(F.coalesce(F.transform("lines", lambda x: F.size(x["candidates"])), F.array().cast("array<int>")), F.lit(0), lambda a, b: a + b).cast("long").alias("candidates"),
        F.size(F.coalesce("files", F.array())).cast("long").alias("files"),
        F.size(F.coalesce("inquiries", F.array())).cast("long").alias("inquiries"),
        F.coalesce(F.col("lines")[0]["description"], F.lit("")).alias("first_line"),
    )


def replaced(t: Inputs) -> DataFrame:
    return r.replace_parts(t.sql(PART_NOW), t.sql(PART_NEW))


def numbered(t: Inputs) -> DataFrame:
    verdicts = t.sql(RECORDS).select(F.col("record_id").alias("email_id"), "is_rfq", "received_at")
    return r.number_rfqs(verdicts, high_water=120)


def keys(t: Inputs) -> DataFrame:
    decision = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "f"), F.lit("-tail"))
    return t.orders.select("o_orderkey", r.record_id(F.col("o_orderdate"), decision).alias("record_id"))


def constraints(t: Inputs) -> DataFrame:
    lines = r.constraint_report(t.lineitem, "order line", ["l_orderkey", "l_linenumber"])
    return lines.unionByName(r.constraint_report(t.orders, "order", ["o_orderkey"])).unionByName(
        r.constraint_report(keys(t), "record id", ["record_id"])
    )


def saved(t: Inputs) -> DataFrame:
    return r.saved_names(t.sql(FILES))


def folded(t: Inputs) -> DataFrame:
    return labelled(r.fold_journal(journal_lines(t), earned_labels(t)))


def journal_lines(t: Inputs) -> DataFrame:
    """The journal, two in three of its delivery lines with the labels they stamped."""
    stamped = F.when(F.col("ord") % 3 > 0, F.array(F.concat(F.lit("stamped "), F.col("ord") % 7), F.lit("sent"))).otherwise(F.array().cast("array<string>"))
    return t.journal.select("ord", "decision_id", "type", "value", F.when(F.col("type") == "delivery", stamped).alias("labels"))


def earned_labels(t: Inputs) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("decision_id"), F.array(F.concat(F.lit("by "), "c_mktsegment")).alias("earned"))


def labelled(folded: DataFrame) -> DataFrame:
    return folded.withColumn("labels", F.array_join("labels", "|"))


def noted(t: Inputs) -> DataFrame:
    files = t.sql(NOTED)
    kept = r.file_notes(files.where("ord % 2 = 1"), keep=True)
    return kept.unionByName(r.file_notes(files.where("ord % 2 = 0"), keep=False)).select("email_id", "ord", "size", "note")


def usage(t: Inputs) -> DataFrame:
    return r.model_usage(t.sql(CALLS))


# --- check SQL ----------------------------------------------------------------------------------------------------------

NUMBER = "CASE WHEN regexp_full_match(replace(replace({x}, ' ', ''), ',', '.'), '[+-]?(\\d+\\.?\\d*|\\.\\d+)') AND try_cast(replace(replace({x}, ' ', ''), ',', '.') AS DECIMAL(24,6)) > 0 THEN try_cast(replace(replace({x}, ' ', ''), ',', '.') AS DECIMAL(24,6)) END"
TOTALS = f"totals_of AS (SELECT rfq_id, line_index, CAST(round(unit_price * {NUMBER.replace('{x}', 'quantity')}, 2) AS DECIMAL(18,2)) AS total FROM rfq_lines)"
OWN = "own AS (SELECT code_key, code, description FROM codes WHERE kind = 0)"
CONFIRMED = f"""{CODES},\n{OWN},
judged AS (SELECT a.*, o.code AS stored_code, CASE WHEN (item_code IS NOT NULL AND o.code IS NULL) OR NOT EXISTS (SELECT 1 FROM rfq_lines l WHERE l.rfq_id = a.rfq_id AND l.line_index = a.line_index) THEN 404 ELSE 204 END AS status
    FROM ({ACTIONS}) a LEFT JOIN own o ON o.code_key = {q.code_key('a.item_code')})"""
INQUIRED = f"""letters AS ({LETTERS}), batches AS (SELECT rfq_id, ord, CAST(sum(n) AS BIGINT) AS letters, max(n) = 1 AS one_each FROM (SELECT rfq_id, ord, supplier, count(*) AS n FROM letters GROUP BY ALL) GROUP BY ALL),
sound AS (SELECT rfq_id, min(ord) AS ord FROM batches WHERE one_each AND rfq_id IN (SELECT o_orderkey FROM orders) AND rfq_id NOT IN ({EXISTING}) GROUP BY ALL)"""
OFFERED = f"""asked AS ({ASKED}), offered AS (SELECT o.*, CASE WHEN NOT clears AND (unit_price <= 0 OR unit_price > 10000000) THEN 422
    WHEN NOT EXISTS (SELECT 1 FROM rfq_lines l WHERE l.rfq_id = o.rfq_id AND l.line_index = o.line_index) THEN 404
    WHEN NOT clears AND NOT EXISTS (SELECT 1 FROM asked l WHERE l.rfq_id = o.rfq_id AND l.line_index = o.line_index) THEN 409 ELSE 204 END AS status FROM ({OFFERS}) o)"""
APPROVED = f"""prices AS ({PRICES}), needed AS (SELECT rfq_id, count(DISTINCT line_index) AS n FROM rfq_lines GROUP BY ALL),
given AS (SELECT rfq_id, ord, count(DISTINCT line_index) AS n, max(unit_price <= 0 OR unit_price > 10000000) AS bad FROM prices GROUP BY ALL),
judged AS (SELECT a.*, coalesce(n.n - coalesce(p.n, 0), 0) AS missing, CASE WHEN margin_stock NOT BETWEEN 0 AND 1000 OR margin_jit NOT BETWEEN 0 AND 1000 OR coalesce(p.bad, true) THEN 422
    WHEN n.n IS NULL THEN 404 WHEN n.n > coalesce(p.n, 0) THEN 422 END AS refused FROM ({APPROVALS}) a LEFT JOIN needed n USING (rfq_id) LEFT JOIN given p USING (rfq_id, ord))"""
# The whole course of the actions: what was asked by then, what was offered by then, what is frozen.
COURSE = f"""{INQUIRED.replace(f"letters AS ({LETTERS})", f"letters AS ({STEPPED['letters']})")},
asked AS (SELECT rfq_id, line_index, min(ord) AS asked_ord FROM (SELECT rfq_id, line_index, ord FROM sound JOIN ({STEPPED['letter_lines']}) x USING (rfq_id, ord)
    UNION ALL SELECT rfq_id, line_index, -1 FROM ({ASKED_BEFORE})) z GROUP BY ALL),
offered AS (SELECT o.*, CASE WHEN NOT clears AND (unit_price <= 0 OR unit_price > 10000000) THEN 422 WHEN NOT EXISTS (SELECT 1 FROM rfq_lines l WHERE l.rfq_id = o.rfq_id AND l.line_index = o.line_index) THEN 404
    WHEN NOT clears AND NOT EXISTS (SELECT 1 FROM asked l WHERE l.rfq_id = o.rfq_id AND l.line_index = o.line_index AND l.asked_ord < o.ord) THEN 409 ELSE 204 END AS status FROM ({STEPPED['offers']}) o),
{APPROVED.replace(f"prices AS ({PRICES})", f"prices AS ({STEPPED['prices']})").replace(f"({APPROVALS})", f"({STEPPED['approvals']})").replace('judged', 'approving')},
taken AS (SELECT * FROM approving WHERE refused IS NULL QUALIFY row_number() OVER (PARTITION BY rfq_id ORDER BY ord) = 1),
stood AS (SELECT o.rfq_id, o.line_index, CASE WHEN NOT clears THEN unit_price END AS offer_unit_price, CASE WHEN NOT clears THEN acted_at END AS offer_received_at FROM offered o JOIN taken a ON a.rfq_id = o.rfq_id AND o.ord < a.ord
    WHERE status = 204 QUALIFY row_number() OVER (PARTITION BY o.rfq_id, o.line_index ORDER BY o.ord DESC) = 1),
frozen AS (SELECT rfq_id, ord, line_index, unit_price, approved_at, margin_stock, margin_jit, offer_unit_price, offer_received_at FROM taken JOIN prices USING (rfq_id, ord) LEFT JOIN stood USING (rfq_id, line_index))"""
SAFE = "regexp_extract(filename, '([^\\\\/]*)$', 1)"
SAFE = f"coalesce(nullif(left(trim(regexp_replace(trim({SAFE}), '[^\\p{{L}}\\p{{N}}_.()\\- ]+', '_', 'g'), '. '), 120), ''), 'attachment')"

FOLDED = """WITH kinds AS (SELECT ord, decision_id, coalesce(type, 'decision') AS type, value FROM journal),
last AS (SELECT decision_id, max_by(value, ord) FILTER (type = 'extraction') AS extraction_value, max_by(value, ord) FILTER (type = 'delivery') AS delivery_value, max(ord) FILTER (type = 'delivery') AS delivery_ord FROM kinds GROUP BY decision_id)
SELECT k.decision_id, k.ord, k.value, extraction_value, delivery_value, CASE WHEN delivery_ord % 3 > 0 THEN 'stamped ' || CAST(delivery_ord % 7 AS VARCHAR) || '|sent' ELSE 'by ' || c.c_mktsegment END AS labels
FROM kinds k JOIN last USING (decision_id) LEFT JOIN customer c ON c.c_custkey = k.decision_id WHERE k.type = 'decision'"""

QUERIES = [
    Query("G1", "list_quotes", listed,
          f"""WITH found AS (SELECT *, count(*) OVER () AS total FROM ({RECORDS}) WHERE is_rfq AND contains(lower(coalesce(customer, '') || ' ' || label || ' Checked'), 'label m'))
SELECT record_id, customer, label, total FROM found ORDER BY received_at DESC, record_id DESC LIMIT 20 OFFSET 40"""),
    Query("G1", "quote_pages", listed_far_back,
          f"""WITH found AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY received_at DESC, record_id DESC) AS n FROM ({RECORDS}) WHERE is_rfq)
SELECT (n - 1) // 30 + 1 AS page, record_id, customer, total FROM found WHERE (n - 1) // 30 + 1 IN (1, 3, (total + 29) // 30)"""),
    Query("G2", "quote_status", statuses,
          f"SELECT record_id, CASE WHEN outcome = 'SENT' THEN 'inProgress' WHEN category = 'CUSTOMER_ORDER_PO' THEN 'order' WHEN category = 'CUSTOMER_CLARIFICATION' THEN 'replyReceived' ELSE 'new' END AS status, CASE WHEN priority = 'URGENT' THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM ({RECORDS})"),
    Query("G3", "rfq_detail_lines", details,
          f"""WITH {CODES},\n{OWN}, recorded AS ({RECORDED}), offered AS ({SHORTLISTED}),
joined AS (SELECT r.*, c.description AS current_description, s.code AS settled_code, s.description AS settled_description, s.code IS NOT NULL AND s.code = r.confirmed_item_code AS settled,
  (SELECT min_by(o.confidence, o.rank) FROM offered o WHERE o.rfq_id = r.rfq_id AND o.line_index = r.line_index AND o.item_code = s.code) AS settled_confidence
  FROM recorded r LEFT JOIN own c ON c.code_key = {q.code_key('r.item_code')} LEFT JOIN own s ON s.code_key = {q.code_key('r.confirmed_item_code')})
SELECT rfq_id, line_index, CASE WHEN verbatim <> '' THEN verbatim ELSE query END AS customer_description, coalesce(CASE WHEN settled THEN settled_code ELSE coalesce(item_code, '') END, '') AS item_code,
  CASE WHEN coalesce(settled, false) THEN settled_description ELSE item_description END AS item_description, CASE WHEN coalesce(settled, false) THEN settled_description ELSE coalesce(current_description, item_description) END AS sheet_description,
  CASE WHEN coalesce(settled, false) THEN settled_confidence ELSE confidence END AS confidence, coalesce(settled, false) AS settled FROM joined"""),
    Query("G4", "header_value", header_values,
          f"""SELECT event_id, coalesce(nullif(json_extract_string(header, '$.imo.value'), ''), nullif(json_extract_string(header, '$.imo.raw'), ''),
  CASE WHEN json_type(header, '$.imo') = 'VARCHAR' THEN json_extract_string(header, '$.imo') END, '') AS imo FROM ({HEADERS})"""),
    Query("G5", "confirm_lines", confirmations, f"WITH {CONFIRMED} SELECT rfq_id, line_index, ord, CASE WHEN item_code IS NOT NULL THEN stored_code END AS stored_code, CAST(status AS BIGINT) AS status FROM judged"),
    Query("G5", "final_confirmations", settled, f"WITH {CONFIRMED} SELECT rfq_id, line_index, CASE WHEN max_by(item_code IS NOT NULL, ord) THEN max_by(coalesce(stored_code, ''), ord) END AS confirmed_item_code FROM judged WHERE status = 204 GROUP BY ALL"),
    Query("G6", "record_inquiries", inquiries, f"WITH {INQUIRED} SELECT b.rfq_id, b.ord, letters, CAST(CASE WHEN s.ord IS NOT NULL THEN 204 ELSE 409 END AS BIGINT) AS status FROM batches b LEFT JOIN sound s ON s.rfq_id = b.rfq_id AND s.ord = b.ord"),
    Query("G6", "standing_letters", letters_that_stand, f"WITH {INQUIRED} SELECT rfq_id, ord, supplier, line_index FROM ({LETTER_LINES}) x JOIN sound USING (rfq_id, ord)"),
    Query("G7", "record_offers", offers, f"WITH {OFFERED} SELECT rfq_id, line_index, ord, CAST(status AS BIGINT) AS status FROM offered"),
    Query("G7", "final_offers", offers_now,
          f"WITH {OFFERED} SELECT rfq_id, line_index, CASE WHEN NOT clears THEN unit_price END AS offer_unit_price, CASE WHEN NOT clears THEN acted_at END AS offer_received_at FROM offered WHERE status = 204 QUALIFY row_number() OVER (PARTITION BY rfq_id, line_index ORDER BY ord DESC) = 1"),
    Query("G8", "approve_pricing", approvals,
          f"WITH {APPROVED}, firsts AS (SELECT rfq_id, min(ord) AS first_ord FROM judged WHERE refused IS NULL GROUP BY ALL) SELECT rfq_id, ord, CAST(coalesce(refused, CASE WHEN ord = first_ord THEN 204 ELSE 409 END) AS BIGINT) AS status, missing FROM judged LEFT JOIN firsts USING (rfq_id)"),
    Query("G8", "frozen_prices", frozen,
          f"WITH {COURSE} SELECT rfq_id, line_index, unit_price AS approved_unit_price, approved_at, margin_stock, margin_jit, offer_unit_price, offer_received_at FROM frozen"),
    Query("G8", "unpriced_lines", unpriced, f"WITH prices AS ({PRICES}), approvals AS ({APPROVALS}) SELECT a.rfq_id, a.ord, l.line_index FROM approvals a JOIN rfq_lines l USING (rfq_id) WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.rfq_id = a.rfq_id AND p.ord = a.ord AND p.line_index = l.line_index)"),
    Query("G9", "quantity_number", quantities,
          "SELECT rfq_id, line_index, " + NUMBER.replace("{x}", "(CASE line_index % 5 WHEN 1 THEN ' ' || replace(quantity, ',5', ' 000,25') WHEN 2 THEN '1_000' WHEN 3 THEN '-4' ELSE quantity END)") + " AS amount FROM rfq_lines"),
    Query("G10", "line_totals", totals_of_lines, f"WITH {TOTALS} SELECT rfq_id, line_index, total, CAST(0 AS DECIMAL(12,2)) AS discount, CAST(total * 0 AS DECIMAL(18,2)) AS tax, total AS net FROM totals_of"),
    Query("G11", "quotation_totals", quotations,
          f"""WITH {TOTALS}, sums AS (SELECT rfq_id, sum(total) AS s FROM totals_of GROUP BY ALL)
SELECT z.rfq_id, CAST(coalesce(s, 0) AS DECIMAL(18,2)) AS subtotal, CASE WHEN taxed THEN CAST(0 AS DECIMAL(18,2)) END AS vat, CAST(coalesce(s, 0) AS DECIMAL(18,2)) AS grand_total, strftime(CAST(approved_at AS DATE) + 30, '%Y-%m-%d') AS valid_till, CAST(0 AS DECIMAL(18,2)) AS book_discount FROM ({QUOTED}) z LEFT JOIN sums USING (rfq_id)"""),
    Query("G12", "quoted_lines", views_of_lines,
          """SELECT rfq_id, line_index, CASE WHEN uom = 'pcs' THEN 'EA' ELSE uom END AS uom, v.view, CASE v.view WHEN 'customer' THEN s.customer_code ELSE s.code END AS code, CASE v.view WHEN 'customer' THEN s.customer_description ELSE s.description END AS description,
  CASE v.view WHEN 'book' THEN s.customer_code ELSE '' END AS second_code, CASE v.view WHEN 'book' THEN s.customer_description ELSE '' END AS second_description FROM rfq_lines l JOIN catalog_rows s ON s.position = l.l_partkey, (VALUES ('ours'), ('customer'), ('book')) v(view)"""),
    Query("G13", "assemble_records", assembled,
          f"""WITH counted AS (SELECT rfq_id AS email_id, count(*) AS n, min_by(description, line_index) AS first_line FROM rfq_lines GROUP BY ALL), letters_of AS (SELECT rfq_id AS email_id, count(DISTINCT supplier) AS n FROM ({LETTERS}) GROUP BY ALL)
SELECT o_orderkey AS email_id, CAST(0 AS BIGINT) AS page_no, coalesce(c.n, 0) AS lines, coalesce(c.n * 3, 0) AS candidates, coalesce(c.n, 0) AS files, coalesce(l.n, 0) AS inquiries, coalesce(first_line, '') AS first_line
FROM orders LEFT JOIN counted c ON c.email_id = o_orderkey LEFT JOIN letters_of l ON l.email_id = o_orderkey"""),
    Query("G14", "replace_parts", replaced,
          f"""WITH incoming AS ({PART_NEW}), latest AS (SELECT email_id, max(batch_no) AS batch_no FROM incoming GROUP BY ALL)
SELECT email_id, ord, part FROM ({PART_NOW}) WHERE email_id NOT IN (SELECT email_id FROM latest) UNION ALL SELECT email_id, ord, part FROM incoming JOIN latest USING (email_id, batch_no) WHERE ord IS NOT NULL"""),
    Query("G15", "number_rfqs", numbered, f"SELECT record_id AS email_id, printf('RFQ-%04d', 120 + row_number() OVER (ORDER BY received_at, record_id)) AS rfq_reference FROM ({RECORDS}) WHERE is_rfq"),
    Query("G16", "record_keys", keys, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') || '__' || left(lpad(CAST(o_custkey AS VARCHAR), 10, 'f'), 8) AS record_id FROM orders"),
    Query("G16", "constraint_report", constraints,
          """SELECT 'order line' AS "constraint", CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key, count(*) AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'record id', id, count(*) FROM (SELECT strftime(o_orderdate, '%Y-%m-%dT%H-%M-%SZ') || '__' || left(lpad(CAST(o_custkey AS VARCHAR), 10, 'f'), 8) AS id FROM orders) GROUP BY id HAVING count(*) > 1"""),
    Query("G16", "safe_names", lambda t: t.sql(FILES).select("email_id", "ord", r.safe_name(F.col("filename")).alias("safe")), f"SELECT email_id, ord, {SAFE} AS safe FROM ({FILES.replace(chr(92) * 2, chr(92))})"),
    # One file after the other, each with all names taken before it.
    Query("G17", "saved_names", saved,
          f"""WITH RECURSIVE named AS (SELECT email_id, ord, filename, {SAFE} AS safe, row_number() OVER (PARTITION BY email_id ORDER BY ord) AS n FROM ({FILES.replace(chr(92) * 2, chr(92))})),
parted AS (SELECT *, CASE WHEN contains(safe, '.') THEN regexp_extract(safe, '^(.*)\\.[^.]*$', 1) ELSE '' END AS stem, regexp_extract(safe, '[^.]*$') AS ending FROM named),
one_by_one AS (SELECT email_id, CAST(0 AS BIGINT) AS n, ['body.txt', 'email.json'] AS taken, CAST(NULL AS BIGINT) AS ord, '' AS filename, '' AS saved_as FROM (SELECT DISTINCT email_id FROM named)
  UNION ALL SELECT email_id, n, list_append(taken, lower(saved_as)), ord, filename, saved_as FROM (SELECT p.email_id, p.n, taken, p.ord, p.filename,
    list_filter(list_transform(range(1, len(taken) + 2), lambda k: CASE WHEN k = 1 THEN safe WHEN stem <> '' THEN stem || ' (' || k || ').' || ending ELSE safe || ' (' || k || ')' END), lambda x: NOT list_contains(taken, lower(x)))[1] AS saved_as
    FROM one_by_one o JOIN parted p ON p.email_id = o.email_id AND p.n = o.n + 1) z)
SELECT email_id, ord, filename, saved_as FROM one_by_one WHERE n > 0"""),
    Query("G18", "fold_journal", folded, FOLDED),
    Query("G19", "file_notes", noted,
          f"""SELECT email_id, ord, CASE WHEN coalesce(size_bytes, 0) > 0 THEN size_bytes ELSE coalesce(strlen(data), 0) END AS size,
  CASE WHEN is_reference THEN '{r.A_LINK}' WHEN data IS NULL THEN '{r.DOWNLOAD_FAILED}' WHEN ord % 2 = 0 THEN '{r.NOT_KEPT}' END AS note FROM ({NOTED})"""),
    Query("G20", "model_usage", usage,
          f"SELECT email_id, count(*) AS calls, CAST(sum(coalesce(ms, 0)) AS BIGINT) AS ms, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens FROM ({CALLS}) GROUP BY email_id"),
]
