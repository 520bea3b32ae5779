"""Message text, rules and routing, sources over documents, conversations, pages and made mails (survey 2.A-2.C)."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.functions import text as x
from quoteflow.operators import messages as m
from quoteflow.operators import routing as o
from quoteflow.plans.base import Inputs, Query
from quoteflow.sources import files as s
from quoteflow.sources.store import shared_folder, stored

OWN = ["own.example"]
REGISTRY = [
    ("system_sender", "C5@own.example"), ("own", "Own.example"), ("portal", "portal.example"),
    ("customer", "customer.example"), ("customer", "supplier.example"), ("supplier", "supplier.example"),
]
PORTALS = [("ShipPortal", ["portal.example"])]
PORTAL_MARKERS = [("Mailer", ["Portal Mail Tool"]), ("Late", ["portal"])]
TEMPLATE_MARKERS = [("greeting", ["dear ALL"]), ("never", ["no such words"]), ("signing", ["kind regards", "yours"])]
# Rules that fire on the test texts; the reference's own rules are the defaults and run in the tests.
LICENSE_LINES = [("apache_line", r"(?i)^\s*Licensed under the Apache\b"), ("rights_line", r"(?i)^All rights reserved\.")]
LICENSE_TAILS = [("mit_tail", r"(?i)Released under the MIT"), ("gpl_tail", r"(?i)GNU General Public License")]
TEXT_SIGN_OFF = r"^\S+ \S+\.$"
TEXT_VALUES = r"(?i)@|\btoken\b"
TEXT_SIGNALS = {
    "mail": r"([a-z]+\.\d+@mail\d\.[a-z]+\.com)",
    "number": r"\b(\d{4,})\b",
    "license": r"Licensed under ([A-Za-z][A-Za-z -]{3,40})|Released under the ([A-Z]{2,5}) License",
}
TEXT_MARKS = r"(?i)\b(version|rights|reserved|card|license)\b"
REGIONS = [
    ("africa", {"ports": ["kenya", "morocco"], "keywords": ["africa", "u.a.e."], "mailbox": ["af"]}),
    ("america", {"ports": ["canada", "peru", "brazil"], "keywords": ["america", "household"], "mailbox": ["am", "usa"]}),
    ("asia", {"ports": ["india", "china", "kenya"], "keywords": ["asia", "machinery"], "mailbox": ["as"]}),
]
ACTION_LABELS = [
    ("FORWARD_TO_DST", "RFQ"), ("ROUTE_TO_CS", "Review"), ("ROUTE_TO_SOURCING", "Review"),
    ("ROUTE_TO_ORDER_TEAM", "Review"), ("HUMAN_REVIEW", "Review"), ("IGNORE", "No action"),
]
OUR_LABELS = ["RFQ", "Review", "No action", "Not Sent", "Error"]

# --- jobs ---------------------------------------------------------------------------------------------------------------


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) if k == "int" else F.col(n) for n, k in df.dtypes])


def _place(t: Inputs, label: str) -> str:
    return f"{shared_folder(t.spark)}/quoteflow/{label}-{uuid.uuid4().hex}"


def normalised(t: Inputs) -> DataFrame:
    rough = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit(" \t\r\n")), F.lit("\r\r\n \n\n end ﬁn "))
    return t.documents.select("doc_id", x.normalize_text(rough).alias("text"))


def headers(t: Inputs) -> DataFrame:
    cut = t.mails.select("message_id", x.split_headers(F.col("raw_text")).alias("p"))
    h = F.col("p.headers")
    return cut.select(
        "message_id", *[F.try_element_at(h, F.lit(k)).alias(f"h_{k}") for k in ("from", "to", "cc", "subject", "attachments")],
        F.size(h).cast("long").alias("headers"), F.length("p.body").cast("long").alias("body_chars"),
    )


def addresses(t: Inputs) -> DataFrame:
    cut = t.mails.select("message_id", x.split_headers(F.col("raw_text")).alias("p"))
    who = F.concat_ws(", ", F.col("p.headers")["from"], F.col("p.headers")["to"], F.col("p.headers")["cc"])
    people = cut.select("message_id", F.posexplode(x.parse_addresses(who)).alias("ord", "one"))
    return _longs(people.select(
        "message_id", "ord", "one.name", "one.address", x.address_domain(F.col("one.address")).alias("domain")
    ))


def attachments(t: Inputs) -> DataFrame:
    listed = F.format_string("E_QUOT_%d.XLS, image%03d.png,, e_quot.pdf , My E_QUOT.xlsx", "p_partkey", F.col("p_partkey") % 1000)
    named = t.part.select("p_partkey", "p_retailprice", F.posexplode(x.parse_attachments(listed)).alias("ord", "file"))
    sized = x.classify_attachment(F.col("file.filename"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") * 100))
    return _longs(named.select("p_partkey", "ord", "file.filename", "file.kind", sized.alias("kind_with_size")))


def page_texts(t: Inputs) -> DataFrame:
    plain = F.when(F.col("page_id") % 5 == 0, F.lit(" plain part ")).when(F.col("page_id") % 5 == 1, F.lit("  "))
    return t.pages.select("page_id", x.body_to_text(plain, F.col("html")).alias("text"))


def threads(t: Inputs) -> DataFrame:
    bodies = t.threads.select(F.col("conv_id").alias("id"), "body").unionByName(
        t.mails.select((-1 - F.col("message_id")).alias("id"), F.col("raw_text").alias("body"))
    )
    cut = bodies.select("id", x.split_thread(F.col("body")).alias("th"))
    return cut.select(
        "id", F.col("th.latest").alias("latest"), F.size("th.quoted").cast("long").alias("quoted"),
        F.array_join(F.transform("th.quoted", lambda one: F.concat_ws("~", one["from_address"], one["sent_at"], one["subject"])), "|").alias("heads"),
        F.coalesce(F.try_element_at("th.quoted", F.lit(-1))["raw"], F.lit("")).alias("last_raw"),
        F.array_join("th.warnings", "|").alias("warnings"),
    )


def stripped(t: Inputs) -> DataFrame:
    out = x.strip_boilerplate(F.col("text"), LICENSE_LINES, LICENSE_TAILS, TEXT_SIGN_OFF, TEXT_VALUES)
    return t.documents.select("doc_id", out.alias("c")).select("doc_id", "c.text", F.array_join("c.applied", "|").alias("applied"))


def text_signals(t: Inputs) -> DataFrame:
    found = t.documents.select("doc_id", x.extract_signals(F.col("text"), TEXT_SIGNALS, TEXT_MARKS).alias("s"))
    return found.select("doc_id", "s.mail", "s.number", "s.license", F.array_join("s.urgency_markers", "|").alias("marks"))


def mail_signals(t: Inputs) -> DataFrame:
    found = t.mails.select("message_id", x.extract_signals(F.col("raw_text")).alias("s"))
    return found.select(
        "message_id", "s.imo", "s.vessel_name", "s.rfq_reference", "s.delivery_port", "s.eta", "s.quote_due_date",
        F.array_join("s.urgency_markers", "|").alias("marks"),
    )


def prefixes(t: Inputs) -> DataFrame:
    subject = F.concat(
        F.when(F.col("conv_id") % 3 == 0, "RE: ").when(F.col("conv_id") % 3 == 1, " fw :[UPDATED] Fwd:").otherwise(""),
        F.when(F.col("turn") % 2 == 0, "re:").otherwise(""), F.col("text"),
    )
    return t.conversations.select("conv_id", "turn", F.array_join(x.subject_prefixes(subject), "|").alias("prefixes"))


def _parsed(t: Inputs) -> DataFrame:
    raw = t.mails.select("message_id", "o_custkey", "raw_text")
    return t.kept("parsed", lambda: stored(m.parse_raw_messages(raw), "parsed"))


def _newest(t: Inputs) -> DataFrame:
    return t.kept("newest", lambda: stored(m.newest_messages(_parsed(t)), "newest"))


def parsed(t: Inputs) -> DataFrame:
    out = m.parse_raw_messages(t.mails.select("message_id", "raw_text"))
    return out.select(
        "message_id", F.col("sender.address").alias("sender"), "subject", F.size("to").cast("long").alias("to_count"),
        F.size("cc").cast("long").alias("cc_count"), F.size("attachments").cast("long").alias("files"),
        F.array_join("warnings", "|").alias("warnings"),
    )


def corpus(t: Inputs) -> DataFrame:
    threads = t.threads.select("conv_id", "body")
    newest = m.newest_messages(
        threads, line_rules=LICENSE_LINES, tail_rules=LICENSE_TAILS, sign_off=TEXT_SIGN_OFF, value_bearing=TEXT_VALUES
    )
    return m.removed_share(newest)


def parts(t: Inputs) -> DataFrame:
    pages = t.conversations.select("conv_id", F.col("turn").alias("page_no"), F.repeat("text", F.lit(1) + (F.col("turn") % 4).cast("int")).alias("text"))
    cut = m.chunk_parts(pages, "conv_id")
    tails = m.part_tails(cut, "conv_id")
    return _longs(cut.join(tails, ["conv_id", "part_no"], "left").select(
        "conv_id", "page_no", "part_no", F.length("text").alias("chars"), F.length(F.coalesce("tail", F.lit(""))).alias("tail_chars")
    ))


def images(t: Inputs) -> DataFrame:
    return m.image_parts(t.rfq_lines.select("rfq_id", F.col("line_index").alias("image_no")))


def truncated(t: Inputs) -> DataFrame:
    return t.documents.select("doc_id", x.truncate_middle(F.col("text"), 300).alias("text"))


def history(t: Inputs) -> DataFrame:
    turns = t.conversations.select("conv_id", (F.lit(1000) - F.col("turn")).alias("ord"), "role")
    return _longs(m.recent_history(turns, "conv_id", shown=3).select("conv_id", "ord", "role", "number", "omitted"))


def _people(t: Inputs) -> DataFrame:
    both = F.transform(F.concat("to", "cc"), lambda one: one["address"])
    return _newest(t).select(
        "message_id", F.col("sender.address").alias("address"), both.alias("recipients"), "subject", "body",
        F.col("newest"), "attachments", F.size("attachments").alias("attachment_count"), "quoted_count",
    )


def _registry(t: Inputs) -> DataFrame:
    return t.spark.createDataFrame(REGISTRY, "kind string, entry string")


def senders(t: Inputs) -> DataFrame:
    return o.classify_sender(_people(t), _registry(t)).select("message_id", "domain", "sender_class")


def portals(t: Inputs) -> DataFrame:
    people = _people(t)
    return people.select(
        "message_id",
        o.find_portal(x.address_domain(F.col("address")), F.col("newest"), PORTALS, PORTAL_MARKERS).alias("portal"),
        F.array_join(o.matching_markers(F.col("newest"), TEMPLATE_MARKERS), "|").alias("markers"),
        o.recipients_internal_only(F.col("recipients"), OWN).alias("internal_only"),
    )


def quoted(t: Inputs) -> DataFrame:
    bodies = t.mails.select("message_id", F.col("raw_text").alias("body"))
    out = m.quoted_messages(bodies, "message_id")
    return _longs(out.select("message_id", "ord", "raw", "from_address", "sent_at", "subject"))


def _hints(t: Inputs) -> DataFrame:
    return o.build_hints(_people(t), _registry(t), PORTALS, PORTAL_MARKERS, TEMPLATE_MARKERS, OWN)


def asked(t: Inputs) -> DataFrame:
    return o.to_be_asked(o.fast_path(_people(t), OWN)).select("message_id")


def policy_of_messages(t: Inputs) -> DataFrame:
    """Verdicts on messages whose own hints, not the answer, say whether they look like a request and are urgent."""
    answered = t.verdicts.select(F.col("email_id").alias("message_id"), "category", "confidence", "answered_is_rfq", "priority")
    drafts = _hints(t).select("message_id", "signals", "attachment_kinds").join(answered, "message_id")
    out = o.finalize_policy(drafts.withColumn("decision_path", F.lit("LLM")))
    return out.select(
        "message_id", "recommended_action", "needs_human_review", "priority", "decision_path", F.array_join("rule_hits", "|").alias("hits")
    )


def hints(t: Inputs) -> DataFrame:
    out = _hints(t)
    return out.select(
        "message_id", "sender_class", "portal", "recipients_internal_only", "is_reply", F.array_join("subject_prefixes", "|").alias("prefixes"),
        F.array_join("attachment_kinds", "|").alias("kinds"), "signals.vessel_name", "signals.rfq_reference",
    )


def decided(t: Inputs) -> DataFrame:
    return o.fast_path(_people(t), OWN).select("message_id", "rule", "category", "direction", "confidence")


def policy(t: Inputs) -> DataFrame:
    drafts = t.verdicts.withColumns(
        {
            "decision_path": F.when(F.col("email_id") % 3 == 0, "RULES_FAST_PATH").otherwise("LLM"),
            "urgent": F.col("email_id") % 19 == 0,
            "confidence": F.col("confidence") * 1.2 - 0.1,
        }
    )
    out = o.finalize_policy(drafts)
    return out.select(
        "email_id", "is_rfq", "recommended_action", "requires_action", "needs_human_review",
        F.round("confidence", 6).alias("confidence"), "priority", "decision_path", F.array_join("rule_hits", "|").alias("hits"),
    )


def labels(t: Inputs) -> DataFrame:
    action = F.coalesce(*[F.when(F.col("category") == one, act) for one, act in o.CATEGORY_ACTION])
    routed = o.outlook_labels(action, F.col("confidence") < 0.3, ACTION_LABELS, "Review")
    marked = F.when(F.col("email_id") % 2 == 0, o.plus_label(o.plus_label(routed, "Not Sent"), "Not Sent")).otherwise(routed)
    return t.verdicts.select("email_id", F.array_join(marked, "|").alias("labels"))


ROUTED = """SELECT o.o_orderkey AS email_id, CASE WHEN o.o_orderkey % 9 = 0 THEN ' ' || r.r_name || ' ' WHEN o.o_orderkey % 9 = 1 THEN 'nowhere' END AS hint, CASE WHEN o.o_orderkey % 4 <> 0 THEN 'Port of ' || n.n_name END AS port,
    'Stores for ' || lower(c.c_mktsegment) || CASE o.o_orderkey % 6 WHEN 0 THEN ', U.A.E. only' WHEN 1 THEN ' in africa' WHEN 2 THEN ' in asiatic style' ELSE '' END AS body,
    CASE o.o_orderkey % 5 WHEN 0 THEN 'desk.usa@own.example' WHEN 1 THEN 'rfq-as@own.example' ELSE 'rfq@own.example' END AS mailbox
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"""


def regions(t: Inputs) -> DataFrame:
    found = o.resolve_region(REGIONS, F.col("hint"), F.col("port"), F.col("body"), F.col("mailbox"))
    return t.sql(ROUTED).select("email_id", found.alias("r")).select("email_id", "r.region", "r.rule")


DELIVERIES = """SELECT email_id, confidence < 0.3 AS needs_human_review, CASE WHEN email_id % 3 = 0 THEN NULL ELSE 'uae' END AS verdict_region, CASE WHEN email_id % 5 = 0 THEN 'sg' END AS header_region,
    CASE WHEN email_id % 7 = 0 THEN '' WHEN email_id % 11 = 0 THEN NULL ELSE 'desk@own.example' END AS forward_to, email_id % 4 <> 1 AS sent FROM verdicts"""


def deliveries(t: Inputs) -> DataFrame:
    on = o.delivery_outcome(t.sql(DELIVERIES)).select("email_id", "outcome", "region", "not_sent_label")
    off = o.delivery_outcome(t.sql(DELIVERIES), enabled=False).groupBy("outcome").agg(F.count(F.lit(1)).alias("email_id"))
    return on.unionByName(off.select(-F.col("email_id"), "outcome", F.lit(None).cast("string"), F.lit(False)).toDF("email_id", "outcome", "region", "not_sent_label"))


def handled(t: Inputs) -> DataFrame:
    tags = F.array(F.when(F.col("o_orderkey") % 5 == 0, "Not Sent").otherwise("Blue"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", o.already_handled(tags, OUR_LABELS).alias("handled"))


PICTURES = """SELECT CASE WHEN rfq_id % 5 = 0 THEN rfq_id - rfq_id % 25 ELSE rfq_id END AS email_id, rfq_id * 1000 + line_index AS ord, l_suppkey % 5 * (l_partkey % 3) AS images FROM rfq_lines"""
SIZES = """SELECT rfq_id - rfq_id % 4 AS email_id, rfq_id * 1000 + line_index AS ord, l_partkey * l_suppkey * 997 % 30000000 AS size_bytes, l_suppkey % 4 = 0 AS is_inline, l_partkey % 13 = 0 AS is_reference, l_partkey % 17 <> 0 AS has_bytes FROM rfq_lines
UNION ALL SELECT rfq_id - rfq_id % 4, rfq_id * 1000 + 500 + line_index, l_suppkey % 5 * 6000, true, false, true FROM rfq_lines"""


def pictures(t: Inputs) -> DataFrame:
    return o.image_budget(t.sql(PICTURES)).select("email_id", "ord", "images_kept", "images_truncated")


def sizes(t: Inputs) -> DataFrame:
    return o.attachment_budget(t.sql(SIZES)).select("email_id", "ord", "blocked")


def sheet(t: Inputs) -> DataFrame:
    """The catalogue written as CSV text and read back: codes keep their zeros, blanks become ''."""
    folder = _place(t, "sheet")
    rows = t.catalog_rows.select(
        F.col("position").alias("No"), F.format_string("00%s", "code").alias("Item Code"),
        F.concat(F.lit(' "'), "description", F.lit('" \nnew ')).alias("Item Description"),
        F.when(F.col("customer_code") != "", F.col("customer_code")).alias("Customer Code"), F.lit("x").alias(" "),
    )
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(folder)
    read = s.read_catalog_csv(t.spark, folder)
    return read.withColumnsRenamed({"No": "no", "Item Code": "code", "Item Description": "description", "Customer Code": "customer_code"})


def snapshot(t: Inputs) -> DataFrame:
    return s.publish_snapshot(_sheet(t), _place(t, "snapshots")).select("rows", "items", "sha256")


def _sheet(t: Inputs) -> DataFrame:
    """The list with some codes blank and some descriptions missing: rows that are kept and cannot be looked up."""
    return t.sql(SHEET).repartition(3)


def _journal_file(t: Inputs) -> str:
    folder = _place(t, "journal")
    lines = t.journal.select("ord", "decision_id", "type", "value", F.lit(None).cast("string").alias("note"))
    s.append_journal(lines.where("ord % 2 = 0"), folder)
    s.append_journal(lines.where("ord % 2 = 1"), folder)
    t.spark.createDataFrame([("",)], "value string").write.mode("append").text(folder)
    return folder


def journal_lines(t: Inputs) -> DataFrame:
    return s.read_journal(t.spark, _journal_file(t), "ord long, decision_id long, type string, value double")


def redacted(t: Inputs) -> DataFrame:
    out = s.redact(t.documents.select("doc_id", F.col("text").alias("body"), "source"), keep_bodies=False)
    kept = s.redact(t.documents.where("doc_id % 2 = 0").select("doc_id", F.col("text").alias("body"), "source"), keep_bodies=True)
    return _longs(out.select("doc_id", "source", "body_sha256", "body_chars", "body_text").unionByName(
        kept.select(-F.col("doc_id") - 1, "source", "body_sha256", "body_chars", "body_text").toDF("doc_id", "source", "body_sha256", "body_chars", "body_text")
    ))


MAGIC = """SELECT doc_id, text, CASE doc_id % 12 WHEN 0 THEN '504B0304' WHEN 1 THEN 'D0CF11E0A1B11AE1' WHEN 2 THEN '0A255044462D312E34' WHEN 3 THEN 'FFD8FFE0' WHEN 4 THEN '000000186674797068656963' WHEN 5 THEN '526966660000000057454250'
    WHEN 6 THEN '377ABCAF271C' WHEN 7 THEN '00' WHEN 8 THEN '612C622C630A312C322C330A' WHEN 9 THEN '5375626A6563743A20780A' ELSE '' END AS magic, CASE WHEN doc_id % 12 = 10 THEN 'list.CSV' WHEN doc_id % 24 = 11 THEN 'a.txt' ELSE 'noending' END AS filename,
    CASE WHEN doc_id % 36 = 23 THEN 'text/CSV' ELSE '' END AS content_type FROM documents"""


def kinds(t: Inputs) -> DataFrame:
    body = F.when(F.col("doc_id") % 12 == 8, F.lit("")).otherwise(F.col("text"))
    content = F.concat(F.unhex("magic"), F.encode(body, "UTF-8"))
    made = t.sql(MAGIC).select("doc_id", "filename", "content_type", content.alias("content"))
    pages = t.pages.select((-1 - F.col("page_id")).alias("doc_id"), F.lit("p").alias("filename"), F.lit("").alias("content_type"), F.encode("html", "UTF-8").alias("content"))
    return s.attachment_kinds(made.unionByName(pages)).select("doc_id", "kind")


def list_cells(t: Inputs) -> DataFrame:
    return _longs(s.html_cells(t.pages, "page_id", "ul", "li", "a"))


def nested_cells(t: Inputs) -> DataFrame:
    """A page for each request: a table of its lines, in it one for each line, and in that one another; little is closed."""
    line = F.format_string(
        '<TR class="r"><td>%s<td>%s<table><tbody><tr><td>%s</td><td width=1>u:<!-- <table> --><table><td>%s</table>&amp;<b>%s</b></table> left</tr>',
        "description", "quantity", "source", "uom", "line_index",
    )
    rows = t.rfq_lines.groupBy("rfq_id").agg(F.array_sort(F.collect_list(F.struct("line_index", line.alias("tr")))).alias("rows"))
    head = "<p>a</p></table><table><thead><tr><th>Item</th><th> Qty &amp; unit</thead>"
    body = F.array_join(F.transform("rows", lambda one: one["tr"]), "\n")
    return _longs(s.html_cells(rows.select("rfq_id", F.concat(F.lit(head), body, F.lit("</table><td>lost")).alias("html")), "rfq_id"))


SHEET = """SELECT position, CASE WHEN position % 9 = 0 THEN '  ' ELSE code END AS code, CASE WHEN position % 13 = 0 THEN NULL ELSE description END AS description, customer_code, customer_description FROM catalog_rows"""

# --- check SQL ----------------------------------------------------------------------------------------------------------

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip_sql(text: str) -> str:
    return STRIP.replace("{x}", text)


def quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


HEADER_KEYS = ", ".join(f"'{k}'" for k in x.HEADER_KEYS)
HEAD = f"""lines AS (SELECT message_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS n FROM mails),
keyed AS (SELECT *, lower(trim(regexp_extract(line, {quote(x.HEADER_LINE)}, 1))) IN ({HEADER_KEYS}) AS is_header, lower(trim(regexp_extract(line, {quote(x.HEADER_LINE)}, 1))) AS key,
    trim(regexp_extract(line, {quote(x.HEADER_LINE)}, 2)) AS value, trim(line) = '' OR regexp_matches(line, {quote(x.CAUTION)}) AS skipped FROM lines),
tops AS (SELECT message_id, min(n) FILTER (NOT skipped) AS top FROM keyed GROUP BY ALL),
ends AS (SELECT k.message_id, any_value(top) AS top, coalesce(min(n) FILTER (n >= top AND NOT is_header), max(n) + 1) AS stop FROM keyed k JOIN tops USING (message_id) GROUP BY ALL),
block AS (SELECT k.message_id, key, max_by(value, n) AS value FROM keyed k JOIN ends e USING (message_id) WHERE n >= top AND n < stop GROUP BY ALL),
heads AS (SELECT message_id, max(value) FILTER (key = 'from') AS h_from, max(value) FILTER (key = 'to') AS h_to, max(value) FILTER (key = 'cc') AS h_cc, max(value) FILTER (key = 'subject') AS h_subject,
    max(value) FILTER (key = 'attachments') AS h_attachments, count(*) AS headers FROM block GROUP BY ALL HAVING count(*) FILTER (key = 'from') > 0),
bodies AS (SELECT k.message_id, {strip_sql("string_agg(line, chr(10) ORDER BY n) FILTER (n >= stop)")} AS body FROM keyed k JOIN ends USING (message_id) GROUP BY ALL),
split AS (SELECT m.message_id, h_from, h_to, h_cc, h_subject, h_attachments, coalesce(headers, 0) AS headers, CASE WHEN headers IS NULL THEN raw_text ELSE coalesce(body, '') END AS body
    FROM mails m LEFT JOIN heads USING (message_id) LEFT JOIN bodies USING (message_id))"""
PERSON = """CASE WHEN regexp_extract(e, '<\\s*([^<>\\s]+)\\s*>', 1) <> '' THEN lower(regexp_extract(e, '<\\s*([^<>\\s]+)\\s*>', 1)) WHEN regexp_full_match(trim(e), '[^<>\\s]+@[^<>\\s]+') THEN lower(trim(e)) END"""
# The only quoted comma of the made mails is the one in "Desk, Two".
ENTRIES = """string_split(replace(regexp_replace({x}, '\\(\\s*([^()\\s]+@[^()\\s]+)\\s*\\)', '<\\1>', 'g'), 'Desk, Two', 'Desk; Two'), ',')"""


def thread_sql(relation: str) -> str:
    """Threads of a relation (id, body): latest, quoted count, heads, last raw, warnings."""
    k = f"""CASE WHEN regexp_matches(line, {quote(x.DIVIDER)}) OR regexp_matches(line, {quote(x.ON_WROTE)}) THEN 'D' WHEN regexp_matches(line, {quote(x.MESSAGE_ID)}) THEN 'I' WHEN regexp_matches(line, {quote(x.CAUTION)}) THEN 'C'
      WHEN regexp_matches(line, {quote(x.FROM_LINE)}) THEN 'F' WHEN regexp_matches(line, {quote(x.DATE_LINE)}) THEN 'T' WHEN regexp_matches(line, {quote(x.SUBJECT_LINE)}) THEN 'S' ELSE '-' END"""

    def first(kind: str, pattern: str) -> str:
        return f"nullif(trim(regexp_extract(min_by(line, n) FILTER (k = '{kind}' AND n < start + 6), {quote(pattern)}, 1)), '')"

    return f"""tlines AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM {relation}),
tkinds AS (SELECT *, {k} AS k FROM tlines),
near AS (SELECT *, coalesce(bool_or(k = 'T') OVER w6, false) AS t, coalesce(bool_or(k = 'S') OVER w6, false) AS s, coalesce(bool_or(k IN ('I', 'F')) OVER w3, false) AS f FROM tkinds
    WINDOW w6 AS (PARTITION BY id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), w3 AS (PARTITION BY id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
hits AS (SELECT id, n FROM near WHERE k IN ('D', 'I') OR (k = 'C' AND f) OR (k = 'F' AND t AND s)),
starts AS (SELECT id, min(n) AS start FROM hits GROUP BY id UNION ALL SELECT s.id, (SELECT min(h.n) FROM hits h WHERE h.id = s.id AND h.n > s.start + 4) FROM starts s WHERE (SELECT min(h.n) FROM hits h WHERE h.id = s.id AND h.n > s.start + 4) IS NOT NULL),
blocks AS (SELECT l.id, s.start, {strip_sql("string_agg(line, chr(10) ORDER BY n)")} AS raw, concat_ws('~', {first('F', x.FROM_LINE)}, {first('T', x.DATE_LINE)}, {first('S', x.SUBJECT_LINE)}) AS head
    FROM tkinds l JOIN (SELECT id, start, lead(start) OVER (PARTITION BY id ORDER BY start) AS stop FROM starts) s ON s.id = l.id AND l.n >= s.start AND (s.stop IS NULL OR l.n < s.stop) GROUP BY ALL),
firsts AS (SELECT id, min(start) AS first FROM starts GROUP BY id),
latests AS (SELECT l.id, any_value(first) AS first, coalesce({strip_sql("string_agg(line, chr(10) ORDER BY n) FILTER (first IS NULL OR n < first)")}, '') AS latest FROM tlines l LEFT JOIN firsts USING (id) GROUP BY l.id),
threaded AS (SELECT id, latest, (SELECT count(*) FROM blocks b WHERE b.id = t.id) AS quoted, coalesce((SELECT string_agg(head, '|' ORDER BY start) FROM blocks b WHERE b.id = t.id), '') AS heads,
    coalesce((SELECT max_by(raw, start) FROM blocks b WHERE b.id = t.id), '') AS last_raw, CASE WHEN first IS NOT NULL AND length(latest) < 15 THEN '{x.SUSPICIOUS_SPLIT}' ELSE '' END AS warnings FROM latests t)"""


def clean_sql(relation: str, lines: list, tails: list, sign_off: str, values: str) -> str:
    """Texts of a relation (id, text) without boilerplate: (id, text, applied)."""
    out = [f"c0 AS (SELECT id, string_split(text, chr(10)) AS ls, '' AS applied FROM {relation})"]
    step = 0
    for name, pattern in lines:
        keep = f"list_filter(ls, lambda l: NOT regexp_matches(l, {quote(pattern)}))"
        out.append(f"c{step + 1} AS (SELECT id, {keep} AS ls, applied || CASE WHEN len({keep}) <> len(ls) THEN '|{name}' ELSE '' END AS applied FROM c{step})")
        step += 1
    for name, pattern in tails:
        at = f"list_position(list_transform(ls, lambda l: regexp_matches(l, {quote(pattern)})), true)"
        out.append(f"c{step + 1} AS (SELECT id, CASE WHEN {at} > 0 THEN ls[1:{at} - 1] ELSE ls END AS ls, applied || CASE WHEN {at} > 0 THEN '|{name}' ELSE '' END AS applied FROM c{step})")
        step += 1
    out.append(f"signed AS (SELECT *, list_position(list_transform(ls, lambda l: regexp_matches(l, {quote(sign_off)})), true) AS at_line FROM c{step})")
    out.append("filled AS (SELECT *, list_filter(list_transform(ls, lambda l, i: CASE WHEN i > at_line AND trim(l) <> '' THEN i END), lambda i: i IS NOT NULL) AS after FROM signed)")
    out.append("kept AS (SELECT *, CASE WHEN at_line > 0 THEN coalesce(after[4], len(ls)) ELSE len(ls) END AS keep FROM filled)")
    out.append("tailed AS (SELECT *, array_to_string(ls[keep + 1:], chr(10)) AS removed FROM kept)")
    out.append(
        f"cleaned AS (SELECT id, {strip_sql('array_to_string(CASE WHEN cut THEN ls[1:keep] ELSE ls END, chr(10))')} AS text, ltrim(applied || CASE WHEN cut THEN '|signature' ELSE '' END, '|') AS applied "
        f"FROM (SELECT *, coalesce({strip_sql('removed')} <> '' AND NOT regexp_matches(removed, {quote(values)}), false) AS cut FROM tailed))"
    )
    return ",\n".join(out)


def find_sql(text: str, pattern: str, groups: int) -> str:
    both = [f"nullif({strip_sql(f'regexp_extract({text}, {quote(pattern)}, {i + 1})')}, '')" for i in range(groups)]
    return f"coalesce({', '.join(both)})" if groups > 1 else both[0]


def marks_sql(text: str, pattern: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({text}, {quote(pattern)}, 1), lambda u: upper(u)))), '|'), '')"


VESSEL = x.SIGNALS["vessel_name"].replace("(?imd)", "(?im)")
PEOPLE = f"""{HEAD},
entries AS (SELECT message_id, unnest({ENTRIES.replace('{x}', "concat_ws(', ', h_from, h_to, h_cc)")}) AS e, generate_subscripts({ENTRIES.replace('{x}', "concat_ws(', ', h_from, h_to, h_cc)")}, 1) AS nth FROM split WHERE headers > 0),
people AS (SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY nth) - 1 AS ord, replace(nullif(CASE WHEN contains(e, '<') THEN trim(replace(regexp_replace(e, '<[^>]*>', '', 'g'), '"', '')) END, ''), ';', ',') AS name, {PERSON} AS address FROM entries WHERE {PERSON} IS NOT NULL),
senders AS (SELECT message_id, address AS sender FROM people WHERE ord = 0),
others AS (SELECT message_id, count(*) AS n, bool_and(split_part(address, '@', 2) = 'own.example') AS own FROM people WHERE ord > 0 GROUP BY ALL)"""
NEWEST = f"""{PEOPLE},
dumps AS (SELECT message_id AS id, {strip_sql("regexp_replace(body, '\\n{3,}', chr(10) || chr(10), 'g')")} AS body FROM split),
{thread_sql('dumps')},
latest_texts AS (SELECT id, latest AS text FROM threaded),
{clean_sql('latest_texts', x.LINE_RULES, x.TAIL_RULES, x.SIGN_OFF, x.VALUE_BEARING)},
newest AS (SELECT c.id AS message_id, c.text AS newest, s.sender, split_part(s.sender, '@', 2) AS domain, coalesce(o.n, 0) AS recipients, coalesce(o.n > 0 AND o.own, false) AS internal_only, p.h_attachments, p.h_subject, t.quoted
    FROM cleaned c JOIN split p ON p.message_id = c.id JOIN threaded t ON t.id = c.id LEFT JOIN senders s ON s.message_id = c.id LEFT JOIN others o ON o.message_id = c.id)"""
FIRSTS = ", ".join(
    f"nullif(trim(regexp_extract(min_by(line, n) FILTER (k = '{kind}' AND n < start + 6), {quote(pattern)}, 1)), '') AS {name}"
    for kind, pattern, name in (("F", x.FROM_LINE, "from_address"), ("T", x.DATE_LINE, "sent_at"), ("S", x.SUBJECT_LINE, "subject"))
)
HINTED = f"""{NEWEST},
hinted AS (SELECT *, concat_ws(chr(10), nullif(h_subject, ''), newest) AS said, CASE WHEN coalesce(h_attachments, '') = '' THEN '' ELSE 'OTHER|RFQ_FORM_PDF|RFQ_FORM_XLSX' END AS kinds FROM newest)"""
SENDER_CLASS = """CASE WHEN sender IS NULL THEN 'UNKNOWN' WHEN sender = 'c5@own.example' THEN 'INTERNAL_SYSTEM' WHEN sender LIKE '%@own.example' THEN 'INTERNAL_OWN' WHEN sender LIKE '%@portal.example' THEN 'PORTAL'
  WHEN sender LIKE '%@customer.example' OR sender LIKE '%@supplier.example' THEN 'KNOWN_CUSTOMER' ELSE 'EXTERNAL_UNKNOWN' END"""
PORTAL = "CASE WHEN domain = 'portal.example' THEN 'ShipPortal' WHEN contains(lower(newest), 'portal mail tool') THEN 'Mailer' WHEN contains(lower(newest), 'portal') THEN 'Late' END"
MAIL_PREFIXES = f"coalesce(array_to_string(list_transform(regexp_extract_all(regexp_extract(coalesce(h_subject, ''), {quote(x.SUBJECT_RUN.replace('*+', '*').replace('++', '+'))}, 1), {quote(x.SUBJECT_PREFIX)}, 1), lambda u: upper(trim(u))), '|'), '')"
PREFIX_TEXT = "CASE conv_id % 3 WHEN 0 THEN 'RE: ' WHEN 1 THEN ' fw :[UPDATED] Fwd:' ELSE '' END || CASE WHEN turn % 2 = 0 THEN 're:' ELSE '' END || text"
HTML = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in x.DROPPED_TAGS:
    HTML = f"regexp_replace({HTML}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
HTML = f"regexp_replace({HTML}, '(?:<[^>]*>)+', chr(10), 'g')"
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_name}', '{_sign}')"


def normal_sql(text: str) -> str:
    plain = f"regexp_replace({text}, '\\r\\n?', chr(10), 'g')"
    ends = f"regexp_replace({plain}, '[ \\t]+(\\n|$)', '\\1', 'g')"
    return strip_sql(f"regexp_replace({ends}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def region_sql() -> str:
    def listed(test) -> str:
        return "list_filter([" + ", ".join(f"CASE WHEN {test(key, words)} THEN '{key}' END" for key, words in REGIONS) + "], lambda k: k IS NOT NULL)"

    def word(w: str) -> str:
        escaped = "".join(f"\\{c}" if not c.isalnum() else c for c in w)
        return f"regexp_matches(lower(body), '(^|[^\\p{{L}}\\p{{N}}_]){escaped}([^\\p{{L}}\\p{{N}}_]|$)')"

    rules = [
        ("region_hint", listed(lambda key, _: f"lower(trim(coalesce(hint, ''))) = '{key}'")),
        ("delivery_port", listed(lambda _, w: " OR ".join(f"contains(lower(coalesce(port, '')), '{p}')" for p in w["ports"]))),
        ("keyword", listed(lambda _, w: " OR ".join(word(k) for k in w["keywords"]))),
        ("mailbox", listed(lambda _, w: " OR ".join(f"list_contains(string_split_regex(lower(mailbox), '[^a-z0-9]+'), '{k}')" for k in w["mailbox"]))),
    ]
    keys = ", ".join(f"{one} AS {rule}" for rule, one in rules)
    region = " ".join(f"WHEN len({rule}) > 1 THEN NULL WHEN len({rule}) = 1 THEN {rule}[1]" for rule, _ in rules)
    name = " ".join(f"WHEN len({rule}) > 1 THEN NULL WHEN len({rule}) = 1 THEN '{rule}'" for rule, _ in rules)
    return f"SELECT email_id, CASE {region} END AS region, CASE {name} END AS rule FROM (SELECT email_id, {keys} FROM ({ROUTED}))"


ACTION = "CASE category " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in o.CATEGORY_ACTION) + " END"
LABEL = f"CASE {ACTION} " + " ".join(f"WHEN '{a}' THEN '{label}'" for a, label in ACTION_LABELS) + " END"
PATH = "CASE WHEN email_id % 3 = 0 THEN 'RULES_FAST_PATH' ELSE 'LLM' END"
IS_RFQ = "category IN ('NEW_RFQ', 'UPDATED_RFQ', 'PORTAL_RFQ_NOTIFICATION')"
COUNTS = "list_transform(ls, lambda l: length(l) - length(replace(l, {x}, '')))"
EVEN = "(" + " OR ".join(
    f"({COUNTS.replace('{x}', sign)}[1] >= 1 AND len(list_distinct({COUNTS.replace('{x}', sign)})) = 1)" for sign in ("','", "';'", "chr(9)", "'|'")
) + ")"
NAMES = ["mail", "number", "license"]

QUERIES = [
    Query("A1", "read_catalog_csv", sheet,
          "SELECT CAST(position AS VARCHAR) AS no, '00' || code AS code, '\"' || description || '\" ' || chr(10) || 'new' AS description, customer_code FROM catalog_rows"),
    Query("A4", "publish_snapshot", snapshot,
          f"""WITH digests AS (SELECT *, sha256(concat_ws(chr(31), CAST(position AS VARCHAR), coalesce(code, chr(1)), coalesce(description, chr(1)), coalesce(customer_code, chr(1)), coalesce(customer_description, chr(1)))) AS h FROM ({SHEET}))
SELECT count(*) AS rows, count(*) FILTER (trim(code) <> '' AND trim(description) <> '') AS items,
  sha256(concat_ws('-', {', '.join(f"CAST(sum(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT)) AS VARCHAR)" for i in range(4))})) AS sha256 FROM digests"""),
    Query("A5+A6", "journal_lines", journal_lines, "SELECT ord, decision_id, coalesce(type, 'decision') AS type, value FROM journal"),
    Query("A7", "redact", redacted,
          """SELECT doc_id, source, sha256(text) AS body_sha256, length(text) AS body_chars, NULL::VARCHAR AS body_text FROM documents
UNION ALL SELECT -doc_id - 1, source, sha256(text), length(text), text FROM documents WHERE doc_id % 2 = 0"""),
    Query("A8", "attachment_kinds", kinds,
          """SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'ZIP_FAMILY' WHEN 1 THEN 'OLE_FAMILY' WHEN 2 THEN 'PDF' WHEN 3 THEN 'IMAGE' WHEN 4 THEN 'IMAGE' WHEN 6 THEN 'SEVEN_ZIP' WHEN 7 THEN 'UNKNOWN' WHEN 5 THEN 'UNKNOWN' WHEN 8 THEN 'CSV' WHEN 9 THEN 'EML' WHEN 10 THEN 'CSV' ELSE
  CASE WHEN filename = 'a.txt' THEN 'TEXT' WHEN content_type <> '' THEN 'CSV' WHEN len(ls) >= 2 AND EVEN_TEST THEN 'CSV' ELSE 'TEXT' END END AS kind
FROM (SELECT *, list_filter(string_split(text, chr(10))[1:5], lambda l: trim(l) <> '') AS ls FROM ({})) UNION ALL SELECT -1 - page_id, 'HTML' FROM pages""".replace("{}", MAGIC).replace("EVEN_TEST", EVEN)),
    Query("A9", "html_cells", list_cells,
          """WITH lists AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul\\s*>', 1)) AS block, generate_subscripts(regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul\\s*>', 1), 1) - 1 AS table_no FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<script\\b[^>]*>.*?</script>', '', 'g') AS html FROM pages)),
rows AS (SELECT page_id, table_no, unnest(regexp_extract_all(block, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1)) AS line, generate_subscripts(regexp_extract_all(block, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1), 1) - 1 AS row_no FROM lists),
cells_of AS (SELECT page_id, table_no, row_no, unnest(regexp_extract_all(line, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1)) AS value, generate_subscripts(regexp_extract_all(line, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1), 1) - 1 AS col_no FROM rows)
SELECT page_id, CAST(table_no AS BIGINT) AS table_no, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, trim(replace(value, '&amp;', '&')) AS value FROM cells_of WHERE trim(value) <> ''"""),
    Query("A9", "nested_cells", nested_cells,
          """WITH lines AS (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY line_index) AS n FROM rfq_lines), cells_of AS (
SELECT rfq_id, 0 AS table_no, 0 AS row_no, 0 AS col_no, 'Item' AS value FROM lines WHERE n = 1 UNION ALL SELECT rfq_id, 0, 0, 1, 'Qty & unit' FROM lines WHERE n = 1
UNION ALL SELECT rfq_id, 0, n, 0, description FROM lines UNION ALL SELECT rfq_id, 0, n, 1, quantity || ' left' FROM lines
UNION ALL SELECT rfq_id, 2 * n - 1, 0, 0, source FROM lines UNION ALL SELECT rfq_id, 2 * n - 1, 0, 1, 'u:&' || CAST(line_index AS VARCHAR) FROM lines UNION ALL SELECT rfq_id, 2 * n, 0, 0, uom FROM lines)
SELECT rfq_id, CAST(table_no AS BIGINT) AS table_no, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, value FROM cells_of"""),
    Query("B1", "normalize_text", normalised,
          "SELECT doc_id, " + normal_sql("replace('  ' || replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10)) || chr(13) || chr(13) || chr(10) || ' ' || chr(10) || chr(10) || ' end ﬁn ', 'ﬁ', 'fi')") + " AS text FROM documents"),
    Query("B2", "split_headers", headers, f"WITH {HEAD} SELECT message_id, h_from, h_to, h_cc, h_subject, h_attachments, headers, length(body) AS body_chars FROM split"),
    Query("B3", "parse_addresses", addresses, f"WITH {PEOPLE} SELECT message_id, ord, name, address, split_part(address, '@', 2) AS domain FROM people"),
    Query("B4", "parse_attachments", attachments,
          """SELECT p_partkey, CAST(k AS BIGINT) AS ord, CASE k WHEN 0 THEN 'E_QUOT_' || CAST(p_partkey AS VARCHAR) || '.XLS' WHEN 1 THEN 'image' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.png' WHEN 2 THEN 'e_quot.pdf' ELSE 'My E_QUOT.xlsx' END AS filename,
  CASE k WHEN 0 THEN 'RFQ_FORM_XLSX' WHEN 2 THEN 'RFQ_FORM_PDF' ELSE 'OTHER' END AS kind, CASE k WHEN 0 THEN 'RFQ_FORM_XLSX' WHEN 2 THEN 'RFQ_FORM_PDF' WHEN 1 THEN CASE WHEN p_partkey % 3 > 0 AND p_partkey * 100 < 20000 THEN 'SIGNATURE_IMAGE' ELSE 'OTHER' END ELSE 'OTHER' END AS kind_with_size
FROM part, (VALUES (0), (1), (2), (3)) v(k)"""),
    Query("B5", "html_to_text", page_texts, f"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'plain part' ELSE {normal_sql(HTML)} END AS text FROM pages"),
    Query("B6", "split_thread", threads,
          f"WITH RECURSIVE all_bodies AS (SELECT conv_id AS id, body FROM threads UNION ALL SELECT -1 - message_id, raw_text FROM mails),\n{thread_sql('all_bodies')} SELECT id, latest, quoted, heads, last_raw, warnings FROM threaded"),
    Query("B7", "strip_boilerplate", stripped,
          f"WITH docs AS (SELECT doc_id AS id, text FROM documents),\n{clean_sql('docs', LICENSE_LINES, LICENSE_TAILS, TEXT_SIGN_OFF, TEXT_VALUES)} SELECT id AS doc_id, text, applied FROM cleaned"),
    Query("B8", "extract_signals", text_signals,
          "SELECT doc_id, " + ", ".join(f"{find_sql('text', TEXT_SIGNALS[n], 2 if n == 'license' else 1)} AS {n}" for n in NAMES) + f", {marks_sql('text', TEXT_MARKS)} AS marks FROM documents"),
    Query("B8", "mail_signals", mail_signals,
          f"""SELECT message_id, {find_sql('raw_text', x.SIGNALS['imo'], 1)} AS imo, {strip_sql(f"string_split_regex({find_sql('raw_text', VESSEL, 2)}, '\\s+[-–]\\s+|\\s*,\\s*')[1]")} AS vessel_name, {find_sql('raw_text', x.SIGNALS['rfq_reference'], 1)} AS rfq_reference,
  {find_sql('raw_text', x.SIGNALS['delivery_port'], 1)} AS delivery_port, {find_sql('raw_text', x.SIGNALS['eta'], 1)} AS eta, {find_sql('raw_text', x.SIGNALS['quote_due_date'], 2)} AS quote_due_date, {marks_sql('raw_text', x.URGENCY)} AS marks FROM mails"""),
    Query("B9", "subject_prefixes", prefixes,
          f"SELECT conv_id, turn, coalesce(array_to_string(list_transform(regexp_extract_all(regexp_extract({PREFIX_TEXT}, {quote(x.SUBJECT_RUN.replace("*+", "*").replace("++", "+"))}, 1), {quote(x.SUBJECT_PREFIX)}, 1), lambda u: upper(trim(u))), '|'), '') AS prefixes FROM conversations"),
    Query("B10", "parse_raw_messages", parsed,
          f"""WITH {PEOPLE},
tos AS (SELECT message_id, len(list_filter({ENTRIES.replace('{x}', "coalesce(h_to, '')")}, lambda e: {PERSON} IS NOT NULL)) AS to_count, len(list_filter({ENTRIES.replace('{x}', "coalesce(h_cc, '')")}, lambda e: {PERSON} IS NOT NULL)) AS cc_count FROM split)
SELECT p.message_id, sender, nullif(h_subject, '') AS subject, to_count, cc_count, len(list_filter(string_split(coalesce(h_attachments, ''), ','), lambda f: trim(f) <> '')) AS files,
  CASE WHEN headers = 0 THEN '{x.NO_HEADER_BLOCK}' ELSE '{x.DATE_NOT_PARSED}' END AS warnings FROM split p JOIN tos USING (message_id) LEFT JOIN senders USING (message_id)"""),
    Query("B11", "newest_message_corpus", corpus,
          f"""WITH RECURSIVE all_bodies AS (SELECT conv_id AS id, body FROM threads),\n{thread_sql('all_bodies')},\nlatest_texts AS (SELECT id, latest AS text FROM threaded),
{clean_sql('latest_texts', LICENSE_LINES, LICENSE_TAILS, TEXT_SIGN_OFF, TEXT_VALUES)}
SELECT CAST(sum(length(latest)) AS BIGINT) AS chars_before, CAST(sum(length(text)) AS BIGINT) AS chars_after, round(1 - CAST(sum(length(text)) AS DOUBLE) / sum(length(latest)), 6) AS removed_share FROM threaded JOIN cleaned USING (id)"""),
    Query("B12", "chunk_parts", parts,
          """WITH RECURSIVE pages_of AS (SELECT conv_id, turn AS page_no, repeat(text, CAST(1 + turn % 4 AS INT)) AS text, length(text) * (1 + turn % 4) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(text) <> ''),
packed AS (SELECT conv_id, page_no, n, chars AS size, CAST(1 AS BIGINT) AS part_no FROM pages_of WHERE n = 1
  UNION ALL SELECT p.conv_id, p.page_no, p.n, CASE WHEN k.size + p.chars > 4000 THEN p.chars ELSE k.size + p.chars END, CASE WHEN k.size + p.chars > 4000 THEN k.part_no + 1 ELSE k.part_no END FROM packed k JOIN pages_of p ON p.conv_id = k.conv_id AND p.n = k.n + 1),
tails AS (SELECT conv_id, part_no + 1 AS part_no, least(max_by(chars, n), 400) AS tail_chars FROM packed JOIN pages_of USING (conv_id, page_no, n) GROUP BY conv_id, part_no)
SELECT conv_id, page_no, part_no, chars, coalesce(tail_chars, 0) AS tail_chars FROM packed JOIN pages_of USING (conv_id, page_no, n) LEFT JOIN tails USING (conv_id, part_no)"""),
    Query("B12", "image_parts", images, "SELECT rfq_id, line_index AS image_no, (line_index - 1) // 3 + 1 AS part_no FROM rfq_lines"),
    Query("B13", "truncate_middle", truncated,
          "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 118) || chr(10) || chr(10) || '[... ' || CAST(length(text) - 236 AS VARCHAR) || ' characters omitted ...]' || chr(10) || chr(10) || right(text, 118) END AS text FROM documents"),
    Query("B14", "recent_history", history,
          "SELECT conv_id, 1000 - turn AS ord, role, number, greatest(n - 3, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS number, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE number <= 3"),
    Query("C1", "classify_sender", senders,
          f"""WITH {PEOPLE} SELECT message_id, split_part(sender, '@', 2) AS domain, CASE WHEN sender IS NULL THEN 'UNKNOWN' WHEN sender = 'c5@own.example' THEN 'INTERNAL_SYSTEM' WHEN sender LIKE '%@own.example' THEN 'INTERNAL_OWN' WHEN sender LIKE '%@portal.example' THEN 'PORTAL'
  WHEN sender LIKE '%@customer.example' OR sender LIKE '%@supplier.example' THEN 'KNOWN_CUSTOMER' ELSE 'EXTERNAL_UNKNOWN' END AS sender_class FROM mails LEFT JOIN senders USING (message_id)"""),
    Query("C2+C3+C4", "portals_and_markers", portals,
          f"""WITH RECURSIVE {NEWEST} SELECT message_id, CASE WHEN domain = 'portal.example' THEN 'ShipPortal' WHEN contains(lower(newest), 'portal mail tool') THEN 'Mailer' WHEN contains(lower(newest), 'portal') THEN 'Late' END AS portal,
  array_to_string(list_filter([CASE WHEN contains(lower(newest), 'dear all') THEN 'greeting' END, CASE WHEN contains(lower(newest), 'kind regards') OR contains(lower(newest), 'yours') THEN 'signing' END], lambda g: g IS NOT NULL), '|') AS markers, internal_only FROM newest"""),
    Query("C5", "build_hints", hints,
          f"""WITH RECURSIVE {HINTED} SELECT message_id, {SENDER_CLASS} AS sender_class, {PORTAL} AS portal, internal_only AS recipients_internal_only, quoted > 0 AS is_reply, {MAIL_PREFIXES} AS prefixes,
  kinds, {strip_sql(f"string_split_regex({find_sql('said', VESSEL, 2)}, '\\s+[-–]\\s+|\\s*,\\s*')[1]")} AS vessel_name, {find_sql('said', x.SIGNALS['rfq_reference'], 1)} AS rfq_reference FROM hinted"""),
    Query("C6", "to_be_asked", asked,
          f"""WITH RECURSIVE {NEWEST} SELECT message_id FROM newest WHERE NOT (coalesce(domain = 'own.example', false) AND internal_only) AND NOT (coalesce(h_attachments, '') = '' AND length({strip_sql('newest')}) < 10)"""),
    Query("C7", "policy_of_messages", policy_of_messages,
          f"""WITH RECURSIVE {HINTED}, acted AS (SELECT message_id, v.*, contains(kinds, 'RFQ_FORM') OR coalesce({find_sql('said', x.SIGNALS['quote_due_date'], 2)}, '') <> '' OR coalesce({find_sql('said', x.SIGNALS['rfq_reference'], 1)}, '') <> '' AS strong,
  {marks_sql('said', x.URGENCY)} <> '' AS urgent, CASE WHEN confidence < 0.6::DOUBLE THEN 'HUMAN_REVIEW' ELSE {ACTION} END AS action FROM hinted JOIN verdicts v ON v.email_id = message_id)
SELECT message_id, action AS recommended_action, confidence < 0.85::DOUBLE OR (action = 'IGNORE' AND strong) AS needs_human_review, CASE WHEN urgent THEN 'URGENT' ELSE priority END AS priority,
  CASE WHEN action = 'IGNORE' AND strong THEN 'LLM_WITH_GUARDRAIL_OVERRIDE' ELSE 'LLM' END AS decision_path,
  concat_ws('|', CASE WHEN answered_is_rfq <> (category IN ('NEW_RFQ', 'UPDATED_RFQ', 'PORTAL_RFQ_NOTIFICATION')) THEN 'guardrail:is_rfq_mismatch' END,
    CASE WHEN confidence < 0.6::DOUBLE THEN 'guardrail:low_confidence' WHEN confidence < 0.85::DOUBLE THEN 'guardrail:confidence_below_auto' END, CASE WHEN action = 'IGNORE' AND strong THEN 'guardrail:rfq_signal_in_ignored_email' END) AS hits FROM acted"""),
    Query("B6", "quoted_messages", quoted,
          f"""WITH RECURSIVE bodies AS (SELECT message_id AS id, raw_text AS body FROM mails),\n{thread_sql('bodies')},
parts AS (SELECT id, start, {strip_sql("string_agg(line, chr(10) ORDER BY n)")} AS raw, {FIRSTS} FROM tkinds l JOIN (SELECT id, start, lead(start) OVER (PARTITION BY id ORDER BY start) AS stop FROM starts) s USING (id) WHERE n >= start AND (stop IS NULL OR n < stop) GROUP BY id, start)
SELECT id AS message_id, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS ord, raw, from_address, sent_at, subject FROM parts"""),
    Query("C6", "fast_path", decided,
          f"""WITH RECURSIVE {NEWEST}, ruled AS (SELECT message_id, CASE WHEN domain = 'own.example' AND internal_only THEN 1 WHEN coalesce(h_attachments, '') = '' AND length({strip_sql('newest')}) < 10 THEN 2 END AS r FROM newest)
SELECT message_id, CASE r WHEN 1 THEN 'R1_internal_only' WHEN 2 THEN 'R2_empty_body' END AS rule, CASE r WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'OTHER_NON_ACTIONABLE' END AS category, CASE r WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'UNKNOWN' END AS direction, CASE r WHEN 1 THEN 0.97::DOUBLE WHEN 2 THEN 0.95::DOUBLE END AS confidence FROM ruled"""),
    Query("C7", "finalize_policy", policy,
          f"""WITH drafts AS (SELECT * REPLACE (confidence * 1.2::DOUBLE - 0.1::DOUBLE AS confidence) FROM verdicts),
acted AS (SELECT *, CASE WHEN confidence < 0.6::DOUBLE THEN 'HUMAN_REVIEW' ELSE {ACTION} END AS action FROM drafts),
signalled AS (SELECT *, action = 'IGNORE' AND strong_signal AS signal FROM acted)
SELECT email_id, {IS_RFQ} AS is_rfq, action AS recommended_action, action <> 'IGNORE' AS requires_action, confidence < 0.85::DOUBLE OR signal AS needs_human_review, round(least(greatest(confidence, 0), 1), 6) AS confidence,
  CASE WHEN email_id % 19 = 0 THEN 'URGENT' ELSE priority END AS priority, CASE WHEN signal AND {PATH} = 'LLM' THEN 'LLM_WITH_GUARDRAIL_OVERRIDE' ELSE {PATH} END AS decision_path,
  array_to_string(list_filter([CASE WHEN answered_is_rfq <> ({IS_RFQ}) THEN 'guardrail:is_rfq_mismatch' END, CASE WHEN confidence < 0.6::DOUBLE THEN 'guardrail:low_confidence' WHEN confidence < 0.85::DOUBLE THEN 'guardrail:confidence_below_auto' END, CASE WHEN signal THEN 'guardrail:rfq_signal_in_ignored_email' END], lambda h: h IS NOT NULL), '|') AS hits FROM signalled"""),
    Query("C8", "outlook_labels", labels,
          f"SELECT email_id, CASE WHEN confidence < 0.3::DOUBLE THEN 'Review' ELSE {LABEL} END || CASE WHEN email_id % 2 = 0 THEN '|Not Sent' ELSE '' END AS labels FROM verdicts"),
    Query("C9", "resolve_region", regions, region_sql()),
    Query("C10", "delivery_outcome", deliveries,
          f"""WITH d AS (SELECT *, coalesce(header_region, verdict_region) AS best FROM ({DELIVERIES})),
told AS (SELECT email_id, CASE WHEN needs_human_review THEN 'UNSURE' WHEN best IS NULL THEN 'NO_REGION' WHEN coalesce(forward_to, '') = '' THEN 'NO_ADDRESS' WHEN sent THEN 'SENT' ELSE 'FAILED' END AS outcome, best FROM d)
SELECT email_id, outcome, CASE WHEN outcome IN ('NO_ADDRESS', 'SENT', 'FAILED') THEN best END AS region, outcome IN ('NO_REGION', 'NO_ADDRESS', 'FAILED') AS not_sent_label FROM told UNION ALL SELECT -count(*), 'DISABLED', NULL, false FROM d"""),
    Query("C11", "already_handled", handled, "SELECT o_orderkey, o_orderkey % 5 = 0 AS handled FROM orders"),
    Query("C12", "image_budget", pictures,
          f"""WITH f AS (SELECT * FROM ({PICTURES})), claims AS (SELECT *, sum(images) OVER e AS wanted, count(*) OVER e AS n, row_number() OVER (PARTITION BY email_id ORDER BY ord) AS place FROM f WHERE images > 0 WINDOW e AS (PARTITION BY email_id)),
given AS (SELECT *, 10 // n AS share, least(images, 10 // n) AS given, images - least(images, 10 // n) AS unmet FROM claims),
spared AS (SELECT *, 10 - sum(given) OVER (PARTITION BY email_id) AS spare, coalesce(sum(unmet) OVER (PARTITION BY email_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM given),
kept AS (SELECT email_id, ord, CAST(CASE WHEN wanted <= 10 THEN images WHEN share = 0 THEN CASE WHEN place <= 10 THEN 1 ELSE 0 END ELSE given + greatest(0, least(unmet, spare - before)) END AS BIGINT) AS kept FROM spared)
SELECT f.email_id, f.ord, coalesce(kept, 0) AS images_kept, coalesce(kept, 0) < images AS images_truncated FROM f LEFT JOIN kept USING (email_id, ord)"""),
    Query("C13", "attachment_budget", sizes,
          f"""WITH RECURSIVE f AS (SELECT * FROM ({SIZES}) WHERE NOT (is_inline AND size_bytes <= 15360)), slots AS (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY ord) AS slot FROM f WHERE NOT is_reference AND has_bytes),
walk AS (SELECT email_id, slot, ord, CASE WHEN size_bytes > 26214400 THEN 0 ELSE size_bytes END AS bytes, CASE WHEN size_bytes > 26214400 THEN '{o.FILE_TOO_LARGE}' END AS reason FROM slots WHERE slot = 1
  UNION ALL SELECT s.email_id, s.slot, s.ord, CASE WHEN s.size_bytes > 26214400 OR w.bytes + s.size_bytes > 41943040 THEN w.bytes ELSE w.bytes + s.size_bytes END,
    CASE WHEN s.size_bytes > 26214400 THEN '{o.FILE_TOO_LARGE}' WHEN w.bytes + s.size_bytes > 41943040 THEN '{o.TOTAL_SIZE_EXCEEDED}' END FROM walk w JOIN slots s ON s.email_id = w.email_id AND s.slot = w.slot + 1 WHERE s.slot <= 20)
SELECT f.email_id, f.ord, CASE WHEN is_reference THEN '{o.IS_LINK}' WHEN NOT has_bytes THEN '{o.NO_BYTES}' WHEN w.slot IS NULL THEN '{o.TOO_MANY_ATTACHMENTS}' ELSE reason END AS blocked FROM f LEFT JOIN walk w USING (email_id, ord)"""),
]
