"""What was read out of a request: accepted, standardised, merged over its files, and explained where blank."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions import values as v
from quoteflow.functions.values import strip
from quoteflow.functions.words import collapsed, shortened
from quoteflow.operators.common import last_wins, number_rows, ordered_list
from quoteflow.sources.store import stored

# Fixed values.
HEADER_FIELDS = [
    "vessel_name", "imo", "rfq_reference", "customer_contact", "customer_phone", "customer_email",
    "person_designation", "delivery_port", "eta", "etd", "quote_before", "requested_delivery",
    "delivery_address", "currency", "rfq_type", "sender_code",
]
DERIVED_FIELDS = ["sender_code"]
REQUIRED_FIELDS = ["vessel_name", "imo", "rfq_reference", "delivery_port", "currency", "rfq_type"]
DATE_FIELDS = ["eta", "etd", "quote_before", "requested_delivery"]
# The order in which fields are standardised, and so in which what was dropped is told.
STANDARD_ORDER = [
    "vessel_name", "rfq_reference", "customer_contact", "customer_phone", "customer_email", "person_designation",
    "delivery_address", "imo", "delivery_port", "currency", "rfq_type", "eta", "etd", "quote_before",
    "requested_delivery",
]
PLACEHOLDERS = ["n/a", "na", "none", "null", "unknown", "-", "--", "tbc", "tba", "?"]
DERIVED = "field_answered_that_is_looked_up_not_read"
CLAIMED_TWICE = "field_claimed_twice"
PLACEHOLDER = "placeholder_value"
WITHOUT_SOURCE = "field_without_source"
UNKNOWN_SOURCE = "field_from_unknown_source"
EXPLAINED_FOUND = "explained_a_field_it_also_filled"
IMO_INVALID = "imo_check_digit_failed"
TYPE_FELL_BACK = "rfq_type_fell_back_to_others"
DUPLICATE_SOURCE = "same_items_attached_twice"
NO_ITEMS = "no_items_found_in_this_rfq"
TWO_QUANTITIES = "same_item_two_quantities_in_two_files"
WHY_CHARS = 200
ARTICLE_CHARS = 48
LABELS = [
    ("vessel_name", "Vessel Name"), ("imo", "IMO Number"), ("rfq_reference", "RFQ Reference"),
    ("delivery_port", "Delivery Port"), ("currency", "Currency"), ("rfq_type", "RFQ Type"), ("eta", "E.T.A"),
    ("etd", "E.T.D"), ("quote_before", "Quote Before"), ("requested_delivery", "Requested Delivery"),
]
REASONS = [
    (IMO_INVALID, "as given - the check digit does not add up"),
    (v.DATE_AMBIGUOUS, "could be read two ways"),
    (v.DATE_UNREADABLE, "not a date we could read"),
    (v.DATE_IMPOSSIBLE, "no such day in the calendar - check the customer's own file"),
]
FILE_REASONS = [
    ("attachment_is_a_link", "a OneDrive link rather than a file - open it in the email"),
    ("attachment_has_no_bytes", "the mail server did not hand over its contents"),
    ("no_reader_for_kind", "a format this agent cannot open"),
    ("unreadable", "the file is damaged"),
    ("password_protected", "locked with a password"),
    ("file_too_large", "over the size limit"),
    ("total_attachment_size_exceeded", "the email was over the total size limit"),
    ("too_many_attachments", "past the limit on how many files one email may carry"),
    ("file_could_not_be_read", "the reader could not answer about it"),
]
NOTHING_TO_READ = "nothing_to_read"
NOTHING_IN_IT = "nothing could be read out of it"
MOST_REMARKS = 12
GOODS_SHOWN = 20
BLANKS_LISTED = 6
GOODS_CHARS = 70
FORM_CELLS = [
    ("vessel_name", "C2"), ("imo", "C3"), ("rfq_reference", "C4"), ("customer_contact", "C6"),
    ("customer_phone", "C7"), ("customer_email", "C8"), ("person_designation", "C9"), ("delivery_port", "H2"),
    ("eta", "H3"), ("etd", "H4"), ("quote_before", "H5"), ("requested_delivery", "H6"), ("delivery_address", "H7"),
    ("currency", "H8"), ("sender_code", "H9"), ("rfq_type", "H11"),
]
FIRST_ITEM_ROW = 24
LAST_ITEM_ROW = 5000
ITEMS_TRUNCATED = "items_did_not_fit_the_template"


def lookup(key: Column, pairs: list[tuple[str, str]]) -> Column:
    """The text a short fixed list gives for a key, null for other keys."""
    return F.coalesce(*[F.when(key == one, text) for one, text in pairs])


def label(field: Column) -> Column:
    return F.coalesce(lookup(field, LABELS), F.initcap(F.replace(field, F.lit("_"), F.lit(" "))))


def accept_header_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Every answer with `refused` (null when accepted) and `unknown_source`.

    `answers` carries `rfq_id`, `ord`, `field`, `value`, `source`; `sources` the labels a source may name. The first
    acceptable answer to a field stands; an unknown source is kept and flagged.
    """
    said = strip(F.coalesce("value", F.lit("")))
    blank = (said == "") | F.lower(said).isin(PLACEHOLDERS)
    derived = F.col("field").isin(DERIVED_FIELDS)
    unsourced = strip(F.coalesce("source", F.lit(""))) == ""
    # An answer is moved once, to the others of its request: which of a field's comes first and what its source names are
    # told there.
    same_field = Window.partitionBy("rfq_id", "field")
    accepted = F.when(~derived & ~blank & ~unsourced & F.col("rfq_id").isNotNull() & F.col("field").isNotNull(), F.col("ord"))
    reason = (
        F.when(derived, DERIVED)
        .when(F.col("accepted_ord") < F.col("ord"), CLAIMED_TWICE)
        .when(blank, PLACEHOLDER)
        .when(unsourced, WITHOUT_SOURCE)
    )
    labels = sources.where("label is not null").groupBy("rfq_id").agg(F.collect_set("label").alias("labels"))
    cited = strip("source")
    known = F.coalesce(F.exists("labels", lambda label: cited.contains(label) | label.contains(cited)), F.lit(False))
    met = answers.join(labels, "rfq_id", "left").withColumn("known", known).drop("labels")
    judged = met.withColumn("accepted_ord", F.min(accepted).over(same_field)).withColumn("refused", reason)
    return judged.select(
        "rfq_id",
        "ord",
        "field",
        strip("value").alias("value"),
        strip("source").alias("source"),
        "refused",
        (F.col("refused").isNull() & ~F.col("known")).alias("unknown_source"),
    )


def accept_explanations(explanations: DataFrame, accepted: DataFrame) -> DataFrame:
    """(rfq_id, field, why, warning): the last reason given for each starred field that stayed empty.

    A reason for a field that was filled is dropped with a warning (a row without `why`).
    """
    why = F.left(strip(F.regexp_replace("why", r"\s+", " ")), F.lit(WHY_CHARS))
    told = explanations.withColumn("why", why).where("why <> ''")
    filled = accepted.select("rfq_id", "field").distinct()
    contradicted = told.join(filled, ["rfq_id", "field"], "left_semi").select("rfq_id", "field").distinct()
    kept = told.where(F.col("field").isin(REQUIRED_FIELDS)).join(filled, ["rfq_id", "field"], "left_anti")
    last = last_wins(kept.select("rfq_id", "field", "why", "ord"), ["rfq_id", "field"], ["ord"])
    return last.select("rfq_id", "field", "why", F.lit(None).cast("string").alias("warning")).unionByName(
        contradicted.select(
            "rfq_id", "field", F.lit(None).cast("string").alias("why"), F.lit(EXPLAINED_FOUND).alias("warning")
        )
    )


def normalize_header(accepted: DataFrame, today: Column) -> DataFrame:
    """Accepted fields in long form with `text`, `day`, `dropped`, `checked` and `warning`."""
    field, raw = F.col("field"), F.col("value")
    trimmed = F.when(strip(raw) != "", strip(raw))
    dated = v.parse_due_date(raw, today)
    is_date = field.isin(DATE_FIELDS)
    imo = v.check_imo(raw)
    text = (
        F.when(field == "imo", F.coalesce(imo, trimmed))
        .when(field == "currency", v.standardise_currency(trimmed))
        .when(field == "rfq_type", v.standardise_type(raw))
        .when(~is_date, trimmed)
    )
    checked = F.when((field == "imo") & imo.isNull() & trimmed.isNotNull(), IMO_INVALID)
    read = accepted.where(~field.isin(DERIVED_FIELDS)).withColumn("dated", F.when(is_date, dated))
    dropped = F.when(is_date & (F.col("dated.problem") != ""), F.col("dated.problem")).when(~is_date & text.isNull(), "")
    long = read.select(
        "rfq_id", "field", "value", "source",
        text.alias("text"),
        F.col("dated.day").alias("day"),
        dropped.alias("dropped"),
        checked.alias("checked"),
        ((field == "rfq_type") & v.type_fell_back(raw)).alias("fell_back"),
    )
    warning = F.coalesce("checked", F.when(F.col("dropped") != "", F.col("dropped")), F.when(F.col("fell_back"), TYPE_FELL_BACK))
    return long.select("rfq_id", "field", "value", "source", "text", "day", "dropped", "checked", warning.alias("warning"))


def identity() -> list[Column]:
    """What makes two rows of a request the same row."""
    return [
        collapsed(F.col("customer_item_code")).alias("id_code"),
        collapsed(F.col("description")).alias("id_description"),
        collapsed(F.col("quantity")).alias("id_quantity"),
    ]


IDENTITY = ["id_code", "id_description", "id_quantity"]


def marked_together(rows: DataFrame, key: str, marks: list[Column]) -> DataFrame:
    """The rows that have a key, with these marks, equal ones in one place. The marks are made there, not sent along."""
    return rows.where(F.col(key).isNotNull()).repartition(key, *marks).select("*", *marks)


def merge_sources(items: DataFrame) -> DataFrame:
    """Rows of a request over its files, those an earlier file already gave left out, renumbered 1..n.

    `items` carries `rfq_id`, `file_ord` and `ord` (the order over all files). Repeats inside one file stay.
    """
    marked = marked_together(items, "rfq_id", identity())
    same = Window.partitionBy("rfq_id", *IDENTITY)
    fresh = marked.withColumn("first_file", F.min("file_ord").over(same)).where("file_ord = first_file")
    # Numbering reads the rows twice.
    return number_rows(stored(fresh.drop(*IDENTITY, "first_file"), "fresh"), ["rfq_id"], "ord", "sr_no")


def merge_warnings(items: DataFrame, merged: DataFrame, rfqs: DataFrame) -> DataFrame:
    """(rfq_id, file_ord, warning): files that only repeat others, and requests without any row."""
    kept = merged.select("rfq_id", "file_ord").distinct()
    repeated = items.select("rfq_id", "file_ord").distinct().join(kept, ["rfq_id", "file_ord"], "left_anti")
    empty = rfqs.select("rfq_id").join(items.select("rfq_id").distinct(), "rfq_id", "left_anti")
    return repeated.withColumn("warning", F.lit(DUPLICATE_SOURCE)).unionByName(
        empty.select("rfq_id", F.lit(None).cast("long").alias("file_ord"), F.lit(NO_ITEMS).alias("warning"))
    )


def quantity_conflicts(merged: DataFrame) -> DataFrame:
    """(rfq_id, sr_no, conflict): rows asking another quantity of an article than the first file that named it."""
    rows = merged.select(
        "rfq_id", "sr_no", "description", "quantity", "customer_item_code", F.substring_index("source", "#", 1).alias("file")
    )
    named = marked_together(rows, "rfq_id", identity()[:2]).withColumn("plain_quantity", collapsed(F.col("quantity")))
    article = ["rfq_id", "id_code", "id_description"]
    first = F.min_by(F.struct(F.col("plain_quantity").alias("written"), F.col("file").alias("where")), "sr_no")
    other = (F.col("file") != F.col("first.where")) & (F.col("plain_quantity") != F.col("first.written"))
    shown = F.left(F.coalesce("description", F.lit("")), F.lit(ARTICLE_CHARS))
    return named.withColumn("first", first.over(Window.partitionBy(*article))).where(other).select(
        "rfq_id",
        "sr_no",
        F.format_string(
            '%s: %s in "%s", %s in "%s"', shown, F.coalesce("quantity", F.lit("None")), F.col("file"),
            F.col("first.written"), F.col("first.where"),
        ).alias("conflict"),
    )


def stitch_parts(items: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows read from overlapping parts of a document, seams removed, renumbered.

    `items` carries `doc_id`, `part_no`, `ord` and the page cited; `parts` the labels of each part. Part one is kept
    as read; later parts give only rows not seen before. A cited page counts only when the part holds it.

    Rows meet a table of the parts once; a part holds a few pages, so their labels are one value of it.
    """
    marked = marked_together(items, "doc_id", identity())
    seen = marked.withColumn("first_ord", F.min("ord").over(Window.partitionBy("doc_id", *IDENTITY))).drop(*IDENTITY)
    leads = items.select("doc_id", "part_no").distinct().withColumn(
        "first_part", F.min("part_no").over(Window.partitionBy("doc_id"))
    )
    names = parts.groupBy("doc_id", "part_no").agg(F.min("label").alias("part_label"), F.collect_set("label").alias("labels"))
    sourced = (
        seen.withColumn("page", strip(F.coalesce("page", F.lit(""))))
        .join(leads.join(names, ["doc_id", "part_no"], "left"), ["doc_id", "part_no"], "left")
        .where("part_no = first_part or ord = first_ord")
        .withColumn(
            "source",
            F.when(F.array_contains("labels", F.col("page")), F.col("page")).otherwise(F.coalesce("part_label", F.lit(""))),
        )
    )
    # Numbering reads the rows twice.
    kept = stored(sourced.drop("first_ord", "first_part", "part_label", "labels"), "stitched")
    return number_rows(kept, ["doc_id"], "ord", "sr_no")


def completeness(rfqs: DataFrame, header: DataFrame, items: DataFrame) -> DataFrame:
    """(rfq_id, missing array, complete): starred fields without a value, in form order."""
    present = (
        header.where(F.col("field").isin(REQUIRED_FIELDS) & (F.col("text").isNotNull() | F.col("day").isNotNull()))
        .groupBy("rfq_id")
        .agg(F.collect_set("field").alias("present"))
    )
    counted = items.groupBy("rfq_id").agg(F.count(F.lit(1)).alias("items"))
    required = F.array(*[F.lit(field) for field in REQUIRED_FIELDS])
    missing = F.array_except(required, F.coalesce("present", F.array().cast("array<string>")))
    return rfqs.select("rfq_id").join(present, "rfq_id", "left").join(counted, "rfq_id", "left").select(
        "rfq_id",
        missing.alias("missing"),
        (F.coalesce("items", F.lit(0)) > 0).alias("has_items"),
        ((F.coalesce("items", F.lit(0)) > 0) & (F.size(missing) == 0)).alias("complete"),
    )


def why_blank(complete: DataFrame, header: DataFrame, explained: DataFrame) -> DataFrame:
    """(rfq_id, line_no, line): starred empty fields first, then other fields that were dropped, with the reason.

    A request has as many lines as a form has fields.
    """
    dropped = header.where("dropped is not null").select("rfq_id", "field", "dropped")
    starred = complete.select("rfq_id", F.posexplode("missing").alias("place", "field"))
    place = F.array_position(F.array(*[F.lit(one) for one in STANDARD_ORDER]), F.col("field")) + 100
    others = dropped.join(starred.select("rfq_id", "field"), ["rfq_id", "field"], "left_anti").select(
        "rfq_id", place.cast("int").alias("place"), "field"
    )
    reasons = explained.where("why is not null").select("rfq_id", "field", "why")
    named = starred.unionByName(others).join(dropped, ["rfq_id", "field"], "left").join(reasons, ["rfq_id", "field"], "left")
    detail = F.coalesce(lookup(F.col("dropped"), REASONS), F.col("why"))
    order = Window.partitionBy("rfq_id").orderBy("place")
    return named.select(
        "rfq_id",
        F.row_number().over(order).cast("long").alias("line_no"),
        F.concat_ws(": ", label(F.col("field")), detail).alias("line"),
    )


def unread_files(documents: DataFrame) -> DataFrame:
    """(rfq_id, file_ord, said): files that gave neither rows nor facts, with the reasons in the order they came.

    `documents` carries `origin`, `items`, `facts` (counts) and `warnings` (an array of codes); containers stay silent.
    """
    codes = F.array_distinct("warnings")
    told = F.array_compact(F.transform(codes, lambda code: lookup(code, FILE_REASONS)))
    reason = F.when(F.size(told) > 0, F.array_join(told, ", ")).when(
        F.array_contains(codes, NOTHING_TO_READ), F.lit(NOTHING_IN_IT)
    )
    empty = documents.where("items = 0 and facts = 0")
    return empty.withColumn("reason", reason).where("reason is not null").select(
        "rfq_id", "file_ord", F.concat_ws(": ", "origin", "reason").alias("said")
    )


def capped_entries(entries: DataFrame, keys: list[str], limit: int, tail: str) -> DataFrame:
    """The first `limit` entries per key and a line saying how many more there are.

    `entries` carries `ord` and `entry`. Only the entries shown are ever sorted together; the rest are counted.
    """
    first = Window.partitionBy(*keys).orderBy("ord")
    shown = entries.select(*keys, "entry", F.row_number().over(first).alias("line_no")).where(F.col("line_no") <= limit)
    more = (
        entries.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("entries"))
        .where(F.col("entries") > limit)
        .select(*keys, F.format_string(tail, F.col("entries") - limit).alias("entry"), F.lit(limit + 1).alias("line_no"))
    )
    return shown.unionByName(more)


def remarks(sections: DataFrame) -> DataFrame:
    """(rfq_id, remarks): each section's heading and at most twelve entries, then how many more.

    `sections` carries `rfq_id`, `section`, `heading`, `ord`, `entry`.
    """
    lines = capped_entries(
        sections, ["rfq_id", "section", "heading"], MOST_REMARKS, "and %d more, see the forwarded email"
    )
    blocks = lines.groupBy("rfq_id", "section", "heading").agg(
        F.array_join(
            F.concat(F.array(F.col("heading")), ordered_list(F.concat(F.lit("  - "), "entry"), "line_no")), "\n"
        ).alias("block")
    )
    return blocks.groupBy("rfq_id").agg(F.array_join(ordered_list(F.col("block"), "section"), "\n").alias("remarks"))


def form_cells(header: DataFrame, items: DataFrame, last_row: int | None = LAST_ITEM_ROW) -> DataFrame:
    """(rfq_id, cell, kind, value): what goes into which cell of the form.

    Rows past `last_row`, where the printed form ends, are cut and told by `form_warnings`; None is a form without end.
    """
    shown_day = F.date_format("day", "yyyy-MM-dd")
    number = F.when(F.col("field") == "imo", v.plain_number(F.col("text")))
    head = header.where("text is not null or day is not null").select(
        "rfq_id",
        lookup(F.col("field"), FORM_CELLS).alias("cell"),
        F.when(F.col("day").isNotNull(), "day").when(number.isNotNull(), "number").otherwise("text").alias("kind"),
        F.coalesce(shown_day, "text").alias("value"),
    )

    def kind(column: Column) -> Column:
        return F.when(v.plain_number(column).isNotNull(), "number").otherwise("text")

    row = (F.col("sr_no") + FIRST_ITEM_ROW - 1).cast("string")
    code, quantity = F.col("customer_item_code"), F.col("quantity")
    cells = [
        (F.concat(F.lit("A"), row), F.lit("number"), F.col("sr_no").cast("string")),
        (F.concat(F.lit("B"), row), kind(code), code),
        (F.concat(F.lit("D"), row), F.lit("text"), F.col("description")),
        (F.concat(F.lit("E"), row), kind(quantity), quantity),
        (F.concat(F.lit("F"), row), F.lit("text"), F.upper("uom")),
    ]
    structs = [F.struct(c.alias("cell"), k.alias("kind"), x.alias("value")) for c, k, x in cells]
    fitting = items if last_row is None else items.where(F.col("sr_no") <= last_row - FIRST_ITEM_ROW + 1)
    body = fitting.select("rfq_id", F.explode(F.array(*structs)).alias("c")).select(
        "rfq_id", "c.*"
    )
    return head.unionByName(body.where("value is not null and value <> ''"))


def form_warnings(items: DataFrame, last_row: int = LAST_ITEM_ROW) -> DataFrame:
    room = last_row - FIRST_ITEM_ROW + 1
    return items.where(F.col("sr_no") > room).select("rfq_id", F.lit(ITEMS_TRUNCATED).alias("warning")).distinct()


def goods_sample(items: DataFrame) -> DataFrame:
    """(rfq_id, goods): the first twenty described rows of each request, shortened, then how many more."""
    described = items.where(F.coalesce("description", F.lit("")) != "").select(
        "rfq_id", F.col("sr_no").alias("ord"), shortened(F.col("description"), GOODS_CHARS).alias("entry")
    )
    lines = capped_entries(described, ["rfq_id"], GOODS_SHOWN, "... and %d more")
    return lines.groupBy("rfq_id").agg(
        F.array_join(ordered_list(F.concat(F.lit("- "), "entry"), "line_no"), "\n").alias("goods")
    )


def forward_note(
    forms: DataFrame, unread: DataFrame, conflicts: DataFrame, blanks: DataFrame, form_name: str = "RFQ form"
) -> DataFrame:
    """(rfq_id, section, line_no, line): what the desk is told with a forwarded request, line by line.

    `forms` carries `rfq_id`, `filename`, `items`, `attached`, `decision_id`. Blanks are cut after six with the count
    of the rest; unread files and disagreeing quantities are told in full.
    """
    attached = F.format_string(f"Auto-filled {form_name} attached: %s (%d item(s)).", "filename", "items")
    lost = F.format_string(
        f"An auto-filled {form_name} was produced but could not be attached to this forward. "
        "It is on the agent's disk under decision %s.",
        F.coalesce("decision_id", F.lit("unknown")),
    )

    def single(df: DataFrame, section: int, line: Column) -> DataFrame:
        return df.select("rfq_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("line_no"), line.alias("line"))

    def entries(df: DataFrame, section: int, order: str, line: Column) -> DataFrame:
        return df.select("rfq_id", F.lit(section).alias("section"), F.col(order).cast("long").alias("line_no"), line.alias("line"))

    def held(df: DataFrame) -> DataFrame:
        counted = df.groupBy("rfq_id").agg(F.count(F.lit(1)).alias("entries"))
        return counted.join(forms.select("rfq_id"), "rfq_id", "left_semi")

    known = forms.select("rfq_id")
    files = unread.join(known, "rfq_id", "left_semi")
    disagreeing = conflicts.join(known, "rfq_id", "left_semi")
    listed = capped_entries(
        blanks.join(known, "rfq_id", "left_semi").select("rfq_id", F.col("line_no").alias("ord"), F.col("line").alias("entry")),
        ["rfq_id"], BLANKS_LISTED, "and %d more, in the block under the form",
    )
    parts = [
        single(forms, 1, F.when(F.col("attached"), attached).otherwise(lost)),
        single(forms.where("items = 0"), 2, F.lit("No line items could be read out of this RFQ - the item grid is empty.")),
        single(held(files), 3, F.format_string("%d attached file(s) could not be read - please check by hand:", "entries")),
        entries(files, 4, "file_ord", F.col("said")),
        single(held(disagreeing), 5, F.lit("Two attachments disagree on a quantity - check before quoting:")),
        entries(disagreeing, 6, "sr_no", F.col("conflict")),
        single(held(blanks), 7, F.lit("Left blank, please complete by hand:")),
        entries(listed, 8, "line_no", F.concat(F.lit("- "), "entry")),
        single(forms, 9, F.lit("Filled by an automated agent - check it against the customer's own files.")),
    ]
    note = parts[0]
    for part in parts[1:]:
        note = note.unionByName(part)
    return note


def extraction_journal(documents: DataFrame, header: DataFrame, complete: DataFrame, merged: DataFrame) -> DataFrame:
    """(rfq_id, part, ord, payload): one JSON payload per document, per header field and per request.

    `documents` carries the counts of each document (grids, pages, images, text_chars) and its role.
    """
    per_document = documents.select(
        "rfq_id",
        F.lit("document").alias("part"),
        F.col("file_ord").cast("long").alias("ord"),
        F.to_json(F.struct("origin", "grids", "pages", "images", "text_chars", "role", "items")).alias("payload"),
    )
    place = F.array_position(F.array(*[F.lit(one) for one in HEADER_FIELDS]), F.col("field"))
    per_field = header.select(
        "rfq_id",
        F.lit("header").alias("part"),
        place.cast("long").alias("ord"),
        F.to_json(
            F.struct(
                "field", F.col("value").alias("raw"), "source",
                F.coalesce("text", F.date_format("day", "yyyy-MM-dd")).alias("value"), "dropped",
            )
        ).alias("payload"),
    )
    counts = merged.groupBy("rfq_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("source").alias("sources"))
    whole = complete.join(counts, "rfq_id", "left").select(
        "rfq_id",
        F.lit("request").alias("part"),
        F.lit(0).cast("long").alias("ord"),
        F.to_json(
            F.struct(
                F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("sources", F.lit(0)).alias("sources"),
                "complete", F.col("missing").alias("missing_required"),
            )
        ).alias("payload"),
    )
    return whole.unionByName(per_document).unionByName(per_field)
