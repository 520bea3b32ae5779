"""Quote lists and details, the actions people take on them, prices and totals."""

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions.values import quantity_number
from quoteflow.functions.words import normalize_code
from quoteflow.operators.common import first_wins, last_wins, left_join_filled
from quoteflow.sources.store import stored

# Requests in a range of the page directory, about.
RANGE_ROWS = 100_000
# A range is a folder and a task, which the driver keeps book of, so larger tables have larger ranges, not more.
MOST_RANGES = 500

# Fixed values.
MOST_PER_PAGE = 500
MOST_A_UNIT_COSTS = 10_000_000
MOST_A_MARGIN_IS = 1000
VALID_DAYS = 30
FORWARDED = "inProgress"
DEFAULT_STATUS = "new"
STATUS_BY_CATEGORY = [("CUSTOMER_ORDER_PO", "order"), ("CUSTOMER_CLARIFICATION", "replyReceived")]
DISCOUNT = "0.00"
VAT_RATE = "0.00"
BOOK_DISCOUNT = "0.0000000000001"
OK, NOT_FOUND, CONFLICT, UNPROCESSABLE = 204, 404, 409, 422


def quote_status(outcome: Column, category: Column) -> Column:
    """Where an e-mail stands: forwarded ones are in progress, otherwise by what they are."""
    by_category = F.coalesce(*[F.when(category == one, status) for one, status in STATUS_BY_CATEGORY])
    return F.when(outcome == "SENT", FORWARDED).otherwise(F.coalesce(by_category, F.lit(DEFAULT_STATUS)))


def quote_priority(priority: Column) -> Column:
    return F.when(priority == "URGENT", "HIGH").otherwise("NORMAL")


def newest_first() -> list[Column]:
    return [F.desc("received_at"), F.desc("record_id")]


@dataclass(frozen=True)
class PageDirectory:
    """Requests in ranges of their order, and for each range which rows of the whole it holds.

    `rows` has a folder for each `range_no`; `ranges` a row (`range_no`, `before`, `upto`, `total`) for each.
    """

    rows: DataFrame
    ranges: DataFrame


def page_directory(records: DataFrame, search: str = "", range_rows: int = RANGE_ROWS) -> PageDirectory:
    """The requests found, newest first, cut into ranges of about `range_rows`, more where they would be over `MOST_RANGES`;
    made once, read for every page.

    `records` carries `record_id`, `is_rfq`, `received_at`, `customer`, `labels`. The search text is looked for in the
    customer and the labels.
    """
    needle = search.strip().lower()
    haystack = F.lower(F.concat_ws(" ", F.coalesce("customer", F.lit("")), F.array_join("labels", " ")))
    found = records.where(F.col("is_rfq") & haystack.contains(needle))
    total = found.count()
    ranges = min(MOST_RANGES, max(1, -(-total // range_rows)))
    ranged = found.repartitionByRange(ranges, *newest_first()).withColumn("range_no", F.spark_partition_id())
    rows = stored(ranged, "ranges", by="range_no")
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, 0)
    # One row per range.
    counts = rows.groupBy("range_no").agg(F.count(F.lit(1)).alias("rows")).withColumn("upto", F.sum("rows").over(before))
    listed = counts.select("range_no", (F.col("upto") - F.col("rows")).alias("before"), "upto", F.lit(total).cast("long").alias("total"))
    return PageDirectory(rows, stored(listed, "directory"))


def read_page(directory: PageDirectory, page: int = 1, page_size: int = 25) -> DataFrame:
    """One page, each row with the number of requests found. Only the ranges that hold the page are read and sorted."""
    if page < 1 or not 1 <= page_size <= MOST_PER_PAGE:
        raise ValueError("page starts at 1 and holds 1 to 500 rows")
    first, end = (page - 1) * page_size, page * page_size
    held = directory.ranges.where((F.col("upto") > first) & (F.col("before") < end)).orderBy("range_no").collect()
    if not held:
        return directory.rows.drop("range_no").limit(0).withColumn("total", F.lit(0).cast("long"))
    rows = directory.rows.where(F.col("range_no").isin([one["range_no"] for one in held])).drop("range_no")
    shown = rows.orderBy(*newest_first()).offset(first - held[0]["before"] if first > held[0]["before"] else 0)
    return shown.limit(page_size).withColumn("total", F.lit(held[0]["total"]).cast("long"))


def list_quotes(records: DataFrame, search: str = "", page: int = 1, page_size: int = 25) -> DataFrame:
    """One page of requests, newest first, each row with the number of requests found."""
    return read_page(page_directory(records, search), page, page_size)


def header_value(header: Column, field: str) -> Column:
    """A header field out of its JSON: the value, else what was written; bare texts count too."""
    path = f"$.{field}"
    whole = F.get_json_object(header, path)
    inner = [F.get_json_object(header, f"{path}.{key}") for key in ("value", "raw")]
    bare = F.when(~whole.startswith("{"), whole)
    return F.coalesce(*[F.when(one != "", one) for one in inner], bare, F.lit(""))


def rfq_detail_lines(recorded: DataFrame, candidates: DataFrame, codes: DataFrame) -> DataFrame:
    """Lines as the detail page shows them: today's product where the code is still our own.

    `recorded` carries the line's record (`rfq_id`, `line_index`, `item_code`, `item_description`, `confidence`,
    `verbatim`, `query`, `confirmed_item_code`); `candidates` the shortlist with its scores; `codes` the code index. A
    confirmed code shows only if the list still spells it the same way, with its score in the shortlist or none.
    """
    own = codes.where("kind = 0").select(
        F.col("code_key"), F.col("code").alias("own_code"), F.col("description").alias("own_description")
    )
    recorded = recorded.withColumn("item_key", normalize_code(F.coalesce("item_code", F.lit("")))).withColumn(
        "confirmed_key", normalize_code(F.coalesce("confirmed_item_code", F.lit("")))
    )
    current = own.select(F.col("code_key").alias("item_key"), F.col("own_description").alias("current_description"))
    settled = own.select(
        F.col("code_key").alias("confirmed_key"), F.col("own_code").alias("settled_code"),
        F.col("own_description").alias("settled_description"),
    )
    scores = first_wins(
        candidates.select("rfq_id", "line_index", F.col("item_code").alias("settled_code"), "confidence", "rank"),
        ["rfq_id", "line_index", "settled_code"], ["rank"],
    ).select("rfq_id", "line_index", "settled_code", F.col("confidence").alias("settled_confidence"))
    joined = (
        left_join_filled(left_join_filled(recorded, current, "item_key"), settled, "confirmed_key")
        .join(scores, ["rfq_id", "line_index", "settled_code"], "left")
    )
    is_settled = F.coalesce(F.col("settled_code") == F.col("confirmed_item_code"), F.lit(False))
    said = F.when(F.coalesce("verbatim", F.lit("")) != "", F.col("verbatim")).otherwise(F.col("query"))
    return joined.select(
        "rfq_id",
        "line_index",
        said.alias("customer_description"),
        F.when(is_settled, F.col("settled_code")).otherwise(F.coalesce("item_code", F.lit(""))).alias("item_code"),
        F.when(is_settled, F.col("settled_description")).otherwise(F.col("item_description")).alias("item_description"),
        F.when(is_settled, F.col("settled_description"))
        .otherwise(F.coalesce("current_description", "item_description"))
        .alias("sheet_description"),
        F.when(is_settled, F.col("settled_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        is_settled.alias("settled"),
    )


def _exists(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys).distinct().withColumn(name, F.lit(True))


def confirm_lines(actions: DataFrame, lines: DataFrame, codes: DataFrame) -> DataFrame:
    """Each confirmation with its `status`; `item_code` null clears a line.

    The code must be one of our own, and the line must exist. `stored_code` is the code as the list spells it.
    """
    own = codes.where("kind = 0").select("code_key", F.col("code").alias("stored_code"))
    keyed = actions.withColumn("code_key", normalize_code(F.coalesce("item_code", F.lit(""))))
    joined = left_join_filled(keyed, own, "code_key").join(
        _exists(lines, ["rfq_id", "line_index"], "has_line"), ["rfq_id", "line_index"], "left"
    )
    unknown = (F.col("item_code").isNotNull() & F.col("stored_code").isNull()) | F.col("has_line").isNull()
    return joined.select(
        *actions.columns,
        F.when(F.col("item_code").isNotNull(), F.col("stored_code")).alias("stored_code"),
        F.when(unknown, NOT_FOUND).otherwise(OK).alias("status"),
    )


def final_confirmations(judged: DataFrame) -> DataFrame:
    """(rfq_id, line_index, confirmed_item_code) after the last accepted action per line."""
    taken = judged.where(F.col("status") == OK).select("rfq_id", "line_index", "ord", "stored_code")
    last = last_wins(taken, ["rfq_id", "line_index"], ["ord"])
    return last.select("rfq_id", "line_index", F.col("stored_code").alias("confirmed_item_code"))


def record_inquiries(letters: DataFrame, rfqs: DataFrame, existing: DataFrame) -> DataFrame:
    """Each batch of supplier letters with its `status`: the first sound one of a request goes, once.

    `letters` carries `rfq_id`, `ord` (of the batch) and `supplier`. A batch naming a supplier twice, for a request
    that does not exist or that already has letters, is refused.
    """
    named = letters.groupBy("rfq_id", "ord", "supplier").agg(F.count(F.lit(1)).alias("times"))
    batches = named.groupBy("rfq_id", "ord").agg(
        F.sum("times").alias("letters"), (F.max("times") == 1).alias("one_each")
    )
    known = batches.join(_exists(rfqs, ["rfq_id"], "known"), "rfq_id", "left").join(
        _exists(existing, ["rfq_id"], "asked"), "rfq_id", "left"
    )
    sound = F.col("one_each") & F.col("known").isNotNull() & F.col("asked").isNull()
    marked = known.withColumn("sound", sound)
    first = marked.where("sound").groupBy("rfq_id").agg(F.min("ord").alias("first_ord"))
    goes = F.coalesce(F.col("sound") & (F.col("ord") == F.col("first_ord")), F.lit(False))
    return marked.join(first, "rfq_id", "left").select(
        "rfq_id", "ord", "letters", F.when(goes, OK).otherwise(CONFLICT).alias("status")
    )


def standing_letters(letter_lines: DataFrame, judged: DataFrame) -> DataFrame:
    """The letters that stand, a row for each line they ask about: those of the one batch of a request that went.

    `letter_lines` carries `rfq_id`, `ord` (of the batch), `supplier`, `line_index`; `judged` comes from
    `record_inquiries`.
    """
    went = judged.where(F.col("status") == OK).select("rfq_id", "ord")
    return letter_lines.join(went, ["rfq_id", "ord"], "left_semi")


def asked_lines(standing: DataFrame) -> DataFrame:
    """(rfq_id, line_index, asked_ord): the lines suppliers were asked about, and since which action."""
    return standing.groupBy("rfq_id", "line_index").agg(F.min("ord").alias("asked_ord"))


def offer_bounds(unit_price: Column, clears: Column, has_line: Column) -> Column:
    """The status of an offer that is refused whatever went before it, else null."""
    sound = (unit_price > 0) & (unit_price <= MOST_A_UNIT_COSTS)
    return F.when(~clears & ~F.coalesce(sound, F.lit(False)), UNPROCESSABLE).when(~has_line, NOT_FOUND)


def record_offers(actions: DataFrame, lines: DataFrame, asked: DataFrame) -> DataFrame:
    """Each offer with its `status`; a null price clears the line's offer.

    `actions` carries `rfq_id`, `line_index`, `ord`, `acted_at`, `unit_price`, `clears`; `asked` the lines suppliers were
    asked about. Where it says since when (`asked_ord`), an offer before that is an answer to no question.
    """
    keys = ["rfq_id", "line_index"]
    since = F.min("asked_ord") if "asked_ord" in asked.columns else F.lit(None).cast("long")
    first = asked.groupBy(*keys).agg(since.alias("asked_ord"), F.lit(True).alias("was_asked"))
    joined = actions.join(_exists(lines, keys, "has_line"), keys, "left").join(first, keys, "left")
    asked_by_then = F.col("was_asked").isNotNull() & F.coalesce(F.col("asked_ord") < F.col("ord"), F.lit(True))
    status = F.coalesce(
        offer_bounds(F.col("unit_price"), F.col("clears"), F.col("has_line").isNotNull()),
        F.when(F.col("clears") | asked_by_then, OK).otherwise(CONFLICT),
    )
    return joined.select(*actions.columns, status.alias("status"))


def final_offers(judged: DataFrame) -> DataFrame:
    """Price and time of the last accepted action per line; both null once cleared."""
    taken = judged.where(F.col("status") == OK)
    last = last_wins(
        taken.select(
            "rfq_id", "line_index", "ord",
            F.when(~F.col("clears"), F.col("unit_price")).alias("offer_unit_price"),
            F.when(~F.col("clears"), F.col("acted_at")).alias("offer_received_at"),
        ),
        ["rfq_id", "line_index"], ["ord"],
    )
    return last.drop("ord")


def _priced(prices: DataFrame, lines: DataFrame) -> DataFrame:
    """(rfq_id, ord, priced): how many of a request's lines each approval prices."""
    given = prices.join(lines.select("rfq_id", "line_index").distinct(), ["rfq_id", "line_index"], "left_semi")
    return given.groupBy("rfq_id", "ord").agg(F.count_distinct("line_index").alias("priced"))


def approval_bounds(margin_stock: Column, margin_jit: Column, bad_price: Column, lines: Column, missing: Column) -> Column:
    """The status of an approval that is refused whatever went before it, else null.

    Numbers out of bounds (or no price at all: `bad_price` null) come first, then unknown requests (`lines` null), then
    lines without a price.
    """
    margins = margin_stock.between(0, MOST_A_MARGIN_IS) & margin_jit.between(0, MOST_A_MARGIN_IS)
    return (
        F.when(~margins | F.coalesce(bad_price, F.lit(True)), UNPROCESSABLE)
        .when(lines.isNull(), NOT_FOUND)
        .when(missing > 0, UNPROCESSABLE)
    )


def approve_pricing(
    approvals: DataFrame, prices: DataFrame, lines: DataFrame, approved: DataFrame | None = None
) -> DataFrame:
    """Each approval with its `status` and how many lines it left without a price.

    `approvals` carries `rfq_id`, `ord`, the two margins; `prices` the priced lines of each. Numbers out of bounds are
    refused first, then unknown requests, then missing prices, then a second approval. `approved` names requests
    approved before.
    """
    needed = lines.groupBy("rfq_id").agg(F.count_distinct("line_index").alias("lines"))
    bad = (F.col("unit_price") <= 0) | (F.col("unit_price") > MOST_A_UNIT_COSTS)
    bounds = prices.groupBy("rfq_id", "ord").agg(F.max(bad).alias("bad_price"))
    joined = approvals.join(needed, "rfq_id", "left").join(_priced(prices, lines), ["rfq_id", "ord"], "left").join(
        bounds, ["rfq_id", "ord"], "left"
    )
    missing = F.col("lines") - F.coalesce("priced", F.lit(0))
    refused = approval_bounds(F.col("margin_stock"), F.col("margin_jit"), F.col("bad_price"), F.col("lines"), missing)
    before = approvals.select("rfq_id").limit(0) if approved is None else approved
    judged = joined.join(_exists(before, ["rfq_id"], "approved_before"), "rfq_id", "left").withColumn(
        "refused", F.coalesce(refused, F.when(F.col("approved_before"), CONFLICT))
    )
    first = judged.where("refused is null").groupBy("rfq_id").agg(F.min("ord").alias("first_ord"))
    return judged.join(first, "rfq_id", "left").select(
        *approvals.columns,
        F.coalesce("refused", F.when(F.col("ord") == F.col("first_ord"), OK).otherwise(CONFLICT)).alias("status"),
        F.coalesce(missing, F.lit(0)).alias("missing"),
    )


def frozen_prices(judged: DataFrame, prices: DataFrame, lines: DataFrame, offers: DataFrame) -> DataFrame:
    """What every approved request sells for, line by line, with the supplier's offer as it stood at the approval.

    `judged` are approvals with their `status` and `approved_at`; `offers` are judged offers. A request has one approval
    that took, so an offer meets at most one: the last one before it (none once cleared) is an aggregate by line, not a
    join of ranges. Lines the request does not have are left out; of two prices for a line the higher one stands.
    """
    keys = ["rfq_id", "line_index"]
    taken = judged.where(F.col("status") == OK).select("rfq_id", "ord", "approved_at", "margin_stock", "margin_jit")
    priced = (
        prices.join(lines.select(*keys).distinct(), keys, "left_semi")
        .groupBy(*keys, "ord").agg(F.max("unit_price").alias("approved_unit_price"))
        .join(taken, ["rfq_id", "ord"])
    )
    until = taken.select("rfq_id", F.col("ord").alias("until"))
    before = offers.where(F.col("status") == OK).join(until, "rfq_id").where(F.col("ord") < F.col("until"))
    return priced.drop("ord").join(final_offers(before), keys, "left")


def unpriced_lines(approvals: DataFrame, prices: DataFrame, lines: DataFrame) -> DataFrame:
    """(rfq_id, ord, line_index): the lines each approval left without a price.

    Counts say which approvals left any; only those meet their request's lines.
    """
    needed = lines.groupBy("rfq_id").agg(F.count_distinct("line_index").alias("lines"))
    counted = approvals.select("rfq_id", "ord").join(needed, "rfq_id").join(_priced(prices, lines), ["rfq_id", "ord"], "left")
    holes = counted.where(F.coalesce("priced", F.lit(0)) < F.col("lines")).select("rfq_id", "ord").distinct()
    return holes.join(lines.select("rfq_id", "line_index").distinct(), "rfq_id").join(
        prices.select("rfq_id", "ord", "line_index"), ["rfq_id", "ord", "line_index"], "left_anti"
    )


def line_totals(lines: DataFrame) -> DataFrame:
    """Lines with `amount`, `total`, `discount`, `tax` and `net`; null where price or quantity is none."""
    amount = quantity_number(F.col("quantity"))
    total = F.round(F.col("unit_price") * amount, 2).cast("decimal(18,2)")
    net_of_discount = F.col("total") - F.lit(DISCOUNT).cast("decimal(12,2)")
    tax = F.round(net_of_discount * F.lit(VAT_RATE).cast("decimal(12,2)") / F.lit(100).cast("decimal(3,0)"), 2)
    return lines.withColumn("amount", amount).withColumn("total", total).withColumns(
        {"discount": F.lit(DISCOUNT).cast("decimal(12,2)"), "tax": tax.cast("decimal(18,2)")}
    ).withColumn("net", (net_of_discount + F.col("tax")).cast("decimal(18,2)"))


def quotation_totals(totalled: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per quotation: subtotal, tax, grand total, last valid day, and the book's near-zero discount.

    `quotes` carries `rfq_id`, `approved_at`, `taxed`.
    """
    sums = totalled.groupBy("rfq_id").agg(F.sum("total").alias("subtotal"), F.sum("tax").alias("tax"))
    zero = F.lit("0.00").cast("decimal(18,2)")
    joined = quotes.join(sums, "rfq_id", "left")
    subtotal = F.coalesce(F.col("subtotal").cast("decimal(18,2)"), zero)
    tax = F.coalesce(F.col("tax").cast("decimal(18,2)"), zero)
    return joined.select(
        "rfq_id",
        subtotal.alias("subtotal"),
        F.when(F.col("taxed"), tax).alias("vat"),
        (subtotal + F.when(F.col("taxed"), tax).otherwise(zero)).cast("decimal(18,2)").alias("grand_total"),
        F.date_add(F.to_date("approved_at"), VALID_DAYS).alias("valid_till"),
        F.bround(subtotal * F.lit(BOOK_DISCOUNT).cast("decimal(14,13)"), 2).cast("decimal(18,2)").alias("book_discount"),
    )


def sheet_column(item: Column, heading: str) -> Column:
    """A column of the sheet row kept as a map, by a heading compared without blanks and case."""
    wanted = "".join(heading.split()).lower()
    entries = F.filter(
        F.map_entries(item), lambda entry: F.lower(F.regexp_replace(entry["key"], r"\s+", "")) == wanted
    )
    return F.coalesce(F.try_element_at(entries, F.lit(1))["value"], F.lit(""))


def quoted_lines(lines: DataFrame, headings: Mapping[str, str]) -> DataFrame:
    """Each line in three views: ours, the customer's own words from the sheet, and the book that shows both.

    `lines` carries `item`, the sheet row as a map; `headings` names its columns `uom`, `customer_code`,
    `customer_description`.
    """
    uom = F.when(F.coalesce("uom", F.lit("")) != "", F.col("uom")).otherwise(sheet_column(F.col("item"), headings["uom"]))
    theirs_code = sheet_column(F.col("item"), headings["customer_code"])
    theirs = sheet_column(F.col("item"), headings["customer_description"])
    views = F.array(
        F.struct(F.lit("ours").alias("view"), F.col("item_code").alias("code"), F.col("item_description").alias("description"),
                 F.lit("").alias("second_code"), F.lit("").alias("second_description")),
        F.struct(F.lit("customer").alias("view"), theirs_code.alias("code"), theirs.alias("description"),
                 F.lit("").alias("second_code"), F.lit("").alias("second_description")),
        F.struct(F.lit("book").alias("view"), F.col("item_code").alias("code"), F.col("item_description").alias("description"),
                 theirs_code.alias("second_code"), theirs.alias("second_description")),
    )
    return lines.select("rfq_id", "line_index", uom.alias("uom"), F.explode(views).alias("v")).select(
        "rfq_id", "line_index", "uom", "v.*"
    )
