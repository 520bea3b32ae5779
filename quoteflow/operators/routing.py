"""Who wrote, what a verdict leads to, which desk it goes to, and how much of an e-mail may be opened."""

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions import text as x
from quoteflow.functions.values import strip
from quoteflow.operators.common import broadcast_if_small, ordered_list

# Fixed values.
RFQ_FORMS = ["RFQ_FORM_XLSX", "RFQ_FORM_PDF"]
CATEGORY_ACTION = [
    ("NEW_RFQ", "FORWARD_TO_DST"), ("UPDATED_RFQ", "FORWARD_TO_DST"), ("PORTAL_RFQ_NOTIFICATION", "FORWARD_TO_DST"),
    ("CUSTOMER_ORDER_PO", "ROUTE_TO_ORDER_TEAM"), ("CUSTOMER_CLARIFICATION", "ROUTE_TO_CS"),
    ("SUPPLIER_CORRESPONDENCE", "ROUTE_TO_SOURCING"), ("QUOTE_STATUS_NOTIFICATION", "ROUTE_TO_CS"),
    ("INTERNAL", "IGNORE"), ("OUTBOUND_OWN", "IGNORE"), ("SPAM_MARKETING", "IGNORE"), ("AUTO_REPLY_SYSTEM", "IGNORE"),
    ("OTHER_NON_ACTIONABLE", "IGNORE"), ("UNCERTAIN", "HUMAN_REVIEW"),
]
RFQ_CATEGORIES = ["NEW_RFQ", "UPDATED_RFQ", "PORTAL_RFQ_NOTIFICATION"]
REVIEW_BELOW = 0.60
AUTO_FROM = 0.85
INTERNAL_ONLY_CONFIDENCE = 0.97
EMPTY_BODY_CONFIDENCE = 0.95
MIN_BODY_CHARS = 10
MEGABYTE = 1024 * 1024
MOST_ATTACHMENTS = 20
MOST_TOTAL_BYTES = 40 * MEGABYTE
MOST_SINGLE_BYTES = 25 * MEGABYTE
INLINE_NOISE_BYTES = 15 * 1024
MOST_IMAGES = 10
FILE_TOO_LARGE = "file_too_large"
TOTAL_SIZE_EXCEEDED = "total_attachment_size_exceeded"
TOO_MANY_ATTACHMENTS = "too_many_attachments"
IS_LINK = "attachment_is_a_link"
NO_BYTES = "attachment_has_no_bytes"
UNDELIVERED = ["NO_REGION", "NO_ADDRESS", "FAILED"]

Rules = Sequence[tuple[str, Sequence[str]]]


def classify_sender(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """Messages with `sender_class`, the most specific registry the sender is in.

    `messages` carries `address`; `registry` has `kind` (system_sender, own, portal, customer, supplier) and `entry`, an
    address for system senders and a domain otherwise.
    """
    entries = registry.select("kind", F.lower(strip("entry")).alias("entry"))
    domains = entries.where("kind <> 'system_sender'").groupBy(F.col("entry").alias("domain")).agg(
        F.collect_set("kind").alias("kinds")
    )
    systems = entries.where("kind = 'system_sender'").select(
        F.col("entry").alias("address_key"), F.lit(True).alias("is_system")
    ).distinct()
    keyed = messages.withColumn("domain", x.address_domain(F.col("address"))).withColumn(
        "address_key", F.lower("address")
    )
    joined = keyed.join(broadcast_if_small(domains), "domain", "left").join(
        broadcast_if_small(systems), "address_key", "left"
    )

    def listed(kind: str) -> Column:
        return F.array_contains("kinds", kind)

    found = (
        F.when(F.coalesce("domain", F.lit("")) == "", "UNKNOWN")
        .when(F.col("is_system"), "INTERNAL_SYSTEM")
        .when(listed("own"), "INTERNAL_OWN")
        .when(listed("portal"), "PORTAL")
        .when(listed("customer"), "KNOWN_CUSTOMER")
        .when(listed("supplier"), "KNOWN_SUPPLIER")
        .otherwise("EXTERNAL_UNKNOWN")
    )
    return joined.select(*messages.columns, "domain", found.alias("sender_class"))


def holds_any(lowered: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word.lower())
    return found


def find_portal(domain: Column, text: Column, domains: Rules, markers: Rules) -> Column:
    """The portal of the sender's domain, else the first whose marker stands in the text."""
    lowered = F.lower(text)
    by_domain = [F.when(F.lower(domain).isin(list(entries)), name) for name, entries in domains]
    by_text = [F.when(holds_any(lowered, entries), name) for name, entries in markers]
    return F.coalesce(*by_domain, *by_text)


def matching_markers(text: Column, groups: Rules) -> Column:
    """Names of the groups with a marker in the text, in the order they are registered."""
    lowered = F.lower(text)
    return F.array_compact(F.array(*[F.when(holds_any(lowered, entries), name) for name, entries in groups]))


def recipients_internal_only(recipients: Column, own_domains: Sequence[str]) -> Column:
    """Whether there are recipients and all of them are our own people."""
    own = list(own_domains)
    inside = F.forall(recipients, lambda address: F.coalesce(x.address_domain(address).isin(own), F.lit(False)))
    return (F.size(recipients) > 0) & inside


def build_hints(
    messages: DataFrame, registry: DataFrame, domains: Rules, markers: Rules, groups: Rules, own_domains: Sequence[str]
) -> DataFrame:
    """Everything rules can say about the newest message of each e-mail.

    `messages` carries `address`, `recipients`, `subject`, `newest`, `attachments` and `quoted_count`.
    """
    placed = classify_sender(messages, registry)
    said = F.concat_ws("\n", F.when(F.col("subject") != "", F.col("subject")), F.col("newest"))
    kinds = F.transform("attachments", lambda one: one["kind"])
    return placed.withColumns(
        {
            "portal": find_portal(F.col("domain"), F.col("newest"), domains, markers),
            "recipients_internal_only": recipients_internal_only(F.col("recipients"), own_domains),
            "subject_prefixes": x.subject_prefixes(F.col("subject")),
            "attachment_kinds": F.array_sort(F.array_distinct(kinds)),
            "marker_hits": matching_markers(F.col("newest"), groups),
            "signals": x.extract_signals(said),
            "is_reply": F.col("quoted_count") > 0,
        }
    )


def fast_path(messages: DataFrame, own_domains: Sequence[str]) -> DataFrame:
    """Messages with `rule`, `category`, `direction` and `confidence`; null where a model has to decide.

    `messages` carries `address`, `recipients`, `attachment_count` and `newest`.
    """
    own = F.coalesce(x.address_domain(F.col("address")).isin(list(own_domains)), F.lit(False))
    internal = own & recipients_internal_only(F.col("recipients"), own_domains)
    empty = (F.col("attachment_count") == 0) & (F.length(x.strip(F.col("newest"))) < MIN_BODY_CHARS)

    def either(first, second) -> Column:
        return F.when(internal, first).when(empty, second)

    return messages.withColumns(
        {
            "rule": either("R1_internal_only", "R2_empty_body"),
            "category": either("INTERNAL", "OTHER_NON_ACTIONABLE"),
            "direction": either("INTERNAL", "UNKNOWN"),
            "confidence": either(INTERNAL_ONLY_CONFIDENCE, EMPTY_BODY_CONFIDENCE),
        }
    )


def to_be_asked(decided: DataFrame) -> DataFrame:
    return decided.where("rule is null")


def strong_rfq_signal(signals: Column, attachment_kinds: Column) -> Column:
    """Whether a message looks like a request whatever was answered: a form, a day quotes are due, or a reference."""
    form = F.arrays_overlap(attachment_kinds, F.array(*[F.lit(one) for one in RFQ_FORMS]))
    said = [F.coalesce(signals[name], F.lit("")) != "" for name in ("quote_due_date", "rfq_reference")]
    return F.coalesce(form, F.lit(False)) | said[0] | said[1]


def finalize_policy(drafts: DataFrame) -> DataFrame:
    """Verdicts with their action, review flag, priority, path and the guardrails that fired.

    `drafts` carries `category`, `confidence`, `answered_is_rfq` (null when not asked), `priority`, `decision_path`, and
    either the hints `signals` and `attachment_kinds` or what follows from them, `strong_signal` and `urgent`. The action
    follows from the category and is never taken from an answer.
    """
    if "signals" in drafts.columns:
        marks = F.col("signals.urgency_markers")
        drafts = drafts.withColumns(
            {"strong_signal": strong_rfq_signal(F.col("signals"), F.col("attachment_kinds")), "urgent": F.coalesce(F.size(marks) > 0, F.lit(False))}
        )
    mapped = F.coalesce(*[F.when(F.col("category") == one, action) for one, action in CATEGORY_ACTION])
    is_rfq = F.col("category").isin(RFQ_CATEGORIES)
    low = F.col("confidence") < REVIEW_BELOW
    unsure = F.col("confidence") < AUTO_FROM
    action = F.when(low, "HUMAN_REVIEW").otherwise(mapped)
    signal = (action == "IGNORE") & F.col("strong_signal")
    hits = F.array_compact(
        F.array(
            F.when(F.col("answered_is_rfq").isNotNull() & (F.col("answered_is_rfq") != is_rfq), "guardrail:is_rfq_mismatch"),
            F.when(low, "guardrail:low_confidence").when(unsure, "guardrail:confidence_below_auto"),
            F.when(signal, "guardrail:rfq_signal_in_ignored_email"),
        )
    )
    path = F.when(signal & (F.col("decision_path") == "LLM"), "LLM_WITH_GUARDRAIL_OVERRIDE").otherwise(F.col("decision_path"))
    return drafts.withColumns(
        {
            "is_rfq": is_rfq,
            "recommended_action": action,
            "requires_action": action != "IGNORE",
            "needs_human_review": unsure | signal,
            "confidence": F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)),
            "priority": F.when(F.col("urgent"), "URGENT").otherwise(F.col("priority")),
            "decision_path": path,
            "rule_hits": hits,
        }
    )


def outlook_labels(
    action: Column, needs_review: Column, by_action: Sequence[tuple[str, str]], review_label: str
) -> Column:
    """The one label of a decision; a waiting review replaces it."""
    routed = F.coalesce(*[F.when(action == one, label) for one, label in by_action])
    return F.when(needs_review, F.array(F.lit(review_label))).otherwise(F.array_compact(F.array(routed)))


def plus_label(labels: Column, label: str) -> Column:
    return F.when(F.array_contains(labels, label), labels).otherwise(F.concat(labels, F.array(F.lit(label))))


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(word)}(?![\p{{L}}\p{{N}}_])")


def resolve_region(
    regions: Sequence[tuple[str, dict[str, Sequence[str]]]], hint: Column, port: Column, text: Column, mailbox: Column
) -> Column:
    """struct(region, rule): the desk the first telling rule names; two desks at once name none and end the search.

    Each region lists `ports`, `keywords` and `mailbox` markers in lower case.
    """
    lowered_text, lowered_port = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(port, F.lit("")))
    hinted = F.lower(strip(F.coalesce(hint, F.lit(""))))
    marks = F.split(F.lower(F.coalesce(mailbox, F.lit(""))), "[^a-z0-9]+")

    def named(test) -> Column:
        return F.array_compact(F.array(*[F.when(test(key, words), key) for key, words in regions]))

    def any_of(tests: list[Column]) -> Column:
        found = F.lit(False)
        for test in tests:
            found = found | test
        return found

    rules = [
        ("region_hint", named(lambda key, _: hinted == key)),
        ("delivery_port", named(lambda _, words: any_of([lowered_port.contains(p) for p in words["ports"]]))),
        ("keyword", named(lambda _, words: any_of([whole_word(lowered_text, w) for w in words["keywords"]]))),
        ("mailbox", named(lambda _, words: F.arrays_overlap(marks, F.array(*[F.lit(m) for m in words["mailbox"]])))),
    ]
    found = F.array(*[F.struct(F.lit(rule).alias("rule"), keys.alias("keys")) for rule, keys in rules])
    first = F.try_element_at(F.filter(found, lambda one: F.size(one["keys"]) > 0), F.lit(1))
    one = F.size(first["keys"]) == 1
    return F.when(one, F.struct(first["keys"][0].alias("region"), first["rule"].alias("rule")))


def delivery_outcome(deliveries: DataFrame, enabled: bool = True) -> DataFrame:
    """Requests with `outcome`, the region that counted and whether the not-sent label is due.

    `deliveries` carries `needs_human_review`, the region by the verdict and by the header (the header's wins), the
    desk's `forward_to` for the region that counts, and `sent`.
    """
    region = F.coalesce("header_region", "verdict_region")
    outcome = (
        F.when(F.lit(not enabled), "DISABLED")
        .when(F.col("needs_human_review"), "UNSURE")
        .when(region.isNull(), "NO_REGION")
        .when(F.coalesce("forward_to", F.lit("")) == "", "NO_ADDRESS")
        .when(F.col("sent"), "SENT")
        .otherwise("FAILED")
    )
    shown = outcome.isin("NO_ADDRESS", "SENT", "FAILED")
    return deliveries.withColumns(
        {
            "outcome": outcome,
            "region": F.when(shown, region),
            "not_sent_label": outcome.isin(UNDELIVERED),
        }
    )


def already_handled(labels: Column, our_labels: Sequence[str]) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(one) for one in our_labels]))


def image_budget(files: DataFrame) -> DataFrame:
    """Files with `images_kept`: ten images to an e-mail, an equal share each, the rest to whoever wants more.

    `files` carries `email_id`, `ord`, `images`. When more files want images than there are slots, the first get one
    each; so no more than the first ten files of an e-mail are ever sorted.
    """
    claims = files.where(F.col("images") > 0)
    wanted = claims.groupBy("email_id").agg(
        F.sum("images").alias("wanted"), F.count(F.lit(1)).alias("claimants")
    )
    in_order = Window.partitionBy("email_id").orderBy("ord")
    first = claims.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= MOST_IMAGES)
    shared = first.join(wanted, "email_id").withColumn("share", F.floor(F.lit(MOST_IMAGES) / F.col("claimants")))
    given = shared.withColumn("given", F.least("images", "share")).withColumn("unmet", F.col("images") - F.col("given"))
    spare = F.lit(MOST_IMAGES) - F.sum("given").over(Window.partitionBy("email_id"))
    before = F.coalesce(F.sum("unmet").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("unmet"), spare - before))
    kept = (
        F.when(F.col("wanted") <= MOST_IMAGES, F.col("images"))
        .when(F.col("share") == 0, F.lit(1))
        .otherwise(F.col("given") + extra)
    )
    told = given.withColumn("images_kept", kept).select("email_id", "ord", "images_kept")
    joined = files.join(told, ["email_id", "ord"], "left")
    count = F.coalesce("images_kept", F.lit(0)).cast("long")
    return joined.withColumn("images_kept", count).withColumn("images_truncated", F.col("images_kept") < F.col("images"))


def attachment_budget(files: DataFrame) -> DataFrame:
    """Files with `blocked`, the reason each may not be opened, null when it may.

    `files` carries `email_id`, `ord`, `size_bytes`, `is_inline`, `is_reference`, `has_bytes`, and `data_bytes`, the
    length of what is there, if that is known. An unknown size is that length, else nothing. Signature images are left
    out. The first twenty files take the slots, and only their sizes are gone through in order; every file after them is
    one too many.
    """
    there = F.col("data_bytes") if "data_bytes" in files.columns else F.lit(None)
    size = F.coalesce(F.when(F.col("size_bytes") != 0, F.col("size_bytes")), there, F.lit(0)).cast("long")
    files = files.withColumns({
        "size_bytes": size,
        **{name: F.coalesce(F.col(name), F.lit(False)) for name in ("is_inline", "is_reference", "has_bytes")},
    })
    noise = F.col("is_inline") & (F.col("size_bytes") <= INLINE_NOISE_BYTES)
    real = files.where(~noise)
    opened = real.where(~F.col("is_reference") & F.col("has_bytes"))
    in_order = Window.partitionBy("email_id").orderBy("ord")
    slots = opened.select("email_id", "ord", "size_bytes", F.row_number().over(in_order).alias("slot")).where(
        F.col("slot") <= MOST_ATTACHMENTS
    )
    listed = slots.groupBy("email_id").agg(ordered_list(F.struct("ord", "size_bytes"), "slot").alias("files"))

    def open_next(state: Column, file: Column) -> Column:
        reason = F.when(file["size_bytes"] > MOST_SINGLE_BYTES, FILE_TOO_LARGE).when(
            state["bytes"] + file["size_bytes"] > MOST_TOTAL_BYTES, TOTAL_SIZE_EXCEEDED
        )
        return F.struct(
            F.when(reason.isNull(), state["bytes"] + file["size_bytes"]).otherwise(state["bytes"]).alias("bytes"),
            F.concat(
                state["told"], F.array(F.struct(file["ord"].alias("ord"), F.coalesce(reason, F.lit("")).alias("reason")))
            ).alias("told"),
        )

    start = F.struct(
        F.lit(0).cast("long").alias("bytes"), F.array().cast("array<struct<ord:bigint,reason:string>>").alias("told")
    )
    told = listed.select("email_id", F.inline(F.aggregate("files", start, open_next, lambda s: s["told"])))
    joined = real.join(told, ["email_id", "ord"], "left")
    blocked = (
        F.when(F.col("is_reference"), IS_LINK)
        .when(~F.col("has_bytes"), NO_BYTES)
        .when(F.col("reason").isNull(), TOO_MANY_ATTACHMENTS)
        .when(F.col("reason") != "", F.col("reason"))
    )
    return joined.withColumn("blocked", blocked).drop("reason")
