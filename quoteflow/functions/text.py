"""Message text: normalised, cut into thread and headers, stripped of boilerplate, searched for signals."""

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import partial
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quoteflow.functions.values import let, strip

# Fixed values.
HEADER_KEYS = [
    "message", "message number", "from", "to", "cc", "bcc", "sent", "date", "subject", "attachments",
    "importance", "sensitivity",
]
CAUTION = r"(?i)^\s*CAUTION:\s*External\b"
HEADER_LINE = r"^([A-Za-z][A-Za-z ]{1,18}):\s*(.*)$"
BRACKETED_ADDRESS = r"\(\s*([^()\s]+@[^()\s]+)\s*\)"
DIVIDER = r"(?i)^[_-]{2,}\s*Original Message\s*[_-]{2,}\s*$"
MESSAGE_ID = r"(?i)^\s*Message(?: Number)?:\s*\d{4,}\s*$"
ON_WROTE = r"^On .{5,120}\bwrote:\s*$"
FROM_LINE = r"(?i)^\s*From:\s*(\S.*)$"
DATE_LINE = r"(?i)^\s*(?:Sent|Date):\s*(\S.*)$"
SUBJECT_LINE = r"(?i)^\s*Subject:\s*(.*)$"
HEADER_LOOKAHEAD = 6
BANNER_LOOKAHEAD = 3
CLUSTER_GAP = 4
MIN_LATEST_CHARS = 15
SUSPICIOUS_SPLIT = "suspicious_split_empty_latest"
NO_HEADER_BLOCK = "no_header_block"
DATE_NOT_PARSED = "received_at_not_parsed"
LINE_RULES = [
    ("caution_banner", r"(?i)^\s*CAUTION:\s*External\b"),
    ("sensitivity_marker", r"(?i)^\s*Sensitivity:\s*\w+\s*$"),
]
TAIL_RULES = [
    ("confidentiality_notice", r"(?i)CONFIDENTIALITY\s*&?\s*DISCLAIMER"),
    ("generic_disclaimer", r"(?i)This (?:message|e-?mail) and any associated files"),
    ("msc_legal_disclaimer", r"(?i)MSC LEGAL DISCLAIMER"),
    ("personal_data_notice", r"(?i)processing of your personal data"),
    ("holiday_update", r"(?i)^\s*HOLIDAY UPDATE\b"),
    ("marcura_footer", r"(?i)©\s*20\d\d\s*Marcura"),
]
SIGN_OFF = (
    r"(?i)^\s*(?:kind regards|best regards|warm regards|regards|thanks|thank you|"
    r"with kind regards|yours (?:sincerely|faithfully))[,!.]?\s*$"
)
VALUE_BEARING = r"(?i)\b(?:qty|quantity|price|amount|uom|imo|eta|etd|vessel|aed|usd|eur|rfq)\b"
SIGNATURE_LINES = 4
SIGNALS = {
    "imo": r"(?i)\bIMO[:\s#]*(\d{7})\b",
    "vessel_name": r"(?imd)^\s*Vessel(?:\s*Name)?\s*:\s*(.+?)\s*$|\b(?:VSL|M/T|M/V|MT|MV)[:\s]+([A-Z][A-Za-z0-9\-' ]{2,40})",
    "rfq_reference": r"(?i)\bRFQ\s*(?:No|Ref|Reference)\s*[.:]?\s*([A-Z0-9][A-Z0-9\-/._]{3,40})",
    "quotation_reference": r"(?i)\bQUOTATION\s*[:#]\s*([A-Z0-9][A-Z0-9\-/.]{3,40})|\bQOT\s*Ref(?:erence)?\s*:?\s*(\d[\d.]{4,})",
    "ems_reference": r"(?i)\bEMS\s*Reference\s*:\s*(\d[\d.]{4,})",
    "delivery_port": r"(?i)\b(?:Delivery\s*Port|Port\s*Name|Port\s*of\s*Call)\s*:\s*([A-Za-z \-]{3,40})",
    "eta": r"(?i)\be\.?t\.?a\.?\b[:\s]{0,3}(\d{1,2}[-/\s][A-Za-z0-9]{2,9}[-/\s]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4})",
    "quote_due_date": r"(?i)quotation\s+due\s+date\s+is\s+(\d{1,2}/[A-Za-z]{3,9}/\d{4})|\bQuote\s*Before\s*:\s*(\d{1,2}[-/][A-Za-z]{3}[-/]\d{4})",
    "department_or_category": r'(?i)Department\s*"([^"]{2,60})"|Requisition\s*Category\s*:\s*([A-Za-z ]{3,40})',
}
URGENCY = r"(?i)\b(U\s*R\s*G\s*E\s*N\s*T|urgent|high priority|asap)\b"
VESSEL_TAIL = r"\s+[-–]\s+|\s*,\s*"
# Possessive, so that a long run of marks, addresses or tags is gone through in a loop and not by recursion.
SUBJECT_RUN = r"(?i)^((?:\s*+(?:(?:re|fwd|fw)\s*+:|\[updated\]))++)"
ADDRESS_ENTRY = r'(?:[^",]++|"[^"]*+"|")++'
TAGS = r"(?:<[^>]*+>)++"
SUBJECT_PREFIX = r"(?i)((?:re|fwd|fw)\s*:|\[updated\])"
SIGNATURE_IMAGE = r"(?i)^image\d{3}\."
SIGNATURE_IMAGE_BYTES = 20_000
FORM_XLSX = r"(?i)^E_QUOT.*\.(?:xlsx|xls)$"
FORM_PDF = r"(?i)^E_QUOT.*\.pdf$"
DROPPED_TAGS = ["script", "style", "head", "noscript"]
ENTITY = r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]*);"
AMPERSAND = r"&(?:amp|#0*38|#[xX]0*26);"


@F.pandas_udf(StringType())
def compatible_form(texts: pd.Series) -> pd.Series:
    """Unicode NFKC: the one thing here no built-in function does."""
    return texts.map(lambda text: None if text is None else unicodedata.normalize("NFKC", text))


def normalize_text(text: Column, unicode_form: Callable[[Column], Column] = compatible_form) -> Column:
    """NFKC, plain line ends, no blanks at line ends, no more than one empty line in a row, trimmed."""
    lines = F.regexp_replace(unicode_form(text), "\r\n?", "\n")
    trimmed = F.regexp_replace(lines, r"(?U)[^\S\n]+(?=\n|$)", "")
    return strip(F.regexp_replace(trimmed, "\n{3,}", "\n\n"))


def first_place(lines: Column, test: Callable[[Column], Column]) -> Column:
    """The zero based place of the first line that passes, null when none does."""
    places = F.filter(F.transform(lines, lambda line, i: F.when(test(line), i)), lambda i: i.isNotNull())
    return F.try_element_at(places, F.lit(1))


def header_key(line: Column) -> Column:
    """The known header key a line opens with, null otherwise."""
    key = F.lower(strip(F.regexp_extract(line, HEADER_LINE, 1)))
    return F.when(key.isin(HEADER_KEYS), key)


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def split_headers(text: Column) -> Column:
    """struct(headers, body): the header block on top of a dump, the last of a repeated key standing.

    Empty lines and a warning banner above it are passed over. Without a sender it is no header block, and the text
    stays as it is.
    """

    def found(lines: Column) -> Column:
        top = first_place(lines, lambda line: (strip(line) != "") & ~line.rlike(CAUTION))
        rest = F.slice(lines, top + 1, F.size(lines))
        return let(F.coalesce(rest, F.array().cast("array<string>")), from_top)

    def from_top(rest: Column) -> Column:
        length = F.coalesce(first_place(rest, lambda line: header_key(line).isNull()), F.size(rest))
        return let(length, lambda n: read(rest, n))

    def read(rest: Column, length: Column) -> Column:
        block = F.slice(rest, 1, length)
        known = F.array(*[F.lit(key) for key in HEADER_KEYS])
        pairs = F.transform(
            known,
            lambda key: F.struct(
                key.alias("key"),
                F.try_element_at(
                    F.transform(
                        F.filter(block, lambda line: header_key(line) == key),
                        lambda line: strip(F.regexp_extract(line, HEADER_LINE, 2)),
                    ),
                    F.lit(-1),
                ).alias("value"),
            ),
        )
        headers = F.map_from_entries(F.filter(pairs, lambda pair: pair["value"].isNotNull()))
        body = strip(joined(F.slice(rest, length + 1, F.greatest(F.size(rest), F.lit(1)))))
        return let(
            headers,
            lambda h: F.when(
                F.map_contains_key(h, "from"), F.struct(h.alias("headers"), body.alias("body"))
            ).otherwise(F.struct(F.create_map().cast("map<string,string>").alias("headers"), text.alias("body"))),
        )

    return let(F.split(text, "\n"), found)


def parse_addresses(value: Column) -> Column:
    """array<struct(name, address)> of a header naming people, as `Name <a@b>` or `Name (a@b)`.

    Quoted names may hold commas. Entries without an address are left out.
    """
    prepared = F.regexp_replace(F.coalesce(value, F.lit("")), BRACKETED_ADDRESS, "<$1>")
    entries = F.regexp_extract_all(prepared, F.lit(ADDRESS_ENTRY), F.lit(0))

    def person(entry: Column) -> Column:
        inside = F.regexp_extract(entry, r"<\s*([^<>\s]+)\s*>", 1)
        bare = strip(entry)
        address = F.when(inside != "", inside).otherwise(F.when(bare.rlike(r"^[^<>\s]+@[^<>\s]+$"), bare))
        name = strip(F.regexp_replace(F.regexp_replace(entry, r"<[^<>]*>", ""), '"', ""))
        return F.struct(
            F.when((inside != "") & (name != ""), name).alias("name"), F.lower(address).alias("address")
        )

    return F.filter(F.transform(entries, person), lambda one: one["address"].isNotNull())


def address_domain(address: Column) -> Column:
    return F.when(address.contains("@"), F.lower(F.substring_index(address, "@", -1)))


def classify_attachment(name: Column, size: Column) -> Column:
    """What an attachment is by its name; a small numbered image is somebody's logo."""
    return (
        F.when(name.rlike(SIGNATURE_IMAGE) & (size < SIGNATURE_IMAGE_BYTES), "SIGNATURE_IMAGE")
        .when(name.rlike(FORM_XLSX), "RFQ_FORM_XLSX")
        .when(name.rlike(FORM_PDF), "RFQ_FORM_PDF")
        .otherwise("OTHER")
    )


def parse_attachments(value: Column) -> Column:
    """array<struct(filename, kind)> of an attachments header. Sizes are not known here."""
    names = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda part: strip(part)), lambda name: name != "")
    unknown = F.lit(None).cast("bigint")
    return F.transform(
        names, lambda name: F.struct(name.alias("filename"), classify_attachment(name, unknown).alias("kind"))
    )


def decode_entities(text: Column) -> Column:
    """Named and numbered character references as characters; references to `&` last."""
    names = F.create_map(*[F.lit(one) for pair in ((f"&{n};", chr(c)) for n, c in name2codepoint.items()) for one in pair])

    # Numbers 128 to 159 mean the signs of Windows-1252, as browsers read them; what is no character is U+FFFD.
    windows = F.array(*[F.lit(ord(bytes([i]).decode("cp1252", "replace")) if i not in (129, 141, 143, 144, 157) else i) for i in range(128, 160)])

    def sign_of(entity: Column) -> Column:
        number = F.regexp_replace(entity, "[&#;]", "")
        code = F.when(F.lower(number).startswith("x"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("int")
        told = F.when((code >= 128) & (code < 160), F.get(windows, code - 128)).when(
            (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(0xFFFD)
        ).otherwise(code)
        numbered = F.decode(F.unhex(F.lpad(F.hex(told), 8, "0")), "UTF-32")
        return F.when(entity.startswith("&#"), numbered).otherwise(F.try_element_at(names, entity))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    others = F.filter(found, lambda entity: ~entity.rlike(AMPERSAND))
    decoded = F.aggregate(
        others, text, lambda so_far, entity: F.replace(so_far, entity, F.coalesce(sign_of(entity), entity))
    )
    return F.regexp_replace(decoded, AMPERSAND, "&")


def html_to_text(html: Column) -> Column:
    """The text of a page, a line per piece, without scripts, styles, head and comments."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROPPED_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return decode_entities(F.regexp_replace(text, TAGS, "\n"))


def body_to_text(plain: Column, html: Column, unicode_form: Callable[[Column], Column] = compatible_form) -> Column:
    """The plain part of a mail when it says anything, else its page as text."""
    return F.when(
        strip(F.coalesce(plain, F.lit(""))) != "", normalize_text(plain, unicode_form)
    ).otherwise(F.coalesce(normalize_text(html_to_text(html), unicode_form), F.lit("")))


def line_kind(line: Column) -> Column:
    """What part a line plays in a quoted header: I message id, D divider, C banner, F from, T date, S subject."""
    return (
        F.when(line.rlike(DIVIDER) | line.rlike(ON_WROTE), "D")
        .when(line.rlike(MESSAGE_ID), "I")
        .when(line.rlike(CAUTION), "C")
        .when(line.rlike(FROM_LINE), "F")
        .when(line.rlike(DATE_LINE), "T")
        .when(line.rlike(SUBJECT_LINE), "S")
        .otherwise("-")
    )


def split_thread(body: Column, min_latest_chars: int = MIN_LATEST_CHARS) -> Column:
    """struct(latest, quoted, warnings): the newest message and those quoted below it.

    A boundary close under the last accepted one belongs to it; which ones are accepted depends on the ones before, so
    the boundaries of one message are folded in order.
    """

    def starts_of(kinds: Column) -> Column:
        def is_start(kind: Column, i: Column) -> Column:
            near = F.slice(kinds, i + 2, BANNER_LOOKAHEAD)
            ahead = F.slice(kinds, i + 2, HEADER_LOOKAHEAD)
            return (
                kind.isin("D", "I")
                | ((kind == "C") & (F.array_contains(near, "I") | F.array_contains(near, "F")))
                | ((kind == "F") & F.array_contains(ahead, "T") & F.array_contains(ahead, "S"))
            )

        hits = F.filter(F.transform(kinds, lambda k, i: F.when(is_start(k, i), i)), lambda i: i.isNotNull())

        def accept(taken: Column, i: Column) -> Column:
            far = (F.size(taken) == 0) | (i - F.try_element_at(taken, F.lit(-1)) > CLUSTER_GAP)
            return F.when(far, F.concat(taken, F.array(i))).otherwise(taken)

        return F.aggregate(hits, F.array().cast("array<int>"), accept)

    def first_match(block: Column, pattern: str) -> Column:
        hit = F.try_element_at(F.filter(F.slice(block, 1, HEADER_LOOKAHEAD), lambda x: x.rlike(pattern)), F.lit(1))
        value = strip(F.regexp_extract(hit, pattern, 1))
        return F.when(value != "", value)

    def quoted(lines: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(lines)))

        def block(start: Column, i: Column) -> Column:
            return let(
                F.slice(lines, start + 1, F.element_at(ends, i + 1) - start),
                lambda part: F.struct(
                    strip(joined(part)).alias("raw"),
                    first_match(part, FROM_LINE).alias("from_address"),
                    first_match(part, DATE_LINE).alias("sent_at"),
                    first_match(part, SUBJECT_LINE).alias("subject"),
                ),
            )

        return F.transform(starts, block)

    def cut(lines: Column) -> Column:
        return let(
            F.transform(lines, lambda line: line_kind(line)),
            lambda kinds: let(starts_of(kinds), lambda starts: whole(lines, starts)),
        )

    def whole(lines: Column, starts: Column) -> Column:
        top = F.coalesce(F.try_element_at(starts, F.lit(1)), F.size(lines))
        return let(
            strip(joined(F.slice(lines, 1, top))),
            lambda latest: F.struct(
                latest.alias("latest"),
                quoted(lines, starts).alias("quoted"),
                F.when(
                    (F.size(starts) > 0) & (F.length(latest) < min_latest_chars), F.array(F.lit(SUSPICIOUS_SPLIT))
                ).otherwise(F.array().cast("array<string>")).alias("warnings"),
            ),
        )

    return let(F.split(body, "\n"), cut)


def strip_boilerplate(
    text: Column,
    line_rules: Sequence[tuple[str, str]] = LINE_RULES,
    tail_rules: Sequence[tuple[str, str]] = TAIL_RULES,
    sign_off: str = SIGN_OFF,
    value_bearing: str = VALUE_BEARING,
) -> Column:
    """struct(text, applied): banner lines, legal tails and signatures cut, with the rules that fired in order.

    Only the first sign-off counts; its next four filled lines stay, and nothing is cut that holds a value.
    """

    def drop_lines(lines: Column, pattern: str) -> Column:
        return F.filter(lines, lambda line: ~line.rlike(pattern))

    def drop_tail(lines: Column, pattern: str) -> Column:
        at = first_place(lines, lambda line: line.rlike(pattern))
        return F.when(at.isNotNull(), F.slice(lines, 1, at)).otherwise(lines)

    def step(name: str, cut: Callable[[Column], Column]) -> Callable[[Column], Column]:
        """One rule as a function of (lines, applied)."""

        def told(state: Column, left: Column) -> Column:
            fired = F.size(left) != F.size(state["lines"])
            applied = F.when(fired, F.concat(state["applied"], F.array(F.lit(name)))).otherwise(state["applied"])
            return F.struct(left.alias("lines"), applied.alias("applied"))

        return lambda state: let(cut(state["lines"]), lambda left: told(state, left))

    def drop_signature(lines: Column) -> Column:
        at = first_place(lines, lambda line: line.rlike(sign_off))
        return F.when(at.isNotNull(), let(at, lambda place: after(lines, place))).otherwise(lines)

    def after(lines: Column, place: Column) -> Column:
        filled = F.filter(
            F.transform(lines, lambda line, i: F.when((i > place) & (strip(line) != ""), i)), lambda i: i.isNotNull()
        )
        keep = F.coalesce(F.try_element_at(filled, F.lit(SIGNATURE_LINES)) + 1, F.size(lines))
        return let(keep, lambda n: signature_cut(lines, n))

    def signature_cut(lines: Column, keep: Column) -> Column:
        removed = joined(F.slice(lines, keep + 1, F.size(lines)))
        return F.when((strip(removed) != "") & ~removed.rlike(value_bearing), F.slice(lines, 1, keep)).otherwise(lines)

    state = F.struct(F.split(text, "\n").alias("lines"), F.array().cast("array<string>").alias("applied"))
    steps = [step(name, partial(drop_lines, pattern=pattern)) for name, pattern in line_rules]
    steps += [step(name, partial(drop_tail, pattern=pattern)) for name, pattern in tail_rules]
    for one in [*steps, step("signature", drop_signature)]:
        state = let(state, one)
    return let(state, lambda s: F.struct(strip(joined(s["lines"])).alias("text"), s["applied"].alias("applied")))


def first_group(text: Column, pattern: str, groups: int) -> Column:
    """The first filled group over all matches of a pattern, trimmed."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group + 1)) for group in range(groups)]
    if groups == 1:
        said = F.transform(found[0], strip)
    else:
        said = F.zip_with(found[0], found[1], lambda one, other: F.when(strip(one) != "", strip(one)).otherwise(strip(other)))
    return F.try_element_at(F.filter(said, lambda value: value != ""), F.lit(1))


def extract_signals(text: Column, patterns: dict[str, str] = SIGNALS, urgency: str = URGENCY) -> Column:
    """struct of one nullable text per pattern and the urgency markers, distinct and sorted."""
    fields = []
    for name, pattern in patterns.items():
        value = first_group(text, pattern, re.compile(pattern.replace("(?imd)", "(?im)")).groups)
        if name == "vessel_name":
            value = strip(F.split(value, VESSEL_TAIL)[0])
        fields.append(value.alias(name))
    marks = F.transform(F.regexp_extract_all(text, F.lit(urgency), F.lit(1)), F.upper)
    return F.struct(*fields, F.array_sort(F.array_distinct(marks)).alias("urgency_markers"))


def subject_prefixes(subject: Column) -> Column:
    """RE:, FW:, FWD: and [UPDATED] off the front of a subject, upper case, in order."""
    run = F.regexp_extract(F.coalesce(subject, F.lit("")), SUBJECT_RUN, 1)
    return F.transform(F.regexp_extract_all(run, F.lit(SUBJECT_PREFIX), F.lit(1)), lambda one: F.upper(strip(one)))


def truncate_middle(text: Column, limit: int) -> Column:
    """Head and tail of a text too long, with a note of what was left out between them."""
    keep = (limit - 64) // 2
    note = F.format_string("\n\n[... %d characters omitted ...]\n\n", F.length(text) - 2 * keep)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.left(text, F.lit(keep)), note, F.right(text, F.lit(keep)))
    )
