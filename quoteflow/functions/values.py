"""Values of a request as they are written into a form: numbers, currencies, kinds, dates, names."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CURRENCY_CODES = ["AED", "EGP", "EUR", "JPY", "KRW", "OMR", "SGD", "USD"]
CURRENCY_SYMBOLS = [("$", "USD"), ("€", "EUR"), ("US$", "USD"), ("USD$", "USD"), ("AED", "AED"), ("DHS", "AED")]
RFQ_TYPES = [
    "BOND", "CABIN", "DECK", "ENGINE", "PROVISION", "ELECTRICAL",
    "MEDICAL", "SAFETY", "STATIONARY", "PRIVATE", "OTHERS", "TENDER",
]
FALLBACK_TYPE = "OTHERS"
MONTHS = [
    ("jan", 1), ("january", 1), ("feb", 2), ("february", 2), ("mar", 3), ("march", 3), ("apr", 4), ("april", 4),
    ("may", 5), ("jun", 6), ("june", 6), ("jul", 7), ("july", 7), ("aug", 8), ("august", 8), ("sep", 9), ("sept", 9),
    ("september", 9), ("oct", 10), ("october", 10), ("nov", 11), ("november", 11), ("dec", 12), ("december", 12),
]
BACKDATING_DAYS = 60
DATE_AMBIGUOUS = "date_could_be_read_two_ways"
DATE_UNREADABLE = "date_not_understood"
DATE_IMPOSSIBLE = "date_is_not_a_real_day"
ISO_DATE = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
NUMERIC_DATE = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$"
DAY_AND_MONTH = r"^(\d{1,2})[./-](\d{1,2})$"
DAY_MONTH = r"^(\d{1,2})[\s./-]*([A-Za-z]{3,9})\.?[\s,./-]*(\d{2,4})?$"
MONTH_DAY = r"^([A-Za-z]{3,9})\.?[\s,./-]*(\d{1,2})[\s,./-]*(\d{2,4})?$"
PLAIN_NUMBER = r"^\d+(?:\.\d+)?$"
UNUSABLE_IN_NAMES = r'[<>:"/\\|?*\x00-\x1f]+'
NAME_CHARS = 60
# White space of Unicode, line ends and no-break blanks included.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """Without white space, line ends included, on either side."""
    return F.trim(text, F.lit(WHITE_SPACE))


def check_imo(value: Column) -> Column:
    """The seven digits of an IMO number whose check digit adds up, else null."""
    digits = F.regexp_replace(value, r"\D", "")
    total = sum(
        (F.substring(digits, place, 1).try_cast("int") * weight for place, weight in zip(range(1, 7), range(7, 1, -1))),
        F.lit(0),
    )
    fits = (F.length(digits) == 7) & (total % 10 == F.substring(digits, 7, 1).try_cast("int"))
    return F.when(fits, digits)


def standardise_currency(value: Column) -> Column:
    """A code, a symbol, a leading code or a leading symbol as a code; otherwise what was written, upper case."""
    written = F.upper(strip(value))
    exact = F.when(written.isin(CURRENCY_CODES), written)
    symbol = F.coalesce(*[F.when(written == sign, code) for sign, code in CURRENCY_SYMBOLS])
    leading = F.coalesce(
        *[F.when(written.rlike(rf"^{code}(?![\p{{L}}\p{{N}}_])"), code) for code in CURRENCY_CODES]
    )
    prefix = F.coalesce(*[F.when(written.startswith(sign), code) for sign, code in CURRENCY_SYMBOLS])
    return F.coalesce(exact, symbol, leading, prefix, written)


def standardise_type(value: Column) -> Column:
    """The kind of request as one of the listed ones; others fall back."""
    written = F.upper(strip(value))
    exact = F.when(written.isin(RFQ_TYPES), written)
    held = F.coalesce(*[F.when(written.contains(kind), kind) for kind in RFQ_TYPES])
    return F.when(written != "", F.coalesce(exact, held, F.lit(FALLBACK_TYPE)))


def type_fell_back(value: Column) -> Column:
    """Whether no listed kind is in the text."""
    written = F.upper(strip(value))
    held = F.coalesce(*[F.when(written.contains(kind), True) for kind in RFQ_TYPES])
    return (written != "") & held.isNull()


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _full_year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _day_month_year(text: Column) -> Column:
    """struct(d, m, y, form): what a date text says; d is null where its two numbers could be either."""
    none = F.lit(None).cast("int")
    months = F.create_map(*[F.lit(one) for pair in MONTHS for one in pair])

    def said(form: str, day: Column, month: Column, year: Column) -> Column:
        return F.struct(day.alias("d"), month.alias("m"), year.alias("y"), F.lit(form).alias("form"))

    def two_numbers(form: str, pattern: str, year: Column, equal_counts: bool) -> Column:
        first, second = _part(text, pattern, 1), _part(text, pattern, 2)
        day_first = (first > 12) & (second <= 12)
        month_first = (second > 12) & (first <= 12)
        equal = (first == second) & F.lit(equal_counts)
        day = F.when(day_first | equal, first).when(month_first, second)
        return said(form, day, F.when(day_first | equal, second).when(month_first, first), year)

    day_month = F.try_element_at(months, F.lower(F.regexp_extract(text, DAY_MONTH, 2)))
    month_day = F.try_element_at(months, F.lower(F.regexp_extract(text, MONTH_DAY, 1)))
    return (
        F.when(text.rlike(ISO_DATE), said("iso", _part(text, ISO_DATE, 3), _part(text, ISO_DATE, 2), _part(text, ISO_DATE, 1)))
        .when(text.rlike(NUMERIC_DATE), two_numbers("numbers", NUMERIC_DATE, _full_year(_part(text, NUMERIC_DATE, 3)), True))
        .when(text.rlike(DAY_AND_MONTH), two_numbers("numbers", DAY_AND_MONTH, none, False))
        .when(day_month.isNotNull(), said("words", _part(text, DAY_MONTH, 1), day_month, _full_year(_part(text, DAY_MONTH, 3))))
        .when(month_day.isNotNull(), said("words", _part(text, MONTH_DAY, 2), month_day, _full_year(_part(text, MONTH_DAY, 3))))
        .otherwise(said("none", none, none, none))
    )


def _dated(said: Column, today: Column) -> Column:
    """The day in the year given; without one this year, or next year when that is long past."""
    this_year = _day(F.year(today), said["m"], said["d"])
    later = _day(F.year(today) + 1, said["m"], said["d"])
    return F.when(said["y"].isNotNull(), _day(said["y"], said["m"], said["d"])).otherwise(
        let(this_year, lambda guess: F.when(F.datediff(today, guess) > BACKDATING_DAYS, later).otherwise(guess))
    )


def parse_due_date(value: Column, today: Column) -> Column:
    """struct(day, problem): a date only when it can be read one way."""

    def read(said: Column) -> Column:
        return let(
            _dated(said, today),
            lambda day: F.struct(
                day.alias("day"),
                F.when(said["form"] == "none", DATE_UNREADABLE)
                .when(said["d"].isNull(), DATE_AMBIGUOUS)
                .when(day.isNull(), DATE_IMPOSSIBLE)
                .otherwise("")
                .alias("problem"),
            ),
        )

    text = F.regexp_replace(strip(value), r"[ ./-]+$", "")
    return let(text, lambda t: let(_day_month_year(t), read))


def plain_number(value: Column) -> Column:
    """A plainly written number, null where writing it as a number would change how it reads (007, 1.0, 1,5)."""
    written = strip(value)
    number = F.when(written.rlike(PLAIN_NUMBER), written.try_cast("double"))
    whole = number == F.floor(number)
    return F.when(~whole | (F.format_string("%.0f", number) == written), number)


def quantity_number(value: Column) -> Column:
    """A quantity as a positive decimal: blanks out, a comma is a point; null for anything else."""
    cleaned = F.replace(F.replace(value, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    number = F.when(cleaned.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), cleaned.try_cast("decimal(24,6)"))
    return F.when(number > 0, number)


def usable_filename(value: Column) -> Column:
    """A text as part of a file name: signs no file system takes become blanks, 60 characters at most."""
    cleaned = F.regexp_replace(F.coalesce(value, F.lit("")), UNUSABLE_IN_NAMES, " ")
    return strip(F.left(strip(F.regexp_replace(cleaned, r"\s+", " ")), F.lit(NAME_CHARS)))


def reference_or_generated(reference: Column, received: Column, decision_id: Column) -> Column:
    """The customer's reference, or one made from the day received and the decision."""
    tail = F.upper(F.left(F.replace(decision_id, F.lit("-"), F.lit("")), F.lit(6)))
    made = F.concat(F.lit("POC-"), F.date_format(received, "yyyyMMdd"), F.lit("-"), tail)
    return F.when(F.coalesce(reference, F.lit("")) != "", reference).otherwise(made)
