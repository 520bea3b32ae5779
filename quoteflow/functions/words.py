"""Words and codes as they are compared: lower case, split on anything but letters and digits, stemmed."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoteflow.functions.values import strip

# Fixed values.
NOT_WORD = r"[^\p{L}\p{N}]+"
NUMBER_AND_UNIT = r"^(\d+(?:[.,]\d+)?)([a-z]{1,4})$"
JOINING_DASH = "(?<=[\\p{L}\\p{N}_])[-‐‑‒–—](?=[\\p{L}\\p{N}_])"
WORD_OR_SIGN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"
COSMETIC_SIGNS = list(",.;:()[]{}|/\\_'\"`“”‘’«»")


def drop_right(text: Column, count: int) -> Column:
    """`text` without its last `count` characters."""
    return text.substr(F.lit(1), F.length(text) - F.lit(count))


def stem(word: Column) -> Column:
    """Plural, participle and past tense endings taken off where enough of the word stays."""
    size = F.length(word)
    return (
        F.when(word.endswith("ies") & (size >= 5), F.concat(drop_right(word, 3), F.lit("y")))
        .when(word.endswith("ing") & (size >= 7), drop_right(word, 3))
        .when(word.endswith("ed") & (size >= 6), drop_right(word, 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (size >= 4), drop_right(word, 1))
        .otherwise(word)
    )


def tokens(text: Column) -> Column:
    """Stemmed words of a text in order; an empty array for null or wordless text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")
    return F.transform(words, stem)


def normalize_code(code: Column) -> Column:
    """A code as a key: letters and digits only, upper case."""
    return F.upper(F.regexp_replace(code, NOT_WORD, ""))


def word_set(text: Column) -> Column:
    """Distinct words, where `65mm` also counts as the number 65."""
    words = tokens(text)
    numbers = F.filter(
        F.transform(words, lambda w: F.regexp_extract(w, NUMBER_AND_UNIT, 1)), lambda w: w != ""
    )
    return F.array_distinct(F.concat(words, numbers))


def word_coverage(asked: Column, offered: Column) -> Column:
    """Percent of the asked text's distinct words the offered text has, rounded half to even."""
    wanted = word_set(asked)
    shared = F.size(F.array_intersect(wanted, word_set(offered)))
    share = F.bround(F.lit(100.0) * shared / F.size(wanted), 0).cast("int")
    return F.when(F.size(wanted) > 0, share).otherwise(F.lit(0))


def exact_words(text: Column) -> Column:
    """Ordered words and meaningful signs, for the word for word comparison.

    `ß` is folded to `ss`; the few other letters whose case folding differs from lower case are compared lower case.
    """
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    joined = F.regexp_replace(folded, JOINING_DASH, " ")
    found = F.regexp_extract_all(joined, F.lit(WORD_OR_SIGN), F.lit(1))
    return F.filter(found, lambda token: ~token.isin(COSMETIC_SIGNS))


def same_words(line: Column, description: Column) -> Column:
    words = exact_words(line)
    return F.coalesce((F.size(words) > 0) & (words == exact_words(description)), F.lit(False))


def collapsed(text: Column) -> Column:
    """Lower case with runs of white space as one blank: how two lines are told to be the same."""
    return strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def unspaced(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def shortened(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last of them an ellipsis when something was cut."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))
    )
