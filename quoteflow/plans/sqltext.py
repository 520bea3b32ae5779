"""Expressions of the check SQL that several checks share."""

WORD = "[^\\p{L}\\p{N}]+"


def stem(w: str) -> str:
    return (
        f"CASE WHEN {w} LIKE '%ies' AND length({w}) >= 5 THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN {w} LIKE '%ing' AND length({w}) >= 7 THEN left({w}, length({w}) - 3) "
        f"WHEN {w} LIKE '%ed' AND length({w}) >= 6 THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) >= 4 THEN left({w}, length({w}) - 1) "
        f"ELSE {w} END"
    )


def tokens(text: str) -> str:
    return (
        f"list_transform(list_filter(string_split_regex(lower(coalesce({text}, '')), '{WORD}'), lambda w: w <> ''), "
        f"lambda w: {stem('w')})"
    )


def code_key(text: str) -> str:
    return f"upper(regexp_replace({text}, '{WORD}', '', 'g'))"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '\\s+', ' ', 'g'))"


def word_set(text: str) -> str:
    t = tokens(text)
    numbers = f"list_filter(list_transform({t}, lambda n: regexp_extract(n, '^(\\d+(?:[.,]\\d+)?)([a-z]{{1,4}})$', 1)), lambda n: n <> '')"
    return f"list_distinct(list_concat({t}, {numbers}))"
