"""Quality rules by weak supervision: each rule votes for good, for bad, or abstains; nobody tells which rule is right.

Expectation-maximisation estimates, from how the rules agree, how often each gives each vote to good and to bad texts,
and with that the probability that a text is good. Only counts of vote patterns are gathered, at most three to the
power of the number of rules, whatever the number of texts.
"""

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.llm.common import with_column_in_batches

COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_lines long, n_letters long, n_upper long, n_distinct long, n_marks long"
)
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
GOOD, BAD, ABSTAIN = 1, -1, 0
ROUNDS = 200


def repeated_words(numbers: np.ndarray) -> int:
    """How many words stand in a window of three that occurs twice or more. `numbers`: the words as integers."""
    if len(numbers) < 4:
        return 0
    distinct = np.int64(numbers.max() + 1)
    _, pairs = np.unique(numbers[:-1] * distinct + numbers[1:], return_inverse=True)
    _, which, often = np.unique(pairs[:-1] * distinct + numbers[2:], return_inverse=True, return_counts=True)
    twice = often[which] > 1
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def counts_of(text: str) -> dict[str, int]:
    words = text.encode().split()
    numbering: dict[bytes, int] = {}
    numbers = np.array([numbering.setdefault(word, len(numbering)) for word in words], np.int64)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    letters = "".join(re.findall(r"[^\W\d_]+", text))
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(numbers),
        "n_lines": len(lines),
        "n_letters": len(letters),
        "n_upper": sum(map(str.isupper, letters)) if not letters.islower() else 0,
        "n_distinct": len(numbering),
        "n_marks": text.count("!") + text.count("?"),
    }


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Every column of `df` and `counts` of its text (a struct; replaces a column of that name).

    A null text counts as empty; no shuffle.
    """

    def task():
        return lambda texts: [counts_of(one or "") for one in texts]

    return with_column_in_batches(df, text, "counts", T._parse_datatype_string(f"struct<{COUNTS.replace(' long', ':long')}>"), task)


def _rule(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def rules() -> dict[str, Column]:
    """The votes of each rule, from the counts."""
    def share(part, whole):
        return F.col(f"counts.{part}") / F.greatest(F.col(f"counts.{whole}"), F.lit(1))

    length, symbols, repeats = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_repeat_words", "n_words")
    lines, letters, upper = share("n_dup_lines", "n_lines"), share("n_letters", "word_chars"), share("n_upper", "n_letters")
    distinct, marks = share("n_distinct", "n_words"), share("n_marks", "n_words")
    return {
        "word_length": _rule((length >= 3) & (length <= 12), (length < 2) | (length > 20)),
        "symbols": _rule(symbols < 0.05, symbols > 0.3),
        "repeats": _rule(repeats < 0.1, repeats > 0.3),
        "dup_lines": _rule(lines < 0.1, lines > 0.3),
        "letters": _rule(letters > 0.85, letters < 0.6),
        "upper": _rule(upper < 0.2, upper > 0.5),
        "distinct": _rule(distinct > 0.3, distinct < 0.1),
        "marks": _rule(marks < 0.1, marks > 0.5),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """For each pattern of votes, the probability that a text with it is good. `patterns`: votes and how many texts.

    Two kinds of texts, rules independent given the kind. The start takes texts that no rule calls bad for good ones,
    which fixes which kind is which; a rule whose bad votes the others do not bear out loses its weight from there.
    Counts are smoothed, so that no rule becomes certain.
    """
    if not patterns:
        return {}
    patterns = sorted(patterns)
    votes = np.array([pattern for pattern, _ in patterns])
    weight = np.array([count for _, count in patterns], float)
    shown = np.stack([votes == vote for vote in (BAD, ABSTAIN, GOOD)], axis=2).astype(float)
    good = np.where((votes == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(ROUNDS):
        kinds = np.stack([good, 1 - good]) * weight
        # A rule is believed to be right rather than wrong: the smoothing counts lean that way.
        lean = 0.1 * np.array([[[0.5, 1.0, 2.0]], [[2.0, 1.0, 0.5]]])
        given = np.einsum("kp,prv->krv", kinds, shown) + lean
        given /= given.sum(axis=2, keepdims=True)
        prior = (kinds.sum(axis=1) + 1) / (weight.sum() + 2)
        joint = np.log(prior)[:, None] + np.einsum("prv,krv->kp", shown, np.log(given))
        before, good = good, 1 / (1 + np.exp(np.clip(joint[1] - joint[0], -500, 500)))
        if np.abs(good - before).max() < 1e-9:
            break
    return {pattern: float(one) for (pattern, _), one in zip(patterns, good)}


def base_failed() -> Column:
    return (F.col("counts.n_words") < 50) | (100 * F.col("counts.n_repeat_words") > 50 * F.col("counts.n_words"))


def judge(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `text_counts` with `votes`, `base_failed`, `probability` and `kept` (passed, and at least `threshold`).

    The fit is over all texts that do not fail the fixed rule: those need no verdict, and would make up the bad kind.
    An empty table stays empty; equal counts get equal verdicts; the table of patterns is broadcast, and its size is
    bounded by the rules. Columns named like the new ones are replaced.
    """
    named = rules()
    voted = counted.withColumn("votes", F.array(*[vote.cast("int") for vote in named.values()])).withColumn(
        "base_failed", base_failed()
    )
    passed = F.sum(F.when(F.col("base_failed"), 0).otherwise(1))
    found = voted.groupBy("votes").agg(passed.alias("passed")).collect()
    good = fit([(tuple(row["votes"]), row["passed"]) for row in found])
    assert len(good) <= 3 ** len(named)
    table = counted.sparkSession.createDataFrame(
        [(list(pattern), probability) for pattern, probability in good.items()], "votes array<int>, probability double"
    )
    return voted.drop("probability").join(F.broadcast(table), "votes").withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= threshold)
    )
