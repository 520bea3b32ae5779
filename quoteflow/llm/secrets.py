"""Secrets in texts: fixed shapes, and strings that look drawn at random.

Two Markov models over the signs of a string, one of random strings and one of ordinary identifiers, are compared by
their log-likelihood ratio. Both are counted from labelled samples: strings in places of a fixed shape are secrets,
words of a sample of documents are not. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import plain_text
from quoteflow.sources.store import stored

# The shapes. `assign` keeps those with six signs or more in its second group; the others hold the least
# length themselves, which gives the same, since a match is a whole run of its signs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
LEAST_VALUE = 6
# What may be random: whole runs of these signs, this long or longer, with a letter (numbers alone are no secrets).
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
# Documents whose words are the ordinary sample, and labelled secrets: both are bounded.
SAMPLE_DOCS = 2_000
SAMPLE_SECRETS = 20_000
# A string is a secret when random is so many times likelier, in natural logarithms, over the whole string.
THRESHOLD = 8.0

SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost matches; `value` is the given group, which must have `least` signs or more.

    Matches and the pieces between them alternate, so a match starts after what came before it.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), values.alias("value"))
    empty = F.array().cast(SPAN)

    def step(seen, one):
        start = seen["at"] + F.char_length(one["gap"])
        stop = start + F.coalesce(F.char_length(one["match"]), F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), one["value"].alias("value")
        )
        wanted = F.char_length(one["value"]) >= least
        return F.struct(stop.alias("at"), F.when(wanted, F.concat(seen["spans"], F.array(span))).otherwise(seen["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.when(F.size(matches) > 0, F.aggregate(both, start, step)["spans"]).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All spans of fixed shape, by start and then kind."""
    return F.array_sort(F.concat(
        _found(text, ASSIGN, "assign", 2, LEAST_VALUE), _found(text, ACCESS, "access"), _found(text, HEX, "hex")
    ))


def _pairs(value: Column) -> Column:
    """Each pair of neighbouring signs as a number, the first sign after a sign that stands for the start."""
    width = len(SIGNS) + 1

    def place(at):
        return F.instr(F.lit(SIGNS), F.substring(value, at, F.lit(1)))

    return F.transform(
        F.sequence(F.lit(1), F.char_length(value)),
        lambda at: F.when(at == 1, F.lit(0)).otherwise(place(at - 1)) * F.lit(width) + place(at),
    )


def fit(secrets: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log ratio of the two models for every pair of signs. Both tables have one column `value`.

    One count per pair of signs comes to the driver: at most the square of the alphabet, whatever the sample.
    """
    width = len(SIGNS) + 1
    labelled = secrets.select("value", F.lit(0).alias("kind")).unionByName(ordinary.select("value", F.lit(1).alias("kind")))
    rows = (
        labelled.where(F.char_length("value") > 0)
        .select("kind", F.explode(_pairs(F.col("value"))).alias("pair"))
        .groupBy("kind", "pair").count().collect()
    )
    assert len(rows) <= 2 * width * width
    import math

    tables = []
    for kind in (0, 1):
        counts = [[0.5] * width for _ in range(width)]
        for row in rows:
            if row["kind"] == kind:
                counts[row["pair"] // width][row["pair"] % width] += row["count"]
        if kind == 0:
            # Random strings follow no order: what one row lacks is filled from the signs overall.
            overall = [sum(column) for column in zip(*counts)]
            counts = [[one + 20 * of / sum(overall) for one, of in zip(row, overall)] for row in counts]
        tables.append([[math.log(one / sum(row)) for one in row] for row in counts])
    return [a - b for left, right in zip(*tables) for a, b in zip(left, right)]


def likelihood_ratio(value: Column, ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{one:.6f}" for one in ratios)), ",").cast("array<double>")
    return F.aggregate(_pairs(value), F.lit(0.0), lambda seen, pair: seen + F.get(table, pair))


def samples(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Labelled strings: values in places of fixed shape, and other words of six signs or more of sampled documents.

    Each secret counts once, however many rows repeat it. Bounded: `SAMPLE_SECRETS` strings and the documents with the `SAMPLE_DOCS` lowest hashes of `key` and text length.
    """
    texts = df.select(F.col(key).alias("key"), plain_text(text).alias("text"))
    order = [F.xxhash64("key", F.char_length("text")), F.col("key")]
    flagged = texts.where(F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX))
    secrets = (
        flagged.select(F.explode(base_spans(F.col("text"))).alias("span")).select("span.value")
        .where(~F.col("value").rlike(r"[^A-Za-z0-9+/_=-]") & (F.char_length("value") >= 16)).distinct()
        .select("value", F.xxhash64("value").alias("h")).orderBy("h", "value").limit(SAMPLE_SECRETS).select("value")
    )
    chosen = texts.select("key", F.char_length("text").alias("n")).orderBy(F.xxhash64("key", "n"), "key").limit(SAMPLE_DOCS)
    some = texts.join(F.broadcast(chosen.select("key").distinct()), "key")
    ordinary = some.select(F.explode(F.split("text", r"[^A-Za-z0-9+/_=-]+")).alias("value")).where(
        (F.char_length("value") >= 6) & ~F.col("value").rlike(HEX) & ~F.col("value").rlike(ACCESS)
    ).where(~F.col("value").rlike(r"[0-9]"))
    return secrets, ordinary


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`key` and `spans`: start, stop (code points, end exclusive), kind and value, by start and then kind.

    Spans of fixed shape stay as they are; strings by the models are added where they meet none of those. A null or
    empty text has none. Rows are worked on one by one, so repeated rows get equal spans; an empty table gives none,
    and where no secret is labelled the models differ by their smoothing alone and the threshold is not reached by
    ordinary words. Columns other than `key` are left out.
    """
    secrets, ordinary = samples(df, key, text)
    ratios = fit(stored(secrets, "secrets"), stored(ordinary.groupBy("value").count().select("value"), "ordinary"))
    texts = df.select(F.col(key).alias("key"), plain_text(text).alias("text")).withColumn("base", base_spans(F.col("text")))
    added = F.filter(
        _found(F.col("text"), CANDIDATE, "random"),
        lambda one: ~F.exists("base", lambda other: (one["start"] < other["stop"]) & (other["start"] < one["stop"]))
        & one["value"].rlike("[A-Za-z]") & (likelihood_ratio(one["value"], ratios) >= threshold),
    )
    spans = F.array_sort(F.concat(F.col("base"), added))
    kinds = F.array(*map(F.lit, KINDS))
    return texts.select(
        F.col("key").alias(key),
        F.transform(
            spans,
            lambda one: F.struct(
                F.get(kinds, one["kind"]).alias("kind"), one["start"].alias("start"), one["stop"].alias("stop"), one["value"].alias("value")
            ),
        ).alias("spans"),
    )


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda one: F.concat_ws(":", one["kind"], one["start"].cast("string"), one["stop"].cast("string"))), ",")
