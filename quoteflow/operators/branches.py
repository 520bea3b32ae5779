"""The three ways a requested line ends: by its code, past its code, or by search.

A model's judgements come in as a table; what is done here is what surrounds the asking: each distinct pair once, in
numbered batches, and silence is never consent.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions.values import strip
from quoteflow.functions.words import same_words, tokens, word_coverage
from quoteflow.operators.catalog import lookup_code
from quoteflow.operators.common import last_wins, number_all
from quoteflow.operators.search import SearchIndex, search
from quoteflow.sources.store import stored

# Fixed values.
JUDGE_BATCH = 50
CODE_CONFIRMED = "code_confirmed"
CODE_REJECTED = "code_rejected"
BY_SEARCH = "search"
NOTHING = "none"
UNANSWERED = "The quoted code could not be checked against this line, so it was not trusted."
NO_CATALOGUE = "There is no catalogue to match against."
NOTHING_FOUND = "The sheet had nothing to offer for this line."
CONFIRMED = "The customer's code names this product, and it is what the line asked for."
REJECTED = (
    "The customer's code names %s, which is not what this line asked for - "
    "the code was dropped and the sheet searched by the line's own words instead."
)
SEARCHED = "No row carries this customer code, so the sheet was searched by the requested description."
NO_CODE = "The customer quoted no code, so the sheet was searched by the requested description."
WORD_FOR_WORD = "The line's own description, word for word."
NOT_ASSESSED = "Not assessed: another candidate matches the line word for word."

Scorer = Callable[[DataFrame], DataFrame]


def distinct_pairs(coded: DataFrame) -> DataFrame:
    """Each (line text, product text) to be judged, once, numbered in first seen order into batches.

    `coded` carries `ord` (the order of the lines over the whole table) and the product its code named.
    """
    pairs = (
        coded.where("found_code is not null")
        .groupBy(
            F.coalesce("description", F.lit("")).alias("line_text"),
            F.col("found_description").alias("product_text"),
        )
        .agg(F.min("ord").alias("first_seen"))
    )
    numbered = number_all(pairs, ["first_seen"], "pair_no")
    at = F.col("pair_no") - 1
    return numbered.select(
        "line_text",
        "product_text",
        "pair_no",
        F.floor(at / JUDGE_BATCH).cast("long").alias("batch"),
        (at % JUDGE_BATCH).alias("index"),
    )


def join_judgements(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Every pair with its verdict; unanswered pairs and answers for no pair count as not agreed.

    `answers` carries `batch`, `index`, `same`, `why` and `ord`; the last answer for an index stands.
    """
    last = last_wins(answers.select("batch", "index", "same", "why", "ord"), ["batch", "index"], ["ord"])
    told = last.select("batch", "index", "same", strip("why").alias("why"), F.lit(True).alias("answered"))
    joined = pairs.join(told, ["batch", "index"], "left")
    return joined.select(
        "pair_no",
        "line_text",
        "product_text",
        F.coalesce("same", F.lit(False)).alias("same"),
        F.when(F.col("answered"), F.coalesce("why", F.lit(""))).otherwise(F.lit(UNANSWERED)).alias("why"),
    )


def and_said(reason: Column, said: Column) -> Column:
    """A fixed reason with what was said about it, if anything was."""
    return F.when(F.coalesce(said, F.lit("")) != "", F.concat_ws(" ", reason, said)).otherwise(reason)


def settle_lines(coded: DataFrame, judged: DataFrame) -> DataFrame:
    """Each line with its branch, its reason and the text to search by (null when the code settled it)."""
    verdicts = judged.select(
        F.col("line_text"), F.col("product_text").alias("found_description"), "same", F.col("why").alias("said")
    )
    lines = coded.withColumn("line_text", F.coalesce("description", F.lit("")))
    joined = lines.join(verdicts, ["line_text", "found_description"], "left")
    same = F.coalesce("same", F.lit(False))
    named = F.col("found_code").isNotNull()
    has_code = F.coalesce("customer_code", F.lit("")) != ""
    return joined.select(
        *coded.columns,
        "line_text",
        F.when(named & same, CODE_CONFIRMED).when(named, CODE_REJECTED).otherwise(BY_SEARCH).alias("how"),
        F.when(named & same, and_said(F.lit(CONFIRMED), F.col("said")))
        .when(named, and_said(F.format_string(REJECTED, "found_code"), F.col("said")))
        .when(has_code, F.lit(SEARCHED))
        .otherwise(F.lit(NO_CODE))
        .alias("why"),
        F.when(~(named & same), F.col("line_text")).alias("query"),
    )


def three_branch_match(
    lines: DataFrame, codes: DataFrame, index: SearchIndex, judged: DataFrame, k: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(matched lines, their candidates). Every line comes out once, whatever was found for it.

    `lines` carries `line_key`, `description`, `customer_code`; the text each line was searched by is in `query`, and
    candidates are kept per distinct query text rather than repeated for every line.
    """
    coded = lookup_code(lines, codes)
    settled = settle_lines(coded, judged)
    candidates = stored(search(settled.where("query is not null").select("query"), index, k), "candidates")
    answered = candidates.groupBy("query").agg(F.count(F.lit(1)).alias("offered"))
    counted = settled.join(answered, "query", "left")
    empty = F.col("query").isNotNull() & F.col("offered").isNull()
    no_list = F.coalesce(index.totals.select("rows").scalar(), F.lit(0)) == 0
    matched = counted.select(
        *lines.columns,
        F.when(empty, NOTHING).otherwise(F.col("how")).alias("how"),
        F.when(no_list, F.lit(NO_CATALOGUE))
        .when(empty, F.concat_ws(" ", "why", F.lit(NOTHING_FOUND)))
        .otherwise(F.col("why"))
        .alias("why"),
        F.when(no_list, F.lit("")).otherwise(F.coalesce("query", F.lit(""))).alias("query"),
        F.when(F.col("how") == CODE_CONFIRMED, F.col("found_code")).alias("item_code"),
        F.when(F.col("how") == CODE_CONFIRMED, F.col("found_description")).alias("item_description"),
        F.coalesce("offered", F.lit(0)).alias("offered"),
    )
    return matched, candidates


def score_by_coverage(questions: DataFrame) -> DataFrame:
    """The plain scorer: word coverage of the question by the product. It measures, it does not rank."""
    return questions.withColumn("confidence", word_coverage(F.col("line_text"), F.col("product_text"))).withColumn(
        "score_why", F.lit("")
    )


def settled_word_for_word(questions: DataFrame) -> DataFrame:
    """Candidates of lines where some candidate says the very words of the line.

    `questions` carries `line_key`, `line_text`, `product_text` and `rank`. The equal ones get 100, their neighbours
    no score; `asked` marks the lines that still need assessing.
    """
    equal = same_words(F.col("line_text"), F.col("product_text"))
    marked = questions.withColumn("equal", equal)
    lines = marked.groupBy("line_key").agg(F.max("equal").alias("settled"))
    return marked.join(lines, "line_key").select(
        *questions.columns,
        (~F.col("settled")).alias("asked"),
        F.when(F.col("settled") & F.col("equal"), F.lit(100)).alias("confidence"),
        F.when(F.col("settled") & F.col("equal"), F.lit(WORD_FOR_WORD))
        .when(F.col("settled"), F.lit(NOT_ASSESSED))
        .otherwise(F.lit(""))
        .alias("score_why"),
    )


def score_candidates(questions: DataFrame, scorer: Scorer = score_by_coverage, ranks: bool = False) -> DataFrame:
    """Score every (line, candidate) with the given scorer, re-ranking only when the scorer judges."""
    scored = scorer(questions)
    return rerank(scored) if ranks else scored


def rerank(scored: DataFrame) -> DataFrame:
    """Best confidence first, unscored last, otherwise as searched. A line has at most its shortlist of candidates."""
    order = Window.partitionBy("line_key").orderBy(F.col("confidence").desc_nulls_last(), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order))


def match_summary(matched: DataFrame, key: str) -> DataFrame:
    return matched.groupBy(key).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("how") == CODE_CONFIRMED).alias("confirmed"),
        F.count_if(F.col("how") == BY_SEARCH).alias("searched"),
        F.count_if(F.col("how") == CODE_REJECTED).alias("overruled"),
        F.count_if(F.col("how") == NOTHING).alias("unmatched"),
    )


def candidate_differences(candidates: DataFrame) -> DataFrame:
    """Words some candidates of a line carry and others do not, in first seen order, for two candidates or more."""
    offered = candidates.groupBy("line_key").agg(F.count(F.lit(1)).alias("offered")).where("offered > 1")
    words = candidates.select("line_key", "rank", F.posexplode(tokens(F.col("product_text"))).alias("at", "word"))
    seen = words.groupBy("line_key", "word").agg(
        F.count_distinct("rank").alias("carriers"), F.min(F.struct("rank", "at")).alias("first")
    )
    return (
        seen.join(offered, "line_key")
        .where("carriers < offered")
        .groupBy("line_key")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("first", "word"))), lambda one: one["word"]), ", "
            ).alias("differences")
        )
    )
