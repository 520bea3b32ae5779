"""Ranked search of the product list, with repair of misspelt words.

Each distinct query text is asked once. Scores are rounded before they rank, so that the order of summation cannot
change a shortlist; ties go to the earlier catalogue row.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions.words import normalize_code, tokens
from quoteflow.operators.catalog import (
    bag_postings,
    block_heads,
    collection_totals,
    index_words,
    lookup_code,
    place_bags,
    saturation,
    word_bags,
    word_statistics,
)
from quoteflow.operators.common import broadcast_if_small
from quoteflow.sources.store import stored

# Blocks of a query that are scored first, to learn what the others must reach.
PROBED = 2
# Queries that hold one word and meet its blocks in one piece.
QUERIES_PER_PIECE = 5_000
# More than rounding can move a score.
SLACK = 0.0002

# Fixed values.
REPAIRABLE = 5
MISSPELLED = 0.5
SCORE_DIGITS = 4
LETTERS_ONLY = r"^\p{L}+$"


def one_letter_gone(word: Column) -> Column:
    """The word and every form of it with one letter left out: words one edit apart share one of these."""
    at = F.sequence(F.lit(1), F.length(word))
    shorter = F.transform(
        at, lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, F.length(word)))
    )
    return F.array_distinct(F.concat(F.array(word), shorter))


def repairable(word: Column) -> Column:
    return (F.length(word) >= REPAIRABLE) & word.rlike(LETTERS_ONLY)


def repair_words(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, spelling): the only known word one edit away, for unknown words of letters only."""
    asked = unknown.select("word").where(repairable(F.col("word"))).distinct()
    known = vocabulary.select(F.col("word").alias("spelling")).where(repairable(F.col("spelling")))
    asked_keys = asked.select("word", F.explode(one_letter_gone(F.col("word"))).alias("key"))
    known_keys = known.select("spelling", F.explode(one_letter_gone(F.col("spelling"))).alias("key"))
    near = (
        asked_keys.join(known_keys, "key")
        .where(F.levenshtein("word", "spelling") == 1)
        .select("word", "spelling")
        .distinct()
    )
    return (
        near.groupBy("word")
        .agg(F.min("spelling").alias("spelling"), F.count(F.lit(1)).alias("readings"))
        .where("readings = 1")
        .select("word", "spelling")
    )


def query_terms(queries: DataFrame, words: DataFrame, repair: bool = True) -> DataFrame:
    """(query, word, weight): words of each distinct query as the index spells them, repeats adding up."""
    said = (
        queries.select("query").distinct()
        .select("query", F.explode(tokens(F.col("query"))).alias("word"))
        .groupBy("query", "word")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    known = words.select("word", F.lit(True).alias("known"))
    marked = said.join(known, "word", "left")
    direct = marked.where("known").select("query", "word", F.col("times").cast("double").alias("weight"))
    if not repair:
        return direct
    unknown = marked.where("known is null")
    repaired = unknown.join(repair_words(unknown, words), "word").select(
        "query", F.col("spelling").alias("word"), (F.col("times") * F.lit(MISSPELLED)).alias("weight")
    )
    return direct.unionByName(repaired).groupBy("query", "word").agg(F.sum("weight").alias("weight"))


def term_score(weight: Column, idf: Column, tf: Column, length: Column, average: Column) -> Column:
    return weight * idf * saturation(tf, length, average)


@dataclass(frozen=True)
class SearchIndex:
    """The stored tables a search reads.

    Items; their bags, in blocks of like bags; postings of the bags by word and block; the greatest impact of each word
    in each block; word statistics; and one row of totals.
    """

    items: DataFrame
    bags: DataFrame
    postings: DataFrame
    heads: DataFrame
    words: DataFrame
    totals: DataFrame


def build_index(items: DataFrame, with_customer_wording: bool = False, block_bags: int | None = None) -> SearchIndex:
    """Index the items once; every search after this reads the stored tables."""
    folded = stored(word_bags(items, with_customer_wording), "bags")
    totals = stored(collection_totals(folded), "totals")
    words = stored(word_statistics(folded, totals), "words")
    bags = stored(place_bags(folded, words, totals, block_bags), "placed-bags")
    postings = stored(bag_postings(bags), "postings")
    return SearchIndex(items, bags, postings, stored(block_heads(postings, totals), "heads"), words, totals)


def in_pieces(
    terms: DataFrame, lists: DataFrame, ask: list[str], per_piece: int = QUERIES_PER_PIECE, spread: int | None = None
) -> DataFrame:
    """`terms` joined with `lists` on `word`; a word of very many queries meets its list in pieces of them.

    `ask` names the columns that tell queries apart. Both may be small and what they meet is much: with `spread`
    either lies in so many tasks where the other is broadcast.
    """
    held = terms.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_piece)
    pieces = broadcast_if_small(stored(held.select("word", F.ceil(F.col("n") / per_piece).cast("int").alias("pieces")), "common"))
    one = F.coalesce("pieces", F.lit(1))
    cut = terms.join(pieces, "word", "left").withColumn("piece", F.pmod(F.xxhash64(*ask), one).cast("int")).drop("pieces")
    sent = lists.join(pieces, "word", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), one - 1))).drop("pieces")
    if spread is not None:
        cut, sent = cut.repartition(spread, *ask), sent.repartition(spread, "word", "block")
    return cut.join(sent, ["word", "piece"]).drop("piece")


def block_bounds(terms: DataFrame, heads: DataFrame, ask: list[str], spread: int | None = None) -> DataFrame:
    """(*ask, block, bound): the most a row of each block can score for each query."""
    worth = F.col("weight") * F.col("idf") * F.col("best")
    return in_pieces(terms, heads, ask, spread=spread).groupBy(*ask, "block").agg(F.sum(worth).alias("bound"))


def score_blocks(blocks: DataFrame, terms: DataFrame, postings: DataFrame, average: Column, ask: list[str]) -> DataFrame:
    """(*ask, product_key, position, score) of every bag in the given (*ask, block) that shares a word with the query."""
    part = term_score(F.col("weight"), F.col("idf"), F.col("tf"), F.col("row_length"), average)
    # What is asked is few bytes and what it meets many: it is dealt out to as many tasks as a shuffle has. A bag is in
    # one block, so its score is summed up where the block is met.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks.select(*ask, "block").join(terms, ask).repartition(tasks, *ask, "block")
    return asked.join(postings, ["word", "block"]).groupBy(*ask, "block", "product_key", "position").agg(
        F.round(F.sum(part), SCORE_DIGITS).alias("score")
    ).drop("block")


def score_bags(queries: DataFrame, index: SearchIndex, *, repair: bool = True, k: int | None = None) -> DataFrame:
    """(query, product_key, position, score) for every bag of rows that may be among the k best of the query.

    A query's blocks are ranked by what their rows can score at most. The best blocks are scored first; the k-th product
    found in them says what a row must reach, and only blocks that can reach it are scored besides. Scores are exact.
    Without k, every bag that shares a word with the query.
    """
    # Both are read several times below, and the queries may be costly to come by.
    asked = stored(queries.select("query").distinct(), "queries")
    terms = stored(query_terms(asked, index.words, repair).join(index.words.select("word", "idf"), "word"), "terms")
    average = index.totals.select("average_length").scalar()
    ask = ["query"]
    if k is None:
        part = term_score(F.col("weight"), F.col("idf"), F.col("tf"), F.col("row_length"), average)
        return in_pieces(terms, index.postings, ask).groupBy("query", "product_key", "position").agg(
            F.round(F.sum(part), SCORE_DIGITS).alias("score")
        )
    bounds = stored(block_bounds(terms, index.heads, ask), "bounds")
    probed, rest = promising_blocks(bounds, k, lambda first: score_blocks(first, terms, index.postings, average, ask))
    return probed.unionByName(score_blocks(rest, terms, index.postings, average, ask))


def promising_blocks(bounds: DataFrame, k: int, score) -> tuple[DataFrame, DataFrame]:
    """The scores of each query's best blocks, and the other blocks that may hold a row among its k best products."""
    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("nth", F.row_number().over(highest)).where(F.col("nth") <= PROBED)
    probed = stored(score(first), "probed")
    products = probed.groupBy("query", "product_key").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"))
    reached = products.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == k).select(
        "query", F.col("score").alias("reached")
    )
    others = bounds.join(first.select("query", "block"), ["query", "block"], "left_anti").join(reached, "query", "left")
    return probed, others.where(F.col("bound") >= F.coalesce(F.col("reached"), F.lit(0.0)) - SLACK)


def best_per_product(scored: DataFrame, k: int) -> DataFrame:
    """(query, rank, position, score): the best row of each product, the k best products."""
    if k < 1:
        raise ValueError("at least one candidate must be asked for")
    order = F.struct(F.col("score"), -F.col("position"))
    best = scored.groupBy("query", "product_key").agg(
        F.max_by(F.struct("position", "score"), order).alias("best")
    ).select("query", "product_key", "best.*")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "position")
    return best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: SearchIndex, k: int = 20, *, repair: bool = True) -> DataFrame:
    """The k best products for each distinct `query` text, with their code and description."""
    if k < 1:
        raise ValueError("at least one candidate must be asked for")
    ranked = best_per_product(score_bags(queries, index, repair=repair, k=k), k)
    return ranked.join(index.items.select("position", "code", "description"), "position").select(
        "query", "rank", "position", "code", "description", "score", "product_key"
    )


def rank_rows(queries: DataFrame, index: SearchIndex, k: int) -> DataFrame:
    """The k best catalogue rows for each query, several rows of one product included.

    Rows of a bag score alike, so the k best rows lie in the k best bags; only those are opened into rows.
    """
    scored = score_bags(queries, index, k=k)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "position")
    top = scored.withColumn("bag_rank", F.row_number().over(by_score)).where(F.col("bag_rank") <= k)
    # Only rows of the products found, and of those only the bags found, are opened.
    wanted = index.bags.join(top.select("position").distinct(), "position", "left_semi").select("product_key", "bag", "position")
    rows = index.items.select(F.col("position").alias("row_position"), normalize_code(F.col("code")).alias("product_key"), "code", "description")
    met = rows.join(wanted.select("product_key").distinct(), "product_key", "left_semi").withColumn("bag", F.array_sort(index_words()))
    bag_of = met.join(wanted, ["product_key", "bag"]).select("position", "row_position")
    in_bag = Window.partitionBy("position").orderBy("row_position")
    first_rows = bag_of.withColumn("nth", F.row_number().over(in_bag)).where(F.col("nth") <= k).drop("nth")
    opened = top.join(first_rows, "position")
    final = Window.partitionBy("query").orderBy(F.desc("score"), "row_position")
    return (
        opened.withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query", "rank", F.col("row_position").alias("position"), "score")
    )


def shortlist(lines: DataFrame, codes: DataFrame, index: SearchIndex, k: int = 20) -> DataFrame:
    """What the list says about each line: the code's product first, then the search; at most k.

    `lines` carries `line_key`, `description` and `customer_code`. `confirmed` is null unless a code was found and
    there were words to check it against.
    """
    keyed = lookup_code(lines.select("line_key", "description", "customer_code"), codes).withColumn(
        "searched", F.size(tokens(F.col("description"))) > 0
    )
    asked = keyed.where("searched").select(F.col("description").alias("query"))
    ranked = stored(search(asked, index, k), "ranked").select(
        F.col("query").alias("description"), "rank", F.col("code").alias("candidate"), "score"
    )
    found = keyed.join(ranked, "description")
    by_code = keyed.where("found_code is not null")
    own_score = (
        found.where("candidate = found_code")
        .groupBy("line_key")
        .agg(F.min_by("score", "rank").alias("own_score"))
    )
    led = by_code.join(own_score, "line_key", "left")
    confirmed = F.when(F.col("searched"), F.col("own_score").isNotNull())
    lead = led.select(
        "line_key",
        F.lit(0).alias("place"),
        F.col("found_code").alias("candidate"),
        F.coalesce("own_score", F.lit(0.0)).alias("score"),
    )
    others = found.where("found_code is null or candidate <> found_code").select(
        "line_key", F.col("rank").alias("place"), "candidate", "score"
    )
    order = Window.partitionBy("line_key").orderBy("place")
    candidates = lead.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    flags = led.select("line_key", "found_code", confirmed.alias("confirmed"))
    return candidates.join(flags, "line_key", "left").select(
        "line_key",
        "rank",
        "candidate",
        "score",
        F.col("found_code").alias("by_code"),
        "confirmed",
        F.coalesce(F.col("found_code").isNotNull() & ~F.col("confirmed"), F.lit(False)).alias("conflicted"),
    )
