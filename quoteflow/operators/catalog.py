"""The product list: its columns, its items, its code keys and its word lists."""

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.functions.values import strip
from quoteflow.functions.words import normalize_code, tokens
from quoteflow.operators.common import first_wins, left_join_filled, number_all


# Fewest bags in a block of a small catalogue.
LEAST_BLOCK = 16
# Fixed values.
K1 = 1.2
B = 0.75
PICKER_DEFAULT = 50


def resolve_columns(df: DataFrame, wanted: Mapping[str, str], *, whitespace_only: bool = False) -> DataFrame:
    """Pick columns by loosely typed headings.

    Headings are compared without punctuation and case and a later duplicate wins; with `whitespace_only` only blanks
    and case are ignored and the first match wins. A heading that is absent gives an empty string column.
    """
    pattern = r"\s+" if whitespace_only else r"[\W_]+"

    def key(name: str) -> str:
        return re.sub(pattern, "", name).lower()

    found: dict[str, str] = {}
    for name in df.columns:
        if whitespace_only:
            found.setdefault(key(name), name)
        else:
            found[key(name)] = name
    picked = []
    for alias, heading in wanted.items():
        name = found.get(key(heading)) if heading else None
        column = F.col(f"`{name}`").cast("string") if name else F.lit("")
        picked.append(F.coalesce(column, F.lit("")).alias(alias))
    return df.select(*picked)


def catalog_items(rows: DataFrame) -> DataFrame:
    """Rows that have both a code and a description, with the whole row kept as a map.

    Expects `position`, `code`, `description`; every other string column goes along and into `fields`.
    """
    texts = [name for name, kind in rows.dtypes if kind == "string"]
    pairs: list[Column] = []
    for name in texts:
        pairs += [F.lit(name), F.coalesce(F.col(name), F.lit(""))]
    trimmed = {name: strip(F.coalesce(F.col(name), F.lit(""))) for name in texts}
    kept = rows.withColumn("fields", F.create_map(*pairs)).withColumns(trimmed)
    return kept.where((F.col("code") != "") & (F.col("description") != ""))


def code_index(items: DataFrame) -> DataFrame:
    """One row per code key: own codes first, customers' codes only where no own code has the key.

    Keys that normalise to nothing are left out: two codes of punctuation only are not one code.
    """
    own = items.select(normalize_code(F.col("code")).alias("code_key"), F.lit(0).alias("kind"), "position")
    alias = items.select(
        normalize_code(F.col("customer_code")).alias("code_key"), F.lit(1).alias("kind"), "position"
    )
    keys = first_wins(own.unionByName(alias).where(F.col("code_key") != ""), ["code_key"], ["kind", "position"])
    products = items.select("position", "code", "description")
    return keys.join(products, "position").select("code_key", "kind", "position", "code", "description")


def lookup_code(lines: DataFrame, index: DataFrame, code: str = "customer_code") -> DataFrame:
    """Every line with the product its code names, null where there is none."""
    named = index.select(
        "code_key",
        F.col("code").alias("found_code"),
        F.col("description").alias("found_description"),
        F.col("position").alias("found_position"),
    )
    return left_join_filled(lines.withColumn("code_key", normalize_code(F.col(code))), named, "code_key").drop("code_key")


def index_words(with_customer_wording: bool = False) -> Column:
    """What a product is found by: our description and code, the customer's wording only when asked for."""
    words = [tokens(F.col("description")), F.array(F.lower(normalize_code(F.col("code"))))]
    if with_customer_wording:
        words.append(tokens(F.col("customer_description")))
    return F.concat(*words)


def build_postings(items: DataFrame, with_customer_wording: bool = False) -> DataFrame:
    """(position, word, tf, row_length) for every catalogue row."""
    words = items.select("position", index_words(with_customer_wording).alias("words"))
    exploded = words.select("position", F.size("words").alias("row_length"), F.explode("words").alias("word"))
    return exploded.groupBy("position", "word", "row_length").agg(F.count(F.lit(1)).alias("tf"))


def word_bags(items: DataFrame, with_customer_wording: bool = False) -> DataFrame:
    """Catalogue rows that must score alike, folded into one: same product key and same words.

    Only the first row of a bag can stand for its product, so the search loses nothing; `copies` keeps the row counts
    that document frequencies and the average length are made of. With customer wordings a bag has one wording.
    """
    keys = ["product_key", "bag"]
    columns = [
        F.col("position"),
        normalize_code(F.col("code")).alias("product_key"),
        F.array_sort(index_words(with_customer_wording)).alias("bag"),
    ]
    if with_customer_wording:
        keys.append("wording")
        columns.append(strip("customer_description").alias("wording"))
    return items.select(*columns).groupBy(*keys).agg(
        F.min("position").alias("position"), F.count(F.lit(1)).alias("copies")
    )


def collection_totals(bags: DataFrame) -> DataFrame:
    """One row: how many catalogue rows there are, how long they are on average, and how many bags they make."""
    rows = F.sum("copies")
    return bags.agg(
        rows.alias("rows"), (F.sum(F.col("copies") * F.size("bag")) / rows).alias("average_length"),
        F.count(F.lit(1)).alias("bags"),
    )


def word_statistics(bags: DataFrame, totals: DataFrame) -> DataFrame:
    """(word, df, idf): frequencies counted in catalogue rows."""
    said = bags.select("copies", F.explode(F.array_distinct("bag")).alias("word"))
    counted = said.groupBy("word").agg(F.sum("copies").alias("df"))
    return counted.withColumn("idf", inverse_frequency(totals.select("rows").scalar(), F.col("df")))


def place_bags(bags: DataFrame, words: DataFrame, totals: DataFrame, block_bags: int | None = None) -> DataFrame:
    """The bags with their `block`: bags stand in the order of their words, rarest first, and are cut into equal blocks.

    Bags that share their rarer words so share a block, and most blocks hold few of the words a query has. Words of fewer
    rows than a block (a product's code) lie in few blocks anyhow and do not order. There are about as many blocks as
    bags in one.
    """
    if block_bags is None:
        block_bags = max(LEAST_BLOCK, math.isqrt(totals.first()["bags"] or 0))
    said = bags.select("position", F.explode(F.array_distinct("bag")).alias("word")).join(words.select("word", "df"), "word")
    telling = F.collect_list(F.when(F.col("df") >= block_bags, F.struct("df", "word")))
    rarest = F.array_join(F.transform(F.array_sort(telling), lambda one: one["word"]), " ")
    order = said.groupBy("position").agg(rarest.alias("words"))
    placed = number_all(order, ["words", "position"], "place")
    return bags.join(
        placed.select("position", F.floor((F.col("place") - 1) / F.lit(block_bags)).cast("long").alias("block")), "position"
    )


def bag_postings(bags: DataFrame) -> DataFrame:
    """(word, block, position, product_key, tf, row_length): a word's list is cut by block."""
    exploded = bags.select("position", "product_key", "block", F.size("bag").alias("row_length"), F.explode("bag").alias("word"))
    return exploded.groupBy("position", "product_key", "block", "row_length", "word").agg(F.count(F.lit(1)).alias("tf"))


def block_heads(postings: DataFrame, totals: DataFrame) -> DataFrame:
    """(word, block, best): the most that a row of the block gets out of the word, before weight and frequency."""
    gain = saturation(F.col("tf"), F.col("row_length"), totals.select("average_length").scalar())
    return postings.groupBy("word", "block").agg(F.max(gain).alias("best"))


def saturation(tf: Column, length: Column, average: Column) -> Column:
    """What saying a word `tf` times is worth in a row of this length."""
    norm = F.lit(1 - B) + F.lit(B) * (length / average)
    return (tf * F.lit(K1 + 1)) / (tf + F.lit(K1) * norm)


def inverse_frequency(rows: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (rows - df + F.lit(0.5)) / (df + F.lit(0.5)))


def product_picker(
    items: DataFrame, code: str = "", description: str = "", limit: int = PICKER_DEFAULT
) -> DataFrame:
    """Products whose code and description contain what was typed, first row per product, with the full total.

    As many as asked for; `total` tells what is left out.
    """
    kept = max(limit, 1)
    matches = items.where(
        F.upper("code").contains(code.strip().upper())
        & F.upper("description").contains(description.strip().upper())
    ).select(normalize_code(F.col("code")).alias("product_key"), "position", "code", "description")
    products = first_wins(matches, ["product_key"], ["position"])
    total = products.agg(F.count(F.lit(1)).alias("total")).select("total").scalar()
    return products.orderBy("position").limit(kept).select(
        "position", "code", "description", total.alias("total")
    )
