"""How sure a match is, from property by property assessments."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.functions.values import strip
from quoteflow.functions.words import unspaced
from quoteflow.operators.common import first_wins

# Fixed values.
PRODUCT_SHARE = 50
KEY_WEIGHT = 3
MINOR_WEIGHT = 1
UNCONFIRMED_CREDIT = 0.5


def agreement(line_value: Column, item_value: Column, agrees: Column) -> Column:
    """match / conflict / unstated / unconfirmed; null when neither side says anything."""
    line = strip(F.coalesce(line_value, F.lit(""))) != ""
    item = strip(F.coalesce(item_value, F.lit(""))) != ""
    return (
        F.when(line & item & agrees, "match")
        .when(line & item, "conflict")
        .when(item, "unstated")
        .when(line, "unconfirmed")
    )


def complete_assessments(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers of the lines that were answered for every candidate.

    `answers` carries `line_key`, `answer_no` (a line may be answered more than once), `candidate`, `ord` and the
    answer itself; `asked` carries `line_key` and `candidates`. Numbers outside 1..n are ignored, the first answer per
    candidate counts, and the first complete answer of a line stands.
    """
    known = answers.join(asked, "line_key").where("candidate between 1 and candidates")
    firsts = first_wins(known, ["line_key", "answer_no", "candidate"], ["ord"])
    whole = (
        firsts.groupBy("line_key", "answer_no", "candidates")
        .agg(F.count(F.lit(1)).alias("given"))
        .where("given = candidates")
        .groupBy("line_key")
        .agg(F.min("answer_no").alias("answer_no"))
    )
    return firsts.join(whole, ["line_key", "answer_no"], "left_semi")


def confidences(checks: DataFrame) -> DataFrame:
    """One score per (line, candidate) from its property checks.

    `checks` carries `line_key`, `candidate`, `same_product` and, per property, `name`, `is_key`, `line_value`,
    `item_value`, `agrees`; a candidate without properties has one row with a null name. The variants of an unstated
    property are counted over the viable candidates of the line.
    """
    noted = checks.withColumn(
        "agreement", F.when(F.col("name").isNotNull(), agreement(F.col("line_value"), F.col("item_value"), F.col("agrees")))
    )
    viable = noted.groupBy("line_key", "candidate").agg(
        (F.min("same_product") & ~F.coalesce(F.max(F.col("agreement") == "conflict"), F.lit(False))).alias("viable")
    )
    judged = noted.join(viable, ["line_key", "candidate"]).withColumn("property", unspaced(F.col("name")))
    variants = (
        judged.where("viable and agreement = 'unstated'")
        .groupBy("line_key", "property")
        .agg(F.count_distinct(unspaced(strip("item_value"))).alias("variants"))
    )
    weight = F.when(F.col("is_key"), KEY_WEIGHT).otherwise(MINOR_WEIGHT)
    credit = (
        F.when(F.col("agreement") == "match", 1.0)
        .when(F.col("agreement") == "unstated", F.lit(1.0) / F.greatest(F.lit(1), F.coalesce("variants", F.lit(1))))
        .when(F.col("agreement") == "unconfirmed", UNCONFIRMED_CREDIT)
        .otherwise(0.0)
    )
    counted = F.col("agreement").isNotNull()
    sums = judged.join(variants, ["line_key", "property"], "left").groupBy("line_key", "candidate").agg(
        F.first("viable").alias("viable"),
        F.sum(F.when(counted, weight)).alias("total"),
        F.sum(F.when(counted, weight * credit)).alias("earned"),
    )
    share = F.lit(PRODUCT_SHARE) + F.lit(100 - PRODUCT_SHARE) * F.col("earned") / F.col("total")
    score = (
        F.when(~F.col("viable"), 0)
        .when(F.col("total").isNull(), 100)
        .otherwise(F.floor(F.round(share, 9) + 0.5).cast("int"))
    )
    return sums.select("line_key", "candidate", "viable", score.alias("confidence"))
