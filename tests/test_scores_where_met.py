"""Scores of blocks are made by as many tasks as a shuffle has, and summed up where the block is met."""

from pyspark.sql import functions as F

from quoteflow.operators import search


def test_blocks_asked_for_are_dealt_out(spark):
    items = spark.createDataFrame(
        [(n, f"AB-{n}", f"{'steel' if n % 3 else 'brass'} ring {n % 7}", "") for n in range(60)],
        "position long, code string, description string, customer_description string",
    )
    index = search.build_index(items, block_bags=8)
    queries = spark.createDataFrame([("steel ring 4",), ("brass ring",)], "query string")
    terms = search.query_terms(queries, index.words).join(index.words.select("word", "idf"), "word")
    blocks = index.heads.select("block").distinct().crossJoin(queries)
    scored = search.score_blocks(blocks, terms, index.postings, F.lit(4.0), ["query"])
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in plan
    # Summed up without another shuffle after the join.
    assert plan.index("HashAggregate") < plan.index("BroadcastHashJoin") < plan.index("REPARTITION_BY_NUM")
    assert "Exchange" not in plan[: plan.index("BroadcastHashJoin")]
    whole = search.score_bags(queries, index)
    assert scored.select("query", "product_key", "position").exceptAll(whole.select("query", "product_key", "position")).isEmpty()
