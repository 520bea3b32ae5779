"""Header answers are moved once, to the others of their request."""

from quoteflow.operators.extraction import accept_header_answers

ANSWERS = [
    (1, 1, "imo", "9", "a.xlsx#S row 3"), (1, 2, "imo", "8", "a.xlsx"), (1, 3, "eta", " ", "a.xlsx"), (1, 4, "eta", "x", "elsewhere"),
    (2, 1, "eta", "y", "a.xlsx"), (None, 1, "eta", "z", "a.xlsx"), (None, 2, "eta", "z", "a.xlsx"), (3, 1, "eta", "z", None),
]


def test_one_move_gives_first_answers_and_known_sources(spark):
    answers = spark.createDataFrame(ANSWERS, "rfq_id long, ord int, field string, value string, source string")
    sources = spark.createDataFrame([(1, "a.xlsx"), (1, None), (3, "b")], "rfq_id long, label string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = accept_header_answers(answers, sources)
        plan = judged._jdf.queryExecution().executedPlan().toString()
        found = {(r["rfq_id"], r["ord"]): (r["refused"], r["unknown_source"]) for r in judged.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # One for the answers, one for the labels.
    assert plan.count("Exchange hashpartitioning") == 2
    assert {key: unknown for key, (refused, unknown) in found.items() if refused is None} == {
        (1, 1): False, (1, 4): True, (2, 1): True, (None, 1): True, (None, 2): True,
    }
    assert len(found) == len(ANSWERS)
