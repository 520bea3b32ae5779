"""Evaluation over labels and the catalogue (survey 2.H) and its check SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.operators import evaluation as ev
from quoteflow.operators import search
from quoteflow.plans import sqltext as q
from quoteflow.plans.base import Inputs, Query
from quoteflow.plans.matching import INDEX, RANKED, SCORED, TERMS, index_of

KEYS = ["pass_no"]


def _cases(t: Inputs) -> DataFrame:
    """Catalogue rows, some of them with wordings that say nothing."""
    return ev.recall_cases(_rows(t))


def _rows(t: Inputs) -> DataFrame:
    return t.catalog_rows.withColumn(
        "customer_description",
        F.when(F.col("position") % 31 == 0, F.lit("Text not visible")).otherwise(F.col("customer_description")),
    )


def ranked(t: Inputs, repair: bool = True) -> DataFrame:
    return ev.ranks_of_cases(_cases(t), index_of(t), repair=repair)


def recall(t: Inputs) -> DataFrame:
    live = ev.recall_at(ranked(t)).withColumn("variant", F.lit("as it runs"))
    return live.unionByName(ev.recall_at(ranked(t, repair=False)).withColumn("variant", F.lit("without typo repair")))


def _left_out(t: Inputs) -> DataFrame:
    index = t.kept("worded_index", lambda: search.build_index(_rows(t), with_customer_wording=True))
    return ev.ranks_leaving_one_out(_cases(t), index)


def left_out(t: Inputs) -> DataFrame:
    return ev.recall_at(_left_out(t))


def left_out_ranks(t: Inputs) -> DataFrame:
    return _long(_left_out(t).select("position", "rank"))


def missed(t: Inputs) -> DataFrame:
    return ev.missed_cases(ranked(t), t.catalog_rows)


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) if k == "int" else F.col(n) for n, k in df.dtypes])


RFQ = "('NEW_RFQ', 'UPDATED_RFQ', 'PORTAL_RFQ_NOTIFICATION')"
CHEAP = "expected IN ('OUTBOUND_OWN', 'INTERNAL')"
ESCAPED = f"expected IN {RFQ} AND recommended_action = 'IGNORE' AND NOT needs_human_review"


def _share(what: str, among: str) -> str:
    return f"round(avg(CASE WHEN {among} THEN CASE WHEN {what} THEN 1.0::DOUBLE ELSE 0 END END), 6)"


P95 = "min(latency_ms) FILTER (rank = ceil(n * 95 / 100.0))"
CASES = f"""rows AS (SELECT position, code, description, CASE WHEN position % 31 = 0 THEN 'Text not visible' ELSE customer_description END AS wording, {q.code_key('code')} AS expected_key FROM catalog_rows),
cases AS (SELECT position, wording, code AS expected_code, expected_key FROM rows WHERE wording <> '' AND NOT regexp_matches(lower(wording), 'not visible|not provided|not transcribed|partially visible|truncated|…')
    AND NOT regexp_matches(lower(code || ' ' || description), 'xx|assorted items'))"""
HEADLINE = f"""first AS (SELECT * FROM predictions WHERE pass_no = 1),
slow AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS rank, count(*) OVER () AS n FROM first WHERE latency_ms IS NOT NULL),
same AS (SELECT email_id, count(DISTINCT predicted) AS answers FROM predictions GROUP BY email_id),
figures AS (SELECT count(*) AS emails, {_share('expected = predicted', 'true')} AS accuracy, {_share('expected = predicted', "expected IN ('OUTBOUND_OWN', 'INTERNAL')")} AS accuracy_cheap,
    {_share(f'predicted IN {RFQ}', f'expected IN {RFQ}')} AS rfq_recall, {_share(ESCAPED, f'expected IN {RFQ}')} AS escaped_rate, CAST(count(*) FILTER (held_out) AS BIGINT) AS held_out,
    {_share('expected = predicted', 'held_out')} AS held_out_accuracy, (SELECT {P95} FROM slow) AS p95_latency_ms,
    (SELECT round(avg(CASE WHEN answers = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM same) AS stability FROM first)"""


def _recall_sql(ranked_cte: str, variant: str) -> str:
    at = ", ".join(f"round(avg(CASE WHEN r.rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_{k}" for k in ev.RECALL_AT)
    return f"SELECT '{variant}' AS variant, count(*) AS cases, {at} FROM cases c LEFT JOIN {ranked_cte} r ON r.query = c.wording AND r.product_key = c.expected_key AND r.rank <= 20"


# Every case with its own index: counts, lengths and words as they are without its sentence.
LEFT_OUT = f"""WITH {CASES},
it AS (SELECT position, expected_key AS product_key, trim(wording) AS wording, list_append({q.tokens('description')}, lower(expected_key)) AS own, {q.tokens('wording')} AS said FROM rows),
whole AS (SELECT *, list_concat(own, said) AS words FROM it), totals AS (SELECT count(*) AS n, avg(len(words)) AS average FROM whole),
posted AS (SELECT position, word, count(*) AS tf FROM (SELECT position, unnest(words) AS word FROM whole) GROUP BY ALL),
own_posted AS (SELECT position, word, count(*) AS tf FROM (SELECT position, unnest(own) AS word FROM whole) GROUP BY ALL),
freq AS (SELECT word, count(*) AS df FROM posted GROUP BY word),
asked AS (SELECT wording, expected_key, row_number() OVER (ORDER BY wording, expected_key) AS c FROM (SELECT DISTINCT wording, expected_key FROM cases)),
hid AS (SELECT c, w.position, w.said, w.own FROM asked a JOIN whole w ON w.wording = a.wording AND w.product_key = a.expected_key),
lost AS (SELECT c, word, count(*) AS n FROM (SELECT DISTINCT c, position, unnest(list_filter(said, lambda x: NOT list_contains(own, x))) AS word FROM hid) GROUP BY ALL),
query_words AS (SELECT c, word, count(*) AS times FROM (SELECT c, unnest({q.tokens('wording')}) AS word FROM asked) GROUP BY ALL),
counted AS (SELECT c, word, times, f.df - coalesce(l.n, 0) AS df FROM query_words JOIN freq f USING (word) LEFT JOIN lost l USING (c, word)),
gone AS (SELECT c, word, times FROM counted WHERE df <= 0 AND length(word) >= 5 AND regexp_full_match(word, '\\p{{L}}+')),
near AS (SELECT g.c, g.word, g.times, f.word AS spelling, f.df - coalesce(l.n, 0) AS df FROM gone g JOIN freq f ON length(f.word) >= 5 AND regexp_full_match(f.word, '\\p{{L}}+') AND levenshtein(g.word, f.word) = 1 LEFT JOIN lost l ON l.c = g.c AND l.word = f.word WHERE f.df > coalesce(l.n, 0)),
mended AS (SELECT c, min(spelling) AS word, min(times) * 0.5 AS weight, min(df) AS df FROM near GROUP BY c, near.word HAVING count(*) = 1),
terms AS (SELECT c, word, df, sum(weight) AS weight FROM (SELECT c, word, df, CAST(times AS DOUBLE) AS weight FROM counted WHERE df > 0 UNION ALL SELECT c, word, df, weight FROM mended) GROUP BY ALL),
averages AS (SELECT c, average - sum(len(said)) / any_value(n) AS average FROM hid, totals GROUP BY c, average),
hits AS (SELECT t.c, p.position, t.weight, t.df, p.tf, len(w.words) AS row_length FROM terms t JOIN posted p USING (word) JOIN whole w USING (position) WHERE NOT EXISTS (SELECT 1 FROM hid h WHERE h.c = t.c AND h.position = p.position)
  UNION ALL SELECT t.c, p.position, t.weight, t.df, p.tf, len(h.own) FROM terms t JOIN hid h USING (c) JOIN own_posted p ON p.position = h.position AND p.word = t.word),
scored AS (SELECT c, position, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (row_length / a.average)))), 4) AS score FROM hits JOIN averages a USING (c), totals GROUP BY ALL),
best AS (SELECT c, product_key, position, score FROM scored JOIN whole USING (position) QUALIFY row_number() OVER (PARTITION BY c, product_key ORDER BY score DESC, position) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, position) AS rank FROM best)"""
REPORT = f"""WITH {HEADLINE}, labels_of AS (SELECT expected AS label FROM first UNION SELECT predicted FROM first),
counts AS (SELECT label, count(*) FILTER (expected = label) AS support, count(*) FILTER (predicted = label) AS predicted_as, count(*) FILTER (expected = label AND predicted = label) AS hits FROM labels_of, first GROUP BY label),
rates AS (SELECT *, CASE WHEN predicted_as > 0 THEN hits / predicted_as END AS p, CASE WHEN support > 0 THEN hits / support END AS r FROM counts),
classes AS (SELECT label, CAST(support AS DOUBLE) AS support, CAST(predicted_as AS DOUBLE) AS predicted_as, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall, round(CASE WHEN p + r > 0 THEN CAST(2 * p * r / (p + r) AS DOUBLE) END, 6) AS f1 FROM rates),
shown AS (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM figures)
SELECT 'headline' AS section, '' AS label, metric, value FROM (UNPIVOT shown ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT 'per_class', label, metric, value FROM (UNPIVOT classes ON support, predicted_as, precision, recall, f1 INTO NAME metric VALUE value)
UNION ALL SELECT 'confusion', expected, predicted, CAST(count(*) AS DOUBLE) FROM first GROUP BY expected, predicted"""
CASE_TERMS = TERMS.replace("SELECT DISTINCT description AS query FROM rfq_lines", "SELECT DISTINCT wording AS query FROM cases")
PLAIN_RANKED = """plain_scored AS (SELECT query, position, round(sum(times * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (row_length / average)))), 4) AS score
    FROM said JOIN freq USING (word) JOIN posted USING (word) JOIN lengths USING (position), totals GROUP BY ALL),
plain_best AS (SELECT query, product_key, position, score FROM plain_scored JOIN items USING (position) QUALIFY row_number() OVER (PARTITION BY query, product_key ORDER BY score DESC, position) = 1),
plain_ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, position) AS rank FROM plain_best)"""

QUERIES = [
    Query("H1", "accuracy", lambda t: _long(ev.accuracy(t.predictions, KEYS)),
          f"SELECT CAST(pass_no AS BIGINT) AS pass_no, {_share('expected = predicted', 'true')} AS accuracy, {_share('expected = predicted', CHEAP)} AS accuracy_cheap FROM predictions GROUP BY pass_no"),
    Query("H2", "per_class", lambda t: _long(ev.per_class(t.predictions, KEYS)),
          """WITH labels_of AS (SELECT pass_no, expected AS label FROM predictions UNION SELECT pass_no, predicted FROM predictions),
counts AS (SELECT l.pass_no, label, count(*) FILTER (expected = label) AS support, count(*) FILTER (predicted = label) AS predicted_as, count(*) FILTER (expected = label AND predicted = label) AS hits
  FROM labels_of l JOIN predictions p ON p.pass_no = l.pass_no GROUP BY ALL),
rates AS (SELECT *, CASE WHEN predicted_as > 0 THEN hits / predicted_as END AS p, CASE WHEN support > 0 THEN hits / support END AS r FROM counts)
SELECT CAST(pass_no AS BIGINT) AS pass_no, label, support, predicted_as, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall, round(CASE WHEN p + r > 0 THEN CAST(2 * p * r / (p + r) AS DOUBLE) END, 6) AS f1 FROM rates"""),
    Query("H3", "confusion", lambda t: _long(ev.confusion(t.predictions, KEYS)),
          "SELECT CAST(pass_no AS BIGINT) AS pass_no, expected, predicted, count(*) AS n FROM predictions GROUP BY ALL"),
    Query("H4", "rfq_recall", lambda t: _long(ev.rfq_recall(t.predictions, KEYS)),
          f"SELECT CAST(pass_no AS BIGINT) AS pass_no, {_share(f'predicted IN {RFQ}', f'expected IN {RFQ}')} AS rfq_recall FROM predictions GROUP BY pass_no"),
    Query("H5", "escaped_rate", lambda t: _long(ev.escaped_rate(t.predictions, KEYS)),
          f"SELECT CAST(pass_no AS BIGINT) AS pass_no, {_share(ESCAPED, f'expected IN {RFQ}')} AS escaped_rate FROM predictions GROUP BY pass_no"),
    Query("H5", "escaped", lambda t: _long(ev.escaped(t.predictions).select("email_id", "pass_no", "predicted")),
          f"SELECT email_id, CAST(pass_no AS BIGINT) AS pass_no, predicted FROM predictions WHERE {ESCAPED}"),
    Query("H6", "p95_latency", lambda t: _long(ev.p95_latency(t.predictions, KEYS)),
          f"""WITH slow AS (SELECT pass_no, latency_ms, row_number() OVER (PARTITION BY pass_no ORDER BY latency_ms) AS rank, count(*) OVER (PARTITION BY pass_no) AS n FROM predictions WHERE latency_ms IS NOT NULL)
SELECT CAST(pass_no AS BIGINT) AS pass_no, {P95} AS p95_latency_ms FROM slow GROUP BY pass_no"""),
    Query("H7", "stability", lambda t: ev.stability(t.predictions),
          "SELECT round(avg(CASE WHEN answers = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS stability, count(*) FILTER (answers > 1) AS drifted FROM (SELECT email_id, count(DISTINCT predicted) AS answers FROM predictions GROUP BY email_id)"),
    Query("H7", "drifted", lambda t: ev.drifted(t.predictions),
          "SELECT email_id FROM predictions GROUP BY email_id HAVING count(DISTINCT predicted) > 1"),
    Query("H8", "acceptance_gate", lambda t: ev.acceptance_gate(ev.headline(t.predictions)),
          f"""WITH {HEADLINE}
SELECT * FROM (SELECT 'escaped_rfq_rate == 0' AS criterion, CAST(escaped_rate AS DOUBLE) AS value, escaped_rate = 0 AS passed FROM figures
  UNION ALL SELECT 'RFQ recall >= 0.95', rfq_recall, rfq_recall >= 0.95 FROM figures UNION ALL SELECT 'accuracy >= 0.85', accuracy, accuracy >= 0.85 FROM figures
  UNION ALL SELECT 'accuracy on OUTBOUND_OWN + INTERNAL >= 0.95', accuracy_cheap, accuracy_cheap >= 0.95 FROM figures
  UNION ALL SELECT 'p95 latency <= 5000 ms', p95_latency_ms, p95_latency_ms <= 5000 FROM figures UNION ALL SELECT 'same category on every pass', stability, stability = 1 FROM figures) WHERE value IS NOT NULL"""),
    Query("H9", "headline", lambda t: ev.headline(t.predictions), f"WITH {HEADLINE} SELECT * FROM figures"),
    Query("H9", "eval_report", lambda t: ev.eval_report(t.predictions), REPORT),
    Query("H10", "recall_cases", _cases, f"WITH {CASES} SELECT position, wording, expected_code, expected_key FROM cases"),
    Query("H11", "recall_at_k", recall,
          f"WITH {CASES},\n{INDEX},\n{CASE_TERMS},\n{SCORED},\n{RANKED},\n{PLAIN_RANKED}\n{_recall_sql('ranked', 'as it runs')} UNION ALL {_recall_sql('plain_ranked', 'without typo repair')}"),
    Query("H11", "recall_leaving_one_out", left_out,
          f"{LEFT_OUT} SELECT count(*) AS cases, " + ", ".join(f"round(avg(CASE WHEN r.rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_{k}" for k in ev.RECALL_AT)
          + " FROM cases c JOIN asked a USING (wording, expected_key) LEFT JOIN placed r ON r.c = a.c AND r.product_key = a.expected_key AND r.rank <= 20"),
    Query("H11", "ranks_leaving_one_out", left_out_ranks,
          f"{LEFT_OUT} SELECT c.position, r.rank FROM cases c JOIN asked a USING (wording, expected_key) LEFT JOIN placed r ON r.c = a.c AND r.product_key = a.expected_key AND r.rank <= 20"),
    Query("H12", "missed_cases", missed,
          f"""WITH {CASES},\n{INDEX},\n{CASE_TERMS},\n{SCORED},\n{RANKED}
SELECT position, wording, expected_code, (SELECT count(*) FROM rows r WHERE r.expected_key = c.expected_key) AS mentions, (SELECT count(*) FROM rows r WHERE r.expected_key = c.expected_key) = 1 AS mentioned_once
FROM cases c WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.query = c.wording AND r.product_key = c.expected_key AND r.rank <= 20)"""),
]
