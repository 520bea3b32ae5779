"""Catalogue matching over the test tables (survey 2.F) and its check SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteflow.functions.words import normalize_code, same_words, tokens
from quoteflow.operators import branches, catalog, confidence, search
from quoteflow.plans import sqltext as q
from quoteflow.plans.base import Inputs, Query
from quoteflow.sources.store import stored

K = 5


def texts(t: Inputs) -> DataFrame:
    return t.rfq_lines.select(F.col("description").alias("query"))


# --- check SQL shared by the searches ---------------------------------------------------------------------------

INDEX = f"""items AS (SELECT position, code, description, customer_description,
    {q.code_key('code')} AS product_key,
    list_append({q.tokens('description')}, lower({q.code_key('code')})) AS words FROM catalog_rows),
posted AS (SELECT position, word, count(*) AS tf FROM (SELECT position, unnest(words) AS word FROM items) GROUP BY ALL),
lengths AS (SELECT position, len(words) AS row_length FROM items),
totals AS (SELECT count(*) AS n, avg(row_length) AS average FROM lengths),
freq AS (SELECT word, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf
         FROM posted, totals GROUP BY word, n)"""
TERMS = f"""said AS (SELECT query, word, count(*) AS times
    FROM (SELECT query, unnest({q.tokens('query')}) AS word FROM (SELECT DISTINCT description AS query FROM rfq_lines))
    GROUP BY ALL),
unknown AS (SELECT DISTINCT word FROM said WHERE word NOT IN (SELECT word FROM freq)
    AND length(word) >= 5 AND regexp_full_match(word, '\\p{{L}}+')),
repaired AS (SELECT u.word, min(f.word) AS spelling FROM unknown u JOIN freq f
    ON length(f.word) >= 5 AND regexp_full_match(f.word, '\\p{{L}}+') AND levenshtein(u.word, f.word) = 1
    GROUP BY u.word HAVING count(*) = 1),
terms AS (SELECT query, word, sum(weight) AS weight FROM (
    SELECT query, word, CAST(times AS DOUBLE) AS weight FROM said WHERE word IN (SELECT word FROM freq)
    UNION ALL SELECT query, spelling, times * 0.5 FROM said JOIN repaired USING (word)) GROUP BY ALL)"""
MANY_TEXTS = "SELECT DISTINCT description || ', ' || CAST(l_suppkey % 25 + 1 AS VARCHAR(10)) || 'MM' AS query FROM rfq_lines"
SCORED = """scored AS (SELECT query, position,
    round(sum(weight * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (row_length / average)))), 4) AS score
    FROM terms JOIN freq USING (word) JOIN posted USING (word) JOIN lengths USING (position), totals GROUP BY ALL)"""
RANKED = """best AS (SELECT query, product_key, position, code, description, score
    FROM scored JOIN items USING (position)
    QUALIFY row_number() OVER (PARTITION BY query, product_key ORDER BY score DESC, position) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, position) AS rank FROM best)"""
SEARCH = f"WITH {INDEX},\n{TERMS},\n{SCORED},\n{RANKED}"
CODES = f"""codes AS (SELECT * FROM (
    SELECT {q.code_key('code')} AS code_key, 0 AS kind, position, code, description FROM catalog_rows
    UNION ALL SELECT {q.code_key('customer_code')}, 1, position, code, description FROM catalog_rows)
    WHERE code_key <> '' QUALIFY row_number() OVER (PARTITION BY code_key ORDER BY kind, position) = 1)"""
CODED = f"""coded AS (SELECT l.rfq_id, l.line_index, l.description, l.customer_code, c.code AS found_code,
    c.description AS found_description, c.position AS found_position
    FROM rfq_lines l LEFT JOIN codes c ON c.code_key = {q.code_key('l.customer_code')})"""
# A pair is agreed on the parity of its text lengths, and one in seven is left unanswered.
ANSWERED = "(length(line_text) * 3 + length(product_text) + pair_no)"
PAIRS = """pairs AS (SELECT line_text, product_text,
    row_number() OVER (ORDER BY first_rfq) AS pair_no FROM (
    SELECT coalesce(description, '') AS line_text, found_description AS product_text,
           min(rfq_id * 1000000 + line_index) AS first_rfq
    FROM coded WHERE found_code IS NOT NULL GROUP BY ALL)),
numbered AS (SELECT *, (pair_no - 1) // 50 AS batch, (pair_no - 1) % 50 AS index FROM pairs)"""
JUDGED = f"""judged AS (SELECT pair_no, line_text, product_text,
    CASE WHEN {ANSWERED} % 7 = 0 THEN false ELSE {ANSWERED} % 2 = 0 END AS same,
    CASE WHEN {ANSWERED} % 7 = 0 THEN '{branches.UNANSWERED}' ELSE 'pair ' || CAST(pair_no AS VARCHAR) END AS why
    FROM numbered)"""


def index_of(t: Inputs) -> search.SearchIndex:
    return t.kept("index", lambda: search.build_index(t.catalog_rows))


def codes_of(t: Inputs) -> DataFrame:
    return t.kept("codes", lambda: stored(catalog.code_index(t.catalog_rows), "codes"))


def _pairs(t: Inputs) -> DataFrame:
    coded = catalog.lookup_code(t.rfq_lines, codes_of(t))
    return branches.distinct_pairs(coded.withColumn("ord", F.expr("rfq_id * 1000000 + line_index")))


def _answers(pairs: DataFrame) -> DataFrame:
    """Stand-in judgements by arithmetic: an early wrong answer each, the right one after it, one in seven silent."""
    mark = F.expr(ANSWERED)
    given = pairs.where(mark % 7 != 0)
    late = given.select(
        "batch", "index", (mark % 2 == 0).alias("same"), F.format_string(" pair %d ", "pair_no").alias("why"),
        F.lit(2).alias("ord"),
    )
    early = given.select(
        "batch", "index", (mark % 2 != 0).alias("same"), F.lit("first thought").alias("why"), F.lit(1).alias("ord")
    )
    return late.unionByName(early)


def judged_pairs(t: Inputs) -> DataFrame:
    pairs = _pairs(t)
    return branches.join_judgements(pairs, _answers(pairs))


def _matched(t: Inputs) -> tuple[DataFrame, DataFrame]:
    return branches.three_branch_match(t.rfq_lines, codes_of(t), index_of(t), judged_pairs(t), K)


def matched_lines(t: Inputs) -> DataFrame:
    matched, _ = _matched(t)
    return matched.select(
        "rfq_id", "line_index", "how", "why", "query", "item_code", "item_description",
        F.col("offered").cast("long").alias("offered"),
    )


def best_matches(t: Inputs) -> DataFrame:
    """Every requested line with its best five products: the flagship."""
    lines = t.rfq_lines.select("rfq_id", "line_index", "description")
    found = search.search(lines.select(F.col("description").alias("query")), index_of(t), K)
    joined = lines.join(found, lines.description == found.query, "left")
    return joined.select("rfq_id", "line_index", F.col("rank").cast("long").alias("rank"), "code", "score")


def _questions(t: Inputs) -> DataFrame:
    """(line text, candidate) questions: one per distinct text, since equal texts get equal scores."""
    found = search.search(texts(t), index_of(t), K)
    return found.select(
        F.col("query").alias("line_key"), F.col("query").alias("line_text"),
        F.col("description").alias("product_text"), F.col("rank").cast("long").alias("rank"), "code",
    )


def scored_candidates(t: Inputs) -> DataFrame:
    scored = branches.score_candidates(_questions(t))
    return scored.select(
        "line_text", "rank", "product_text", F.col("confidence").cast("long").alias("confidence")
    )


def reranked(t: Inputs) -> DataFrame:
    scored = branches.score_candidates(_questions(t), ranks=True)
    return scored.select("line_text", "rank", F.col("new_rank").cast("long").alias("new_rank"))


def word_for_word(t: Inputs) -> DataFrame:
    """Lines that repeat a product's wording with other punctuation, against that product and its neighbour."""
    rows = t.catalog_rows.select("position", "description")
    own = rows.select(
        F.col("position").alias("line_key"),
        F.regexp_replace(F.upper("description"), ",", " ; ").alias("line_text"),
        F.col("description").alias("product_text"), F.lit(1).cast("long").alias("rank"),
    )
    last = rows.select((F.col("position") + 1).alias("line_key"), F.col("description").alias("product_text"))
    next_to = own.select("line_key", "line_text").join(last, "line_key").select(
        "line_key",
        F.when(F.col("line_key") % 3 == 0, F.concat("line_text", F.lit(" extra"))).otherwise(F.col("line_text")).alias("line_text"),
        "product_text", F.lit(2).cast("long").alias("rank"),
    )
    first = own.withColumn(
        "line_text",
        F.when(F.col("line_key") % 3 == 0, F.concat("line_text", F.lit(" extra"))).otherwise(F.col("line_text")),
    )
    out = branches.settled_word_for_word(first.unionByName(next_to))
    return out.select(
        "line_key", "rank", "asked", F.col("confidence").cast("long").alias("confidence"), "score_why"
    )


def same_words_check(t: Inputs) -> DataFrame:
    return t.catalog_rows.select(
        "position",
        same_words(F.regexp_replace("description", " ", " ( "), F.col("description")).alias("signs_ignored"),
        same_words(F.col("customer_description"), F.col("description")).alias("customer_same"),
        same_words(F.regexp_replace("code", "-", " "), F.col("code")).alias("dash_joined"),
        same_words(F.lit(" , "), F.lit(" , ")).alias("nothing_said"),
    )


def _checks(t: Inputs) -> DataFrame:
    """Property checks by arithmetic over the order lines: candidates of an order, their properties and answers."""
    return t.sql(CHECK_SOURCE)


CHECK_SOURCE = """SELECT l_orderkey AS line_key, l_suppkey % 3 AS candidate, l_suppkey % 5 <> 4 AS same_product,
       CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN 'Si ze' WHEN l_partkey % 3 = 1 THEN 'colour' ELSE 'size' END AS name,
       l_suppkey % 2 = 0 AS is_key,
       CASE WHEN l_quantity > 25 THEN ' v ' ELSE '' END AS line_value,
       CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE 'Val ' || CAST(l_partkey % 3 AS VARCHAR(10)) END AS item_value,
       l_partkey % 5 <> 0 AS agrees
FROM lineitem"""


def confidence_scores(t: Inputs) -> DataFrame:
    out = confidence.confidences(_checks(t))
    return out.select("line_key", "candidate", "viable", F.col("confidence").cast("long").alias("confidence"))


def agreements(t: Inputs) -> DataFrame:
    kind = confidence.agreement(F.col("line_value"), F.col("item_value"), F.col("agrees"))
    return (
        _checks(t).withColumn("agreement", F.coalesce(kind, F.lit("dropped")))
        .groupBy("line_key", "agreement").agg(F.count(F.lit(1)).alias("properties"))
    )


ANSWER_SOURCE = """SELECT l_orderkey AS line_key, l_suppkey % 2 AS answer_no, l_linenumber - 1 AS candidate,
       l_partkey * 100000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS ord,
       CASE WHEN l_tax > 0.04 THEN 'same' ELSE 'other' END AS answer
FROM lineitem"""


def assessments(t: Inputs) -> DataFrame:
    answers = t.sql(f"SELECT line_key, answer_no, candidate, min(ord) AS ord, min(answer) AS answer FROM ({ANSWER_SOURCE}) GROUP BY 1, 2, 3, ord")
    asked = t.orders.select(F.col("o_orderkey").alias("line_key"), (F.col("o_orderkey") % 3 + 1).alias("candidates"))
    out = confidence.complete_assessments(answers, asked)
    return out.select("line_key", "answer_no", F.col("candidate").cast("long").alias("candidate"), "ord", "answer")


def resolved_columns(t: Inputs) -> DataFrame:
    """The part table read by headings as people retype them."""
    return catalog.resolve_columns(
        t.part, {"brand": "P Brand", "kind": "p.TYPE", "size": "P-SIZE", "missing": "Stock", "unset": ""}
    ).groupBy("brand", "kind", "size", "missing", "unset").agg(F.count(F.lit(1)).alias("n"))


def kept_items(t: Inputs) -> DataFrame:
    blanked = t.catalog_rows.withColumn(
        "code", F.when(F.col("position") % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "code"))
    )
    items = catalog.catalog_items(blanked)
    return items.select(
        "position", "code", "description", F.size("fields").cast("long").alias("fields"),
        F.col("fields")["code"].alias("code_as_written"),
    )


def postings(t: Inputs) -> DataFrame:
    out = catalog.build_postings(t.catalog_rows)
    return out.select("position", "word", "tf", F.col("row_length").cast("long").alias("row_length"))


def word_statistics(t: Inputs) -> DataFrame:
    return index_of(t).words.select("word", "df", F.round("idf", 6).alias("idf"))


def best_rows(t: Inputs) -> DataFrame:
    return search.rank_rows(texts(t), index_of(t), 10).select(
        "query", F.col("rank").cast("long").alias("rank"), "position", "score"
    )


def many_texts(t: Inputs) -> DataFrame:
    """The five best products of every distinct wording with a size and a unit: some ten thousand texts."""
    return search.search(t.sql(MANY_TEXTS), index_of(t), K).select(
        "query", F.col("rank").cast("long").alias("rank"), "position", "code", "score"
    )


def best_products(t: Inputs) -> DataFrame:
    return search.search(texts(t), index_of(t), 20).select(
        "query", F.col("rank").cast("long").alias("rank"), "position", "code", "score"
    )


def repaired(t: Inputs) -> DataFrame:
    known = index_of(t).words.select("word")
    said = texts(t).distinct().select(F.explode(tokens(F.col("query"))).alias("word"))
    # Every known word too, with its third sign left out, doubled, or made an x.
    third = F.col("word").substr(3, 1)
    wrong = known.select(F.explode(F.array(*[
        F.concat(F.left("word", F.lit(2)), middle, F.col("word").substr(F.lit(4), F.length("word")))
        for middle in (F.lit(""), F.concat(third, third), F.lit("x"))
    ])).alias("word"))
    asked = said.unionByName(wrong).distinct()
    return search.repair_words(asked.join(known, "word", "left_anti"), known)


def shortlists(t: Inputs) -> DataFrame:
    """Shortlists per distinct (wording, code): equal lines get equal shortlists."""
    lines = t.rfq_lines.select("description", "customer_code").distinct().withColumn(
        "line_key", F.struct("description", "customer_code")
    )
    out = search.shortlist(lines, codes_of(t), index_of(t), K)
    return out.select(
        F.col("line_key.description").alias("description"), F.col("line_key.customer_code").alias("customer_code"),
        F.col("rank").cast("long").alias("rank"), "candidate", "score", "by_code", "confirmed", "conflicted",
    )


def differences(t: Inputs) -> DataFrame:
    return branches.candidate_differences(_questions(t)).select(F.col("line_key").alias("line_text"), "differences")


def picker(t: Inputs) -> DataFrame:
    return catalog.product_picker(t.catalog_rows, code="-1", description=" economy", limit=500)


def summary(t: Inputs) -> DataFrame:
    matched, _ = _matched(t)
    return branches.match_summary(matched, "rfq_id")


def token_counts(t: Inputs) -> DataFrame:
    words = tokens(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(words).cast("long").alias("words"),
        F.size(F.array_distinct(words)).cast("long").alias("distinct_words"),
        F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("first_word"),
        F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("last_word"),
    )


COVERAGE = (
    f"CAST(CASE WHEN len({q.word_set('line_text')}) > 0 THEN round_even(100.0::DOUBLE * "
    f"len(list_intersect({q.word_set('line_text')}, {q.word_set('product_text')})) / len({q.word_set('line_text')}), 0) "
    "ELSE 0 END AS BIGINT)"
)
QUESTIONS = f"{SEARCH},\nquestions AS (SELECT query AS line_text, rank, description AS product_text FROM ranked WHERE rank <= {K})"


def _plain(text: str) -> str:
    """Word for word comparison in the check: signs that do not matter become blanks."""
    joined = f"regexp_replace(regexp_replace(lower({text}), '([\\p{{L}}\\p{{N}}_])-([\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g'), '([\\p{{L}}\\p{{N}}_])-([\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_extract_all({joined}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'), lambda x: x NOT IN (',', ';', '(', '/'))"


MATCHED = f"""settled AS (SELECT c.*, coalesce(j.same, false) AS same, j.why AS said FROM coded c LEFT JOIN judged j
    ON j.line_text = c.description AND j.product_text = c.found_description),
offers AS (SELECT query, count(*) AS n FROM ranked WHERE rank <= {K} GROUP BY query),
matched AS (SELECT rfq_id, line_index,
    CASE WHEN found_code IS NOT NULL AND same THEN 'code_confirmed' WHEN n IS NULL THEN 'none'
         WHEN found_code IS NOT NULL THEN 'code_rejected' ELSE 'search' END AS how,
    CASE WHEN found_code IS NOT NULL AND same THEN '{branches.CONFIRMED.replace("'", "''")}' || CASE WHEN said <> '' THEN ' ' || said ELSE '' END
         ELSE (CASE WHEN found_code IS NOT NULL THEN replace('{branches.REJECTED.replace("'", "''")}', '%s', found_code) || CASE WHEN said <> '' THEN ' ' || said ELSE '' END
               WHEN coalesce(customer_code, '') <> '' THEN '{branches.SEARCHED}' ELSE '{branches.NO_CODE}' END)
              || CASE WHEN n IS NULL THEN ' {branches.NOTHING_FOUND}' ELSE '' END END AS why,
    CASE WHEN found_code IS NOT NULL AND same THEN '' ELSE description END AS query,
    CASE WHEN found_code IS NOT NULL AND same THEN found_code END AS item_code,
    CASE WHEN found_code IS NOT NULL AND same THEN found_description END AS item_description,
    CASE WHEN found_code IS NOT NULL AND same THEN 0 ELSE coalesce(n, 0) END AS offered
    FROM settled LEFT JOIN offers ON offers.query = settled.description)"""
MATCHED_ALL = f"{SEARCH},\n{CODES},\n{CODED},\n{PAIRS},\n{JUDGED},\n{MATCHED}"

QUERIES = [
    Query("A2", "resolve_columns", resolved_columns,
          "SELECT p_brand AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS size, '' AS missing, '' AS unset, count(*) AS n FROM part GROUP BY ALL"),
    Query("A3", "catalog_items", kept_items,
          """SELECT position, code, description, CAST(4 AS BIGINT) AS fields, ' ' || code AS code_as_written
FROM catalog_rows WHERE position % 9 <> 0"""),
    Query("F1", "tokenize", token_counts, f"""WITH d AS (SELECT doc_id, {q.tokens('text')} AS w FROM documents)
SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words, coalesce(w[1], '') AS first_word, coalesce(w[-1], '') AS last_word FROM d"""),
    Query("F2", "normalize_code",
          lambda t: t.catalog_rows.select("position", normalize_code(F.col("code")).alias("code_key"), normalize_code(F.col("customer_code")).alias("alias_key")),
          f"SELECT position, {q.code_key('code')} AS code_key, {q.code_key('customer_code')} AS alias_key FROM catalog_rows"),
    Query("F3", "code_index",
          lambda t: catalog.code_index(t.catalog_rows).withColumn("kind", F.col("kind").cast("long")),
          f"WITH {CODES} SELECT code_key, CAST(kind AS BIGINT) AS kind, position, code, description FROM codes"),
    Query("F4", "lookup_code",
          lambda t: catalog.lookup_code(t.rfq_lines, codes_of(t)).select("rfq_id", "line_index", "customer_code", "found_code", "found_position"),
          f"WITH {CODES},\n{CODED} SELECT rfq_id, line_index, customer_code, found_code, found_position FROM coded"),
    Query("F5", "build_postings", postings, f"WITH {INDEX} SELECT position, word, tf, row_length FROM posted JOIN lengths USING (position)"),
    Query("F6", "word_statistics", word_statistics, f"WITH {INDEX} SELECT word, df, round(idf, 6) AS idf FROM freq"),
    Query("F7", "bm25_search", best_rows,
          f"WITH {INDEX},\n{TERMS},\n{SCORED} SELECT query, rank, position, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, position) AS rank FROM scored) WHERE rank <= 10"),
    Query("F7", "search_many_texts", many_texts,
          f"""WITH {INDEX},\n{TERMS.replace("SELECT DISTINCT description AS query FROM rfq_lines", MANY_TEXTS)},\n{SCORED},\n{RANKED} SELECT query, rank, position, code, score FROM ranked WHERE rank <= {K}"""),
    Query("F8", "repair_words", repaired, f"""WITH {INDEX}, said AS (SELECT DISTINCT unnest({q.tokens('description')}) AS word FROM rfq_lines
    UNION SELECT left(word, 2) || unnest(['', substr(word, 3, 1) || substr(word, 3, 1), 'x']) || substr(word, 4) FROM freq),
unknown AS (SELECT word FROM said WHERE word NOT IN (SELECT word FROM freq) AND length(word) >= 5 AND regexp_full_match(word, '\\p{{L}}+'))
SELECT u.word, min(f.word) AS spelling FROM unknown u JOIN freq f ON length(f.word) >= 5 AND regexp_full_match(f.word, '\\p{{L}}+') AND levenshtein(u.word, f.word) = 1 GROUP BY u.word HAVING count(*) = 1"""),
    Query("F9", "best_per_product", best_products, f"{SEARCH} SELECT query, rank, position, code, score FROM ranked WHERE rank <= 20"),
    Query("F7+F9", "line_matches", best_matches,
          f"{SEARCH} SELECT l.rfq_id, l.line_index, r.rank, r.code, r.score FROM rfq_lines l LEFT JOIN ranked r ON r.query = l.description AND r.rank <= {K}"),
    Query("F10", "shortlist", shortlists, f"""{SEARCH},\n{CODES},
asked AS (SELECT DISTINCT description, customer_code FROM rfq_lines),
keyed AS (SELECT a.*, c.code AS found_code FROM asked a LEFT JOIN codes c ON c.code_key = {q.code_key('a.customer_code')}),
top AS (SELECT query, rank, code AS candidate, score FROM ranked WHERE rank <= {K}),
own AS (SELECT k.description, k.customer_code, min_by(score, rank) AS own_score FROM keyed k JOIN top ON top.query = k.description AND top.candidate = k.found_code GROUP BY ALL),
led AS (SELECT k.*, own_score FROM keyed k LEFT JOIN own ON own.description = k.description AND own.customer_code IS NOT DISTINCT FROM k.customer_code),
listed AS (SELECT description, customer_code, found_code, own_score, 0 AS place, found_code AS candidate, coalesce(own_score, 0.0) AS score FROM led WHERE found_code IS NOT NULL
  UNION ALL SELECT l.description, l.customer_code, l.found_code, l.own_score, top.rank, top.candidate, top.score FROM led l JOIN top ON top.query = l.description WHERE l.found_code IS NULL OR top.candidate <> l.found_code)
SELECT description, customer_code, rank, candidate, score, found_code AS by_code,
  CASE WHEN found_code IS NOT NULL THEN own_score IS NOT NULL END AS confirmed, found_code IS NOT NULL AND own_score IS NULL AS conflicted
FROM (SELECT *, row_number() OVER (PARTITION BY description, customer_code ORDER BY place) AS rank FROM listed) WHERE rank <= {K}"""),
    Query("F11", "distinct_pairs", lambda t: _pairs(t),
          f"WITH {CODES},\n{CODED},\n{PAIRS} SELECT line_text, product_text, pair_no, batch, index FROM numbered"),
    Query("F12", "join_judgements", judged_pairs,
          f"WITH {CODES},\n{CODED},\n{PAIRS},\n{JUDGED} SELECT pair_no, line_text, product_text, same, why FROM judged"),
    Query("F13", "matched_lines", matched_lines,
          f"{MATCHED_ALL} SELECT rfq_id, line_index, how, why, query, item_code, item_description, offered FROM matched"),
    Query("F14", "word_coverage", scored_candidates, f"{QUESTIONS} SELECT line_text, rank, product_text, {COVERAGE} AS confidence FROM questions"),
    Query("F15", "same_words", same_words_check,
          f"""SELECT position, true AS signs_ignored,
  {_plain('customer_description')} = {_plain('description')} AS customer_same, true AS dash_joined, false AS nothing_said FROM catalog_rows"""),
    Query("F16", "settled_word_for_word", word_for_word,
          f"""WITH own AS (SELECT position AS line_key, replace(upper(description), ',', ' ; ') || CASE WHEN position % 3 = 0 THEN ' extra' ELSE '' END AS line_text, description FROM catalog_rows),
asked AS (SELECT line_key, line_text, description AS product_text, 1 AS rank FROM own
  UNION ALL SELECT o.line_key, o.line_text, b.description, 2 FROM own o JOIN own b ON b.line_key + 1 = o.line_key),
flags AS (SELECT *, {_plain('line_text')} = {_plain('product_text')} AS equal FROM asked),
lines AS (SELECT *, max(equal) OVER (PARTITION BY line_key) AS settled FROM flags)
SELECT line_key, CAST(rank AS BIGINT) AS rank, NOT settled AS asked, CASE WHEN settled AND equal THEN CAST(100 AS BIGINT) END AS confidence,
  CASE WHEN settled AND equal THEN '{branches.WORD_FOR_WORD.replace("'", "''")}' WHEN settled THEN '{branches.NOT_ASSESSED}' ELSE '' END AS score_why FROM lines"""),
    Query("F17", "agreement", agreements,
          f"""SELECT line_key, CASE WHEN trim(line_value) <> '' AND trim(item_value) <> '' THEN CASE WHEN agrees THEN 'match' ELSE 'conflict' END
  WHEN trim(item_value) <> '' THEN 'unstated' WHEN trim(line_value) <> '' THEN 'unconfirmed' ELSE 'dropped' END AS agreement, count(*) AS properties
FROM ({CHECK_SOURCE}) GROUP BY ALL"""),
    Query("F18", "complete_assessments", assessments,
          f"""WITH given AS (SELECT line_key, answer_no, candidate, ord, min(answer) AS answer FROM ({ANSWER_SOURCE}) GROUP BY ALL),
firsts AS (SELECT g.*, o.o_orderkey % 3 + 1 AS candidates FROM given g JOIN orders o ON o.o_orderkey = g.line_key
  WHERE candidate BETWEEN 1 AND o.o_orderkey % 3 + 1 QUALIFY row_number() OVER (PARTITION BY line_key, answer_no, candidate ORDER BY ord) = 1),
whole AS (SELECT line_key, min(answer_no) AS answer_no FROM (SELECT line_key, answer_no FROM firsts GROUP BY line_key, answer_no, candidates HAVING count(*) = candidates) GROUP BY line_key)
SELECT line_key, answer_no, CAST(candidate AS BIGINT) AS candidate, ord, answer FROM firsts JOIN whole USING (line_key, answer_no)"""),
    Query("F19", "confidence", confidence_scores,
          f"""WITH noted AS (SELECT *, regexp_replace(lower(name), '\\s+', '', 'g') AS property, regexp_replace(lower(trim(item_value)), '\\s+', '', 'g') AS offered,
  CASE WHEN name IS NULL THEN NULL WHEN trim(line_value) <> '' AND trim(item_value) <> '' THEN CASE WHEN agrees THEN 'match' ELSE 'conflict' END
  WHEN trim(item_value) <> '' THEN 'unstated' WHEN trim(line_value) <> '' THEN 'unconfirmed' END AS agreement FROM ({CHECK_SOURCE})),
able AS (SELECT *, bool_and(same_product) OVER w AND NOT coalesce(bool_or(agreement = 'conflict') OVER w, false) AS viable FROM noted WINDOW w AS (PARTITION BY line_key, candidate)),
variants AS (SELECT line_key, property, count(DISTINCT offered) AS variants FROM able WHERE viable AND agreement = 'unstated' GROUP BY ALL),
sums AS (SELECT line_key, candidate, any_value(viable) AS viable, sum(CASE WHEN agreement IS NOT NULL THEN w END) AS total,
  sum(CASE WHEN agreement IS NOT NULL THEN w * CASE agreement WHEN 'match' THEN 1.0::DOUBLE WHEN 'unstated' THEN 1.0::DOUBLE / greatest(1, coalesce(variants, 1)) WHEN 'unconfirmed' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END) AS earned
  FROM (SELECT able.*, variants, CASE WHEN is_key THEN 3 ELSE 1 END AS w FROM able LEFT JOIN variants USING (line_key, property)) GROUP BY ALL)
SELECT line_key, candidate, viable, CAST(CASE WHEN NOT viable THEN 0 WHEN total IS NULL THEN 100 ELSE floor(round(50 + 50 * earned / total, 9) + 0.5) END AS BIGINT) AS confidence FROM sums"""),
    Query("F20", "rerank", reranked,
          f"{QUESTIONS},\nscores AS (SELECT *, {COVERAGE} AS confidence FROM questions) SELECT line_text, rank, row_number() OVER (PARTITION BY line_text ORDER BY confidence DESC NULLS LAST, rank) AS new_rank FROM scores"),
    Query("F21", "match_summary", summary,
          f"""{MATCHED_ALL} SELECT rfq_id, count(*) AS lines, count(*) FILTER (how = 'code_confirmed') AS confirmed, count(*) FILTER (how = 'search') AS searched,
count(*) FILTER (how = 'code_rejected') AS overruled, count(*) FILTER (how = 'none') AS unmatched FROM matched GROUP BY rfq_id"""),
    Query("F22", "product_picker", picker,
          f"""WITH hits AS (SELECT position, code, description FROM catalog_rows WHERE upper(code) LIKE '%-1%' AND upper(description) LIKE '%ECONOMY%'
  QUALIFY row_number() OVER (PARTITION BY {q.code_key('code')} ORDER BY position) = 1)
SELECT position, code, description, count(*) OVER () AS total FROM hits ORDER BY position LIMIT 500"""),
    Query("F24", "candidate_differences", differences,
          f"""{QUESTIONS},
w AS (SELECT line_text, rank, unnest({q.tokens('product_text')}) AS word, generate_subscripts({q.tokens('product_text')}, 1) AS nth FROM questions),
seen AS (SELECT line_text, word, count(DISTINCT rank) AS carriers, min(rank * 1000000 + nth) AS first_seen FROM w GROUP BY ALL),
offered AS (SELECT line_text, count(*) AS n FROM questions GROUP BY ALL HAVING count(*) > 1)
SELECT line_text, string_agg(word, ', ' ORDER BY first_seen) AS differences FROM seen JOIN offered USING (line_text) WHERE carriers < n GROUP BY line_text"""),
]
