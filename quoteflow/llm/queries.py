"""The registered queries of the operators, each over its whole table, and their check SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm import (
    bpe, centroids, decontamination, fim, html, lines, lm, overlap, pii, quality, secrets, sharding, substrings,
)
from quoteflow.llm.common import plain_text, table
from quoteflow.sources.store import stored


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability, by word counts and by the attention model."""
    return lm.score_texts(table(spark, folder, "documents"), bpe.default_vocabulary())


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again, as digests of both."""
    path = bpe.default_vocabulary()
    docs = table(spark, folder, "documents").select("doc_id", plain_text().alias("text"))
    encoded = bpe.encode(docs, path).select("doc_id", "ids")
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    return sharding.shard(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document, of fixed shape and by the model."""
    found = pii.find_personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda one: one["base"])

    def of_kind(kind):
        return F.size(F.filter(base, lambda one: one["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(of_kind, pii.KINDS), F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, the fixed rule and the verdict of the weighed rules for every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counts = stored(quality.text_counts(docs).select("doc_id", "counts"), "counts")
    return quality.judge(counts).select(
        "doc_id",
        *[f"counts.{name}" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", "probability",
    )


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, of fixed shape and by the models."""
    found = secrets.find_secrets(table(spark, folder, "documents"))

    def of_kind(kind):
        return F.size(F.filter("spans", lambda one: one["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda one: one["kind"] != "random")
    return found.select(
        "doc_id", of_kind("assign"), of_kind("access"), of_kind("hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
    )


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the size of its shingle set and the lowest document its links reach."""
    return overlap.jaccard_components(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document when one occurrence of each group of near equal lines stays."""
    left = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), every_line=True)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(plain_text(), 256).alias("text_sha256"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with the passage."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the passages of 13 words that a lower document has."""
    left = substrings.dedup_substrings(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its prefix, middle and suffix put in order for filling in, and restored."""
    made = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its cluster after three rounds, and a digest of the cluster's centroid."""
    found = centroids.cluster(table(spark, folder, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"),
    )


def queries() -> dict:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_bpe": op2_bpe,
        "op3_sharding": op3_sharding,
        "op4_personal_data": op4_personal_data,
        "op5_html_extraction": op5_html_extraction,
        "op6_quality_rules": op6_quality_rules,
        "op7_secret_scan": op7_secret_scan,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_line_dedup": op9_line_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_centroid_clustering": op13_centroid_clustering,
    }


# Sets, links and what they reach, pair by pair: for small tables.
JACCARD_SQL = """WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT doc_id AS node, doc_id AS root FROM documents UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON r.node = b.a),
lowest AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON node = d.doc_id"""


# Every window of every document, word by word: for small tables.
SUBSTRING_SQL = """WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
lows AS (SELECT s, min(doc_id) AS low FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN lows USING (s) WHERE low < doc_id),
each_word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM words),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS kept FROM each_word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN left_over USING (doc_id)"""

MIDDLE_SQL = """WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM texts),
cut AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts"""


def _lloyd_sql(rounds: int = 3) -> str:
    """Rounds one after the other, vectors and centroids as one row per component."""
    steps = ["""vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM vectors),
chosen AS (SELECT v, CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS cluster FROM vectors
  QUALIFY cluster < 16),
centre0 AS (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS y FROM chosen)"""]
    for step in range(rounds + 1):
        steps.append(f"""far{step} AS (SELECT vec_id, cluster, sum((x - y) * (x - y)) AS d FROM parts JOIN centre{step} USING (i) GROUP BY ALL),
near{step} AS (SELECT vec_id, min({{'d': d, 'c': cluster}}) AS best FROM far{step} GROUP BY vec_id)""")
        if step < rounds:
            steps.append(f"""mean{step} AS (SELECT best.c AS cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y FROM parts JOIN near{step} USING (vec_id) GROUP BY ALL),
centre{step + 1} AS (SELECT cluster, i, coalesce(m.y, c.y) AS y FROM centre{step} c LEFT JOIN mean{step} m USING (cluster, i))""")
    return f"""WITH {', '.join(steps)},
shown AS (SELECT cluster, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM centre{rounds} GROUP BY cluster),
last AS (SELECT vec_id, best.c AS cluster, CAST(best.d AS BIGINT) AS distance FROM near{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM last JOIN shown USING (cluster)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_jaccard_join": JACCARD_SQL,
        "op11_substring_dedup": SUBSTRING_SQL,
        "op12_fill_in_middle": MIDDLE_SQL,
        "op13_centroid_clustering": _lloyd_sql(),
    }
