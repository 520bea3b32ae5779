"""Cases of a review: each would have failed before its finding was settled."""

import random

import duckdb
import pytest
from helpers import PROSE, documents, shingles

import corpus_pipeline
from quoteflow.llm import html, lines, secrets

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return ["".join(rng.choices(LETTERS, k=rng.randint(4, 9))) for _ in range(n)]


def test_labelled_secrets_count_once(spark, monkeypatch):
    rng = random.Random(1)
    keys = ["".join(rng.choices(LETTERS + "0123456789", k=32)) for _ in range(8)]
    rows = [(i, f"the secret: {key}") for i, key in enumerate(keys)] + [(100 + i, f"the secret: {keys[i % 8]} again") for i in range(320)]
    monkeypatch.setattr(secrets, "SAMPLE_SECRETS", 8)
    found = [row["value"] for row in secrets.samples(documents(spark, rows), "doc_id", "text")[0].collect()]
    assert sorted(found) == sorted(keys)


def test_near_lines_are_met(spark):
    """Recall against every pair of lines by duckdb, without blocks: of words changed, one in five or fewer."""
    rng = random.Random(2)
    rows = []
    for size, changes in ((6, 1), (10, 2), (20, 2), (20, 4), (40, 1), (40, 8)):
        for _ in range(60):
            line = words(rng, size)
            other = list(line)
            for at in rng.sample(range(size), changes):
                other[at] = "".join(rng.choices(LETTERS, k=len(line[at])))
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    near = duckdb.execute(
        "WITH l AS (SELECT unnest($1) AS id, unnest($2) AS t) SELECT b.id FROM l a JOIN l b ON a.id < b.id"
        " AND abs(length(a.t) - length(b.t)) <= 0.2 * greatest(length(a.t), length(b.t))"
        " AND levenshtein(a.t, b.t) <= floor(0.2 * greatest(length(a.t), length(b.t)) + 1e-9)",
        [[doc for doc, _ in rows], [text for _, text in rows]],
    ).fetchall()
    wanted = {doc for doc, in near}
    gone = {row["doc_id"] for row in lines.dedup_lines(documents(spark, rows)).where("n_removed > 0").collect()}
    assert len(wanted) > 200 and gone <= wanted
    assert len(gone) >= 0.96 * len(wanted)


def test_line_of_a_null_id_and_of_repeated_ids(spark):
    copy, near = " ".join(PROSE[:12]), " ".join(PROSE[:11]) + " thinking"
    rows = [(None, copy), (3, copy), (4, copy), (5, near), (6, " ".join(PROSE[9:20])), (6, copy)]
    left = sorted((row["doc_id"] or 0, row["text"]) for row in lines.dedup_lines(documents(spark, rows)).collect())
    assert left == [(0, copy), (3, ""), (4, ""), (5, ""), (6, ""), (6, " ".join(PROSE[9:20]))]


@pytest.fixture(scope="module")
def no_items(tmp_path_factory):
    folder = tmp_path_factory.mktemp("items")
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS item_id, '{' '.join(PROSE[:18])}' AS text) TO '{folder}/benchmark.parquet'")
    return str(folder)


def test_stages_decide_by_row(spark, no_items):
    rng = random.Random(3)
    one, two, three = (" ".join(words(rng, 30)) for _ in range(3))
    rows = [(1, one), (7, two), (7, three), (7, one), (None, one), (None, two + " more"), (7, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.ngram_jaccard_join(spark, docs, no_items).collect()
    assert sorted(row["text"] for row in left) == sorted([one, two + " more", three])
    assert {(row["doc_id"], row["text"]) for row in left} == {(None, one), (None, two + " more"), (7, three)}
    hidden = f"{three} {' '.join(PROSE[:18])} {two}"
    docs = spark.createDataFrame([(None, hidden), (7, hidden), (7, one), (None, one)], "doc_id long, text string")
    left = corpus_pipeline.benchmark_decontamination(spark, docs, no_items).collect()
    assert {(row["doc_id"], row["text"]) for row in left} == {(7, one), (None, one)}


def test_stage_takes_five_words_and_four_fifths(spark, no_items):
    """Near copies of the stage against brute force over all pairs, with 5 words and 0.8."""
    rng = random.Random(4)
    rows = []
    for changes in (1, 1, 2, 2, 3, 3, 4, 5):
        line = words(rng, 110)
        other = list(line)
        for at in range(changes):
            other[10 + 20 * at] = "changed"
        rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    sets = {doc: shingles(text, 5) for doc, text in rows}
    gone = {b for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {row["doc_id"] for row in corpus_pipeline.ngram_jaccard_join(spark, docs, no_items).collect()}
    assert 0 < len(gone) < len(rows) // 2 and left == set(sets) - gone


def test_short_lines_and_lines_without_blanks(spark):
    signs = "天地玄黄宇宙洪荒日月盈昃辰宿列張寒来暑往秋収冬蔵"
    rows = [(1, f"Read more\n{signs}\nOne"), (2, f"read  MORE!\nTwo\n{signs}"), (3, signs[:9] + "火" + signs[10:] + "\none"), (4, "Three")]
    left = {row["doc_id"]: row["text"] for row in lines.dedup_lines(documents(spark, rows), every_line=True).collect()}
    assert left == {1: rows[0][1], 2: "Two", 3: "", 4: "Three"}


def test_pages_meet_neighbours_however_they_are_cut(spark):
    rows = [(i, f"http://a.org/x/{i:03}", f"<div>All rights kept</div><div>own {i}</div>") for i in range(24)]
    rows += [(100, "http://b.org/", "<div>All rights kept</div>"), (None, "http://c.org/1", "<p>a<p>b"), (101, "http://c.org/2", "<p>a<p>c")]
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        found = {row["page_id"]: row["text"] for row in html.extract(df).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(found) == len(rows) and [found[i] for i in range(24)] == [f"own {i}" for i in range(24)]
    assert (found[100], found[None], found[101]) == ("All rights kept", "b", "c")


def test_copies_of_a_page_keep_their_text(spark):
    def page(own):
        return f"<div>All rights kept</div><div>{own}</div>"

    own = " ".join(PROSE)
    rows = [(1, "http://a.org/x", page(own)), (2, "http://a.org/x?print=1", page(own)), (3, "http://a.org/y", page("other words"))]
    rows += [(4, "http://b.org/x", page(own)), (5, "http://b.org/x", f"<div>{own}</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {row["page_id"]: row["text"] for row in html.extract(df).collect()}
    whole = "All rights kept\n" + own
    assert found == {1: whole, 2: own, 3: "other words", 4: whole, 5: own}


def test_repeated_notice_in_articles_goes_and_versions_stay(spark):
    def page(*own):
        return "<article>" + "".join(f"<p>{one}" for one in ("Subscribe now", *own)) + "</article>"

    first, second, third = " ".join(PROSE[:12]), " ".join(PROSE[8:]), " ".join(PROSE[::-1])
    rows = [(1, "http://a.org/1", page(first)), (2, "http://a.org/2", page(second)), (3, "http://b.org/1", page(first, second))]
    rows.append((4, "http://b.org/2", page(first, third)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {row["page_id"]: row["text"] for row in html.extract(df).collect()}
    assert (found[1], found[2]) == (first, second)
    assert first in found[3] and first in found[4]
