"""Substring dedup, fill-in-middle and centroid clustering against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import documents
from quoteflow.llm import centroids, fim, queries, substrings

WORDS = [f"w{n}" for n in range(40)]


def deduplicated(rows, window):
    """What is left of each text, by looking every window up in every other row."""
    held = [(doc, (text or "").encode().split()) for doc, text in rows]
    lowest: dict[tuple, float] = {}
    for doc, words in held:
        for at in range(len(words) - window + 1):
            name = tuple(words[at : at + window])
            lowest[name] = min(lowest.get(name, float("inf")), float("inf") if doc is None else doc)
    out = []
    for doc, words in held:
        gone = set()
        for at in range(len(words) - window + 1):
            if lowest[tuple(words[at : at + window])] < (float("inf") if doc is None else doc):
                gone.update(range(at, at + window))
        out.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def some_rows():
    draw = random.Random(5)
    passages = [" ".join(draw.choices(WORDS, k=draw.randint(5, 40))) for _ in range(12)]
    rows = []
    for doc in range(120):
        parts = [draw.choice(passages) if draw.random() < 0.5 else " ".join(draw.choices(WORDS, k=draw.randint(1, 30))) for _ in range(draw.randint(1, 6))]
        rows.append((doc, draw.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [(200 + i, rows[i % 3][1]) for i in range(30)]
    long = " ".join(draw.choices(WORDS, k=30000))
    rows += [
        (300, None), (301, ""), (302, "  \n "), (303, "a"), (304, "a " * 500), (305, "a " * 700), (306, long), (307, "x " + long[500:90000] + " y"),
        (3, rows[5][1]), (7, rows[7][1]), (None, rows[9][1]), (None, rows[9][1]), (None, "alone " * 3 + " ".join(WORDS)), (None, " ".join(WORDS)),
        (308, "é ü " + " ".join(WORDS[:20])), (309, " ".join(WORDS[:20]) + " é ü"), (310, passages[0].replace(" ", " ")),
    ]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 300, "anchor_words": 60, "piece_words": 200}])
def test_substrings_as_by_every_window(spark, sizes):
    rows = some_rows()
    found = substrings.dedup_substrings(documents(spark, rows).repartition(5), window=13, **sizes)
    assert found.columns == ["doc_id", "n_words", "n_removed", "text"]
    assert sorted((tuple(row) for row in found.collect()), key=repr) == deduplicated(rows, 13)


def test_substrings_of_other_windows_and_of_nothing(spark):
    rows = some_rows()[:60]
    found = substrings.dedup_substrings(documents(spark, rows), window=3, anchor=2)
    assert sorted((tuple(row) for row in found.collect()), key=repr) == deduplicated(rows, 3)
    assert substrings.dedup_substrings(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        substrings.dedup_substrings(documents(spark, []), window=4, anchor=4)


def test_automaton_matches_across_passages():
    draw = random.Random(2)
    passages = [(doc, [str(draw.randint(0, 3)) for _ in range(draw.randint(1, 30))]) for doc in range(40)]
    automaton = substrings.Automaton()
    for doc, words in passages:
        automaton.add(words, doc)
    for doc in (0, 3, 39, 50):
        asked = [str(draw.randint(0, 4)) for _ in range(60)]
        covered = set()
        for at in range(len(asked) - 3):
            if any(asked[at : at + 4] == words[i : i + 4] for other, words in passages if other < doc for i in range(len(words) - 3)):
                covered.update(range(at, at + 4))
        spans = automaton.shared(asked, doc, 4)
        assert {place for first, end in spans for place in range(first, end)} == covered
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def transformed(doc, text):
    text, key = text or "", "" if doc is None else str(doc)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", text, None, None
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return len(text), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", a, b - a
    return len(text), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", a, b - a


def test_fill_in_middle_by_characters(spark):
    draw = random.Random(3)
    signs = "ab é漢😀\n<PSM>"
    rows = [(doc, "".join(draw.choices(signs, k=draw.choice([0, 1, 5, 3000, 9000])))) for doc in range(150)]
    rows += [(900, None), (901, "x<P>y"), (902, "😀" * 30000), (None, "no id"), (5, "again"), (5, "again")]
    made = fim.fill_in_middle(documents(spark, rows).withColumn("form", F.lit(7)))
    assert made.columns[:2] == ["doc_id", "text"] and made.columns[-5:] == ["n", "form", "output", "prefix_chars", "middle_chars"]
    found = made.select("doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {row["form"] for row in found} == {"plain", "psm", "spm"}
    for row in found:
        assert tuple(row[2:7]) == transformed(row["doc_id"], row["text"])
        assert row[7] == (row["text"] or "")
    assert sorted((row["doc_id"] or -1) for row in found) == sorted((doc or -1) for doc, _ in rows)
    assert fim.fill_in_middle(documents(spark, [])).collect() == []


def test_cuts_after_words():
    text = "  one two\tthree four  five\n" * 400
    words = fim.Cutter(text.encode(), "word", block=64)
    ends = [i + 1 for i, sign in enumerate(text) if not sign.isascii() or not sign.isspace() if i + 1 == len(text) or text[i + 1] in " \t\n"]
    assert words.n == len(ends)
    for units in (0, 1, 2, 77, len(ends)):
        byte, point = words.after(units)
        assert text.encode()[:byte].decode() == text[:point] and point == (ends[units - 1] if units else 0)


def lloyd(rows, dims=64, clusters=16, rounds=3):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == dims and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((key, tuple(int(np.floor(64 * float(np.float32(x)))) for x in vector)))
    order = sorted(kept, key=lambda one: (one[0] is None, hashlib.sha256(f"1:{one[0]}".encode()).hexdigest(), one[1]))
    centres = [list(vector) for _, vector in order[:clusters]]

    def near(vector):
        return min((sum((x - y) ** 2 for x, y in zip(vector, centre)), number) for number, centre in enumerate(centres))

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, vector in kept:
            groups.setdefault(near(vector)[1], []).append(vector)
        for number, held in groups.items():
            centres[number] = [sum(column) // len(held) for column in zip(*held)]
    found = [(key, near(vector)) for key, vector in kept]
    total = sum(distance for _, (distance, _) in found)
    inertia = {n: sum(d for _, (d, m) in found if m == n) for n in range(len(centres))}
    return sorted(((key, n, d, inertia[n], total, centres[n]) for key, (d, n) in found), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_clusters_as_by_whole_vectors(spark, shards):
    draw = np.random.default_rng(4)
    rows = [(n, draw.normal(0, 1, 64).astype(np.float32).tolist()) for n in range(60)]
    rows += [(100 + n, rows[0][1]) for n in range(200)] + [(3, rows[9][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, [9.0] * 64)]
    rows += [(400, None), (401, [1.0] * 63), (402, [1.0] * 63 + [None]), (403, [float("nan")] * 64), (404, [float("inf")] + [0.0] * 63), (405, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "'x' AS key", "2 AS id")
    found = centroids.cluster(df.repartition(4), shards=shards)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sorted((tuple(row) for row in found.collect()), key=repr) == lloyd(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.5] * 64), (2, [0.25] * 64), (2, [0.25] * 64)]
    assert sorted((tuple(row) for row in centroids.cluster(spark.createDataFrame(rows, schema)).collect()), key=repr) == lloyd(rows)
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(Exception, match="do not fit"):
        centroids.cluster(spark.createDataFrame([(1, [3e38] * 64)], schema)).collect()


def test_registered_columns(spark):
    folder = "/root/testdata/sf0.001"
    wanted = {
        "op11_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op12_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
        "op13_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    }
    for name, columns in wanted.items():
        found = queries.queries()[name](spark, folder)
        assert ", ".join(f"{column} {kind}" for column, kind in found.dtypes) == columns
