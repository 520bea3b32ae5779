"""Sharding, scoring, near copies, line dedup and the pipeline against plain versions."""

import math
import random
import zlib
from collections import Counter

import helpers
import numpy as np
import pytest
from helpers import PROSE, documents

from quoteflow.llm import bpe, lines, lm, overlap, sharding

FOLDER = "/root/testdata/sf0.001"


def corpus(seed=1):
    """Texts with copies, near copies of several degrees, shared lines, and odd ones."""
    rng = random.Random(seed)

    def text(n):
        return " ".join(rng.choice(PROSE) + rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))

    rows = []
    common = text(14)
    for base in range(14):
        words = text(rng.choice([5, 30, 90, 200])).split()
        for copy in range(rng.choice([1, 2, 6])):
            changed = [rng.choice(PROSE) if rng.random() < 0.012 * copy else word for word in words]
            cut = len(changed) // 2
            rows.append((len(rows) * 7 % 501, " ".join(changed[:cut]) + "\n" + common + "\n" + " ".join(changed[cut:])))
    rows += [(1_000, None), (1_001, ""), (1_002, " \n "), (1_003, "two words"), (1_004, "Two  WORDS"), (1_005, rows[0][1]), (1_006, "one"), (1_007, " ")]
    rows.append((1_008, "\n".join(["a line of some words here"] * 50)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    found = {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in overlap.jaccard_components(documents(spark, rows)).collect()}
    assert found == helpers.jaccard_components(rows)


def test_jaccard_of_repeated_rows_nulls_and_nothing(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, "x y z"), (7, "A b C d"), (8, None)]
    found = sorted((row["doc_id"] or -1, row["n_shingles"], row["component_id"] or -1) for row in overlap.jaccard_components(documents(spark, rows)).collect())
    assert found == sorted([(4, 2, 4), (4, 2, 4), (-1, 2, 4), (-1, 1, -1), (7, 2, 4), (8, 0, 8)])
    assert overlap.jaccard_components(documents(spark, [])).count() == 0


def test_divide_skip_and_parts():
    rng = np.random.default_rng(0)
    for _ in range(150):
        query = np.unique(rng.integers(0, 2**60, int(rng.integers(1, 60))).astype(np.uint64))
        records = []
        for _ in range(int(rng.integers(1, 20))):
            kept = query[rng.random(len(query)) > rng.choice([0, 0.02, 0.05, 0.1, 0.3])]
            records.append(np.unique(np.concatenate([kept, rng.integers(0, 2**60, int(rng.integers(0, 4))).astype(np.uint64)])))
        wanted = [
            i for i, one in enumerate(records)
            if len(one) and 100 * len(np.intersect1d(query, one)) >= 90 * len(np.union1d(query, one))
        ]
        assert sorted(overlap.Index(records).search(query)) == wanted
        here = set(overlap.parts(query).tolist())
        assert all(here & set(overlap.parts(records[i]).tolist()) for i in wanted)


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    found = {row["doc_id"]: row["text"] for row in lines.dedup_lines(documents(spark, rows)).collect()}
    assert found == helpers.deduplicated(rows, lines)


def test_line_dedup_of_repeated_rows_nulls_and_nothing(spark):
    line = " ".join(PROSE[:12])
    rows = [(2, line), (2, line), (None, "other " + line[4:]), (5, line.upper() + "!\nshort one"), (6, None)]
    found = sorted((row["doc_id"] or -1, row["text"], row["n_removed"]) for row in lines.dedup_lines(documents(spark, rows)).collect() if row["text"])
    assert (5, "short one", 1) in found
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_lines_of_unlike_words_are_not_compared(spark, monkeypatch):
    """Lines that meet in a block by a few frequent words: pairs compared stay few, and copies among them are found."""
    rng = random.Random(5)
    often, rare = PROSE[:6], ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6000)]
    rows = [(i, " ".join(rng.sample(often, 4) + rng.sample(rare, 9))) for i in range(500)]
    rows += [(i + 500, text.replace(" ", " odd ", 1)) for i, text in rows[:40]]
    compared = []
    plain = lines.texts_of
    monkeypatch.setattr(lines, "texts_of", lambda docs, wanted, *rest: plain(docs, compared.append(wanted.count()) or wanted, *rest))
    found = lines.line_groups(documents(spark, rows, extra=False)).collect()
    assert {(one["doc_id"], one["first"]["doc_id"]) for one in found} == {(i + 500, i) for i in range(40)}
    assert sum(compared) < 160


def test_hot_line_and_hot_copies(spark):
    """A third of all rows copies of one text: the other rows keep their results."""
    rows = [(i, " ".join(PROSE)) for i in range(300)] + [(1_000 + i, f"{i} " + " ".join(random.Random(i).choices(PROSE, k=20)) + f"\nown{i} line of text{i} number{i} x{i}") for i in range(600)]
    found = {row["doc_id"]: row for row in overlap.jaccard_components(documents(spark, rows)).collect()}
    assert {found[i]["component_id"] for i in range(300)} == {0}
    left = {row["doc_id"]: row["text"] for row in lines.dedup_lines(documents(spark, rows)).collect()}
    assert sum(left[i] != "" for i in range(300)) == 1 and all(left[1_000 + i] for i in range(600))


def test_shards(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(PROSE) * rng.randint(0, 400)) for i in range(700)] + [(900, None), (901, ""), (5, "again"), (5, "again")]
    found = sharding.shard(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    shards = {}
    for row in found:
        shards.setdefault(row["shard"], []).append(row)
    assert set(shards) <= set(range(sharding.SHARDS))
    for members in shards.values():
        assert sorted(row["slot"] for row in members) == list(range(len(members)))
    where = {}
    for row in found:
        where.setdefault((row["text_crc32"], row["size"]), set()).add(row["shard"])
    assert all(len(one) == 1 for one in where.values())
    assert Counter((row["doc_id"], row["size"], row["text_crc32"]) for row in found) == Counter(
        (doc, len((text or "").encode()) + 8, zlib.crc32((text or "").encode())) for doc, text in rows
    )
    groups = Counter()
    for row in found:
        groups[row["text_crc32"], row["size"]] += row["size"]
    sizes = [sum(row["size"] for row in shards.get(i, [])) for i in range(sharding.SHARDS)]
    assert max(sizes) <= max(max(groups.values()), 1.05 * sum(sizes) / sharding.SHARDS)
    assert sharding.shard(documents(spark, [])).count() == 0


def test_differencing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 40)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    rows = [(i, "x" * (i * 37 % 501)) for i in range(600)]
    found = sharding.shard(documents(spark, rows), shards=4).collect()
    sizes = Counter()
    for row in found:
        sizes[row["shard"]] += row["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 520
    for number in range(4):
        slots = sorted(row["slot"] for row in found if row["shard"] == number)
        assert slots == list(range(len(slots)))


def test_scores(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    rows += [(9_000, None), (9_001, ""), (9_002, "zzzzqq unheard " * 30), (9_003, rows[0][1]), (9_003, rows[0][1])]
    found = lm.score_texts(documents(spark, rows), bpe.default_vocabulary()).collect()
    assert len(found) == len(rows)

    def tokens(text):
        return (text or "").encode().lower().split()

    counts, ends = Counter(), 0
    for doc, text in rows:
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            counts.update(tokens(text))
            ends += 1
    total = sum(counts.values()) + ends
    rest = total + len(counts) + 1 + 1
    texts = dict(rows)
    better = 0
    for row in found:
        words = tokens(texts[row["doc_id"]])
        base = sum(math.log10((counts[word] + 1) / rest) for word in words) + math.log10((ends + 1) / rest)
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 7 == 2)
        assert (row["n_tokens"], row["train_tokens"]) == (len(words) + 1, total)
        assert row["n_known"] == sum(counts[word] > 0 for word in words) + 1
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(row["score"]) and row["score"] < 0
        better += row["held_out"] and row["score"] > row["base_score"]
    assert better > 0.7 * sum(row["held_out"] for row in found)
    assert lm.score_texts(documents(spark, []), bpe.default_vocabulary()).count() == 0


def test_model_learns_from_long_texts(spark):
    """What follows what is learned from every training text, however long it is."""
    order = "the mill by a river had stood empty for years".split()
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    rows = [(i, " ".join(order * 1_000)) for i in range(100, 106) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len(rows) > 2 and min(len(text) for _, text in rows) > 40_000
    found = lm.score_texts(documents(spark, rows + [(i, " ".join(order * (i + 1))) for i in held]), bpe.default_vocabulary()).collect()
    told = [row for row in found if row["held_out"]]
    assert len(told) == 5
    for row in told:
        assert row["score"] > 0.9 * row["base_score"]


def test_windows_score_each_position_once():
    """Batched windows give what each position's own window gives, and probabilities add up."""
    rng = np.random.default_rng(4)
    starts = np.arange(60) < 30
    docs = [rng.integers(0, 60, n) for n in (0, 1, 5, 24, 25, 70, 131)]
    model = lm.Model(starts, np.bincount(np.concatenate(docs), minlength=60), docs)
    found, _ = model.score(docs)
    at = 0
    stride = lm.WINDOW - lm.CONTEXT
    for ids in docs:
        x = np.concatenate([[0], model.input[ids]])
        y = np.concatenate([model.classes[ids], [0]])
        for t in range(len(x)):
            low = max(0, t // stride * stride - lm.CONTEXT)
            seen = x[low : t + 1]
            scores = model.key[seen] @ model.query[x[t]] / math.sqrt(lm.HEAD) + model.distance[t - low - np.arange(len(seen))]
            share = np.exp(scores - scores.max())
            logits = share / share.sum() @ model.value[seen] + model.next[x[t]]
            chance = np.exp(logits) / np.exp(logits).sum()
            own = model.within[ids[t]] if t < len(ids) else 0
            assert found[at] == pytest.approx(math.log(chance[y[t]]) + own, abs=1e-3)
            at += 1
    for kind in range(lm.CLASSES):
        members = model.classes == kind
        assert not members.any() or np.exp(model.within[members]).sum() == pytest.approx(1, abs=1e-3)


def test_pipeline(spark):
    import corpus_pipeline
    import duckdb

    from quoteflow.llm.decontamination import ERROR_RATE, nearest, normal

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    rows = [{row["doc_id"]: row for row in one.collect()} for one in kept]
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    assert all(not (labels.get(doc) == 0) for doc in rows[1])
    for doc, text in helpers.deduplicated([(doc, row["text"]) for doc, row in rows[1].items()], lines).items():
        assert (rows[2][doc]["text"] if doc in rows[2] else "") == text
    groups = helpers.jaccard_components([(doc, row["text"]) for doc, row in rows[2].items()])
    assert set(rows[3]) == {doc for doc, (_, root) in groups.items() if root == doc}
    items = [normal(text) for _, text in duckdb.sql(f"SELECT * FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    for doc, row in rows[3].items():
        shown = normal(row["text"])
        hit = any(nearest(item, shown)[0] <= int(len(item) * ERROR_RATE) for item in items)
        assert hit == (doc not in rows[4])
    assert set(rows[5]) == set(rows[4]) and all(row["round_trip"] for row in rows[5].values())
