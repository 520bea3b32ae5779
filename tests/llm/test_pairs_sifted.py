"""Pairs of the Jaccard join are sifted by odd buckets before their sets are moved, and no link is lost by it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteflow.llm import overlap


def texts(alike: float, pairs: int = 30) -> list[tuple[int, str]]:
    """Pairs of texts of 200 words that have this share of them in common, from the front."""
    chance = random.Random(5)
    rows = []
    for number in range(pairs):
        words = [f"w{chance.random()}" for _ in range(200)]
        other = words[: int(200 * alike)] + [f"v{chance.random()}" for _ in range(200 - int(200 * alike))]
        rows += [(2 * number, " ".join(words)), (2 * number + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize("alike, linked", [(0.8, 0), (0.98, 30)])
def test_sets_of_unlike_texts_are_not_moved(spark, monkeypatch, alike, linked):
    moved = []
    search = overlap.search_blocks

    def counted(pairs, sets, percent):
        moved.append(pairs.count())
        return search(pairs, sets, percent)

    monkeypatch.setattr(overlap, "search_blocks", counted)
    docs = spark.createDataFrame(texts(alike), "doc_id long, text string")
    found = overlap.jaccard_components(docs)
    assert found.where("component_id <> doc_id").count() == linked
    assert sum(moved) == linked


def test_the_sift_lets_no_link_go(spark):
    chance = np.random.default_rng(3)
    rows = []
    for number in range(300):
        size = int(chance.integers(1, 400))
        one = overlap.mixed(chance.integers(0, 1 << 60, size).astype(np.uint64))
        gone = int(chance.integers(0, max(1, size // 6) + 1))
        new = overlap.mixed(chance.integers(0, 1 << 60, int(chance.integers(0, max(1, size // 6) + 1))).astype(np.uint64))
        other = np.concatenate([one[gone:], new])
        if not len(other):
            continue
        shared = len(np.intersect1d(one, other))
        links = 100 * shared >= 80 * (len(one) + len(other) - shared)
        rows.append((len(one), overlap.odd_buckets(one).tolist(), len(other), overlap.odd_buckets(other).tolist(), links))
    table = spark.createDataFrame(rows, "n long, odd array<long>, m long, other array<long>, links boolean")
    told = table.withColumn("may", overlap.may_link(F.col("n"), F.col("odd"), F.col("m"), F.col("other"), 80))
    assert table.where("links").count() > 30 and told.where("links and not may").count() == 0
    assert told.where("not may").count() > 10
