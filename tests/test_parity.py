"""Registered queries against their check SQL. All of them: QUOTEFLOW_ALL=1, or python tests/check.py <folder>."""

import os

import pytest

import __spark_entry__ as entry
from compare import check_engine, differences
from quoteflow.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "resolve_columns", "code_index", "tokenize", "confidence", "agreement", "split_headers", "split_thread", "strip_boilerplate",
    "extract_signals", "html_to_text", "attachment_kinds", "resolve_region", "finalize_policy", "attachment_budget", "image_budget",
    "header_rows", "find_blocks", "merge_sources", "quantity_conflicts", "remarks", "number_or_text", "line_totals", "approve_pricing",
    "replace_parts", "number_rfqs", "per_class", "p95_latency", "accept_notifications", "fold_journal_stream",
]
NAMES = [one.name for one in all_queries() if one.sql and (os.environ.get("QUOTEFLOW_ALL") or one.name in QUICK)]


@pytest.fixture(scope="module")
def engine():
    return check_engine(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, engine, name):
    assert differences(entry.queries()[name](spark, FOLDER), engine, entry.oracle_sql()[name]) == ""


def test_entry_has_rows(spark):
    assert len(entry.entry(spark).take(5)) == 5


def test_every_query_without_sql_says_why():
    assert all(one.sql or one.why_no_sql for one in all_queries())
