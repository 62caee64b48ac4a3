"""Registered queries against their SQL twins. PAPERLOOM_QUICK=1 runs a sample of them."""

import os

import harness
import pytest
from conftest import DATA

import __spark_entry__ as E
from paperloom.plans import QUERIES

SAMPLE = (
    "doc_insights marked_sentiment doc_glossary text_layer_classes sensitive_by_kind injection_passages injection_overview url_reasons "
    "masked_pages redacted_documents risk_rollup finding_locations reused_content restored_versions size_changes membership_outcomes "
    "signing_turns state_steps submission_checks field_checks page_ranking question_context page_chunks sentence_chunks merged_documents "
    "bates_numbers inserted_pages outline_parents upload_checks file_formats exported_tables metered_windows live_scan"
).split()
# The training-data queries have tests of their own.
NAMES = SAMPLE if os.environ.get("PAPERLOOM_QUICK") else sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return harness.connect(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = E.queries()[name](spark, DATA)
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    problem = harness.compare(df, con, sql)
    assert problem is None or (problem == "no rows on either side" and name == "own_assets"), problem


def test_harness_sees_differences(spark, con):
    df = E.queries()["version_totals"](spark, DATA)
    wrong = E.oracle_sql()["version_totals"].replace("count(*) AS latest", "count(*) + 1 AS latest")
    assert "rows" in harness.compare(df, con, wrong)


def test_names_match():
    assert set(E.oracle_sql()) <= set(E.queries())
