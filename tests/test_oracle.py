"""Queries against their SQL, none of them empty.  A sample by default; every query with TIDEMARK_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from tidemark.plans.registry import load_all
from tools.compare import compare, connect

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.001")
SAMPLE = (
    "canonical_bars", "session_features", "exact_session_labels", "price_history_gaps", "fetch_plan", "setup_match", "ttm_rows", "beat_streak", "recent_report", "event_asof",
    "change_versions", "member_asof", "trailing_news", "macro_change", "corroborated_fill", "guidance_ranges", "company_facts", "page_text", "page_links", "reported_debt", "run_timeliness", "archive_verification",
)
NAMES = sorted(n for n, q in load_all().items() if q.sql) if os.environ.get("TIDEMARK_ALL") else SAMPLE

#: The smallest tables have too few peers and too short histories for these to select anything; sf0.01 has enough.
EMPTY = {"published_forecasts", "corroborated_fill", "setup_match", "setup_score_v2", "top_k_ladder", "two_rankings", "sector_capped_top", "current_candidates"} if SF.endswith("sf0.001") else set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    problems = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert [p for p in problems if p != "no rows" or name not in EMPTY] == []


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_reads_tables():
    assert set(entry.oracle_sql()) <= set(entry.queries())
