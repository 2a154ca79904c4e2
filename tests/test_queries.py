"""Registered queries against their SQL twins on the smallest tables (RUN_ALL=1 for every query)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import canonical, duck  # noqa: E402

from skilloom.plans import all_oracles as oracle_sql, all_queries as queries  # noqa: E402

SF = "/root/testdata/sf0.001"
DEFAULT = ["top_applicants_per_job", "resume_skills", "job_requirements", "quality_deductions", "pii_redacted_documents", "clean_text",
           "readability_check", "verify_snippets", "term_matches_in_documents", "claim_violations", "range_request_count", "rate_limit_decisions", "attempt_states",
           "catalog_upsert", "docx_text", "stored_record_audit", "stale_attempts", "ground_strategy", "freshness_states", "comparison_freshness",
           "profile_freshness", "refreshed_scores", "persisted_analyses", "summary_coercion", "retention_job_delete",
           "profile_record_violations", "comparison_record_violations", "recommendation_record_violations", "accepted_profiles", "ground_profile_items",
           "ground_profile_summary", "file_admission", "content_fingerprints", "history_page_starts", "deep_history_page"]
NAMES = list(oracle_sql()) if os.environ.get("RUN_ALL") else DEFAULT


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    df = queries()[name](spark, SF)
    res = duck(SF).execute(oracle_sql()[name])
    cols, rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows, cols)
