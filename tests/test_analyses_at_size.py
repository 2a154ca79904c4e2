"""What the queries on analyses leave out of their work, and that their results stay the same."""

import pytest
from pyspark.sql import functions as F

from skilloom.operators import maintenance as mt, recommend, reports, scoring, skills
from skilloom.plans import all_queries
from skilloom.sources import feeds

SF = "/root/testdata/sf0.001"
LONG = "calm words about teams and care " * 60


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    r = spark.createDataFrame([(1, 9, "a.docx", "COMPLETED", "Skills: Python\nNotes:\nUses Docker daily in teams"), (2, 9, "b", "FAILED", None),
                               (3, 8, "c", "COMPLETED", "short"), (4, 8, "d", "COMPLETED", f"{LONG}\nSkills: Java, Docker\nOther:\n{LONG} node js {LONG}")],
                              "resume_id int, user_id int, file_name string, extraction_status string, extracted_text string")
    same = "Requirements: Python, Java\nPreferred: Docker, Python"
    j = spark.createDataFrame([(7, "Dev", same), (8, "Dev too", same), (9, "Other", "Requirements: Rust"), (10, "Empty", None)],
                              "job_id int, title string, description string")
    a = spark.createDataFrame([(i, k) for i in (1, 2, 3, 4) for k in (7, 8, 10)] + [(2, 9)], "resume_id int, job_id int").withColumn("applied_at", F.lit("2024-01-01"))
    return a, r, j


def test_long_lines_are_scanned_where_a_first_word_occurs(spark):
    texts = [LONG + end + LONG for end in ("x(Node JS) ", "uses\tspring boot, ", "no node", "c plus plus\n", "T-SQL", "next;", "　Redis ", " rest apis ")]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pattern, _ = skills.candidate_pattern()
    for r in d.select(F.expr(skills._line_hits_sql("t", pattern, skills.SKILLS)).alias("got"), F.expr(skills._hits_sql("t", pattern)).alias("want")).collect():
        assert r.got == r.want


def test_tiers_are_those_of_the_skills(spark, tables):
    d = skills.with_skill_tiers(skills.with_skills(tables[1].unionByName(feeds.resumes(spark, SF)), "extracted_text"), "extracted_text")
    rows = d.select("skills", "section_pos", "body_pos").collect()
    for r in rows:
        assert sorted(r.section_pos) == sorted(s.skill_pos for s in r.skills if s.in_skills_section)
        assert sorted(r.body_pos) == sorted(s.skill_pos for s in r.skills if not s.in_skills_section)
    assert any(r.section_pos and r.body_pos for r in rows)


def test_equal_postings_are_extracted_once(tables):
    d = scoring.job_features(tables[2], keep=("title",))
    assert "Aggregate [description" in _plan(d)
    got = {r.job_id: (r.title, r.required_pos, r.preferred_pos, r.req_w0) for r in d.collect()}
    assert len(got) == 4 and got[7][1:] == got[8][1:] and len(got[7][1]) == 2 and got[8][0] == "Dev too" and got[10][1] == []


def test_a_filter_on_counts_does_not_repeat_the_extraction(tables):
    plan = _plan(scoring.analyse(*tables).filter("total_job_skills > 0").select("analysis_id"))
    assert all("regexp" not in line.lower() for line in plan.split("\n") if "Filter" in line and "total_job" in line or "bit_count" in line)


def test_items_by_words_are_items_by_skills(tables):
    held = scoring.analyse(*tables, items=("skill_name", "category", "requirement_type", "status")).select("analysis_id", F.inline("items"))
    whole = scoring.analyse(*tables, items=True).select("analysis_id", F.inline("items")).select(held.columns)
    assert sorted(held.collect()) == sorted(whole.collect()) and held.count() == 12
    assert sorted(recommend.skill_gap(held, "analysis_id").collect()) == sorted(
        recommend.skill_gap(scoring.explode_items(scoring.analyse(*tables, items=True), "analysis_id").drop("requirement_type"), "analysis_id").collect())


def test_pairs_are_filed_without_a_search_for_skills(tables):
    pairs, full = scoring.eligible_pairs(*tables), scoring.analyse(*tables)
    assert "regexp_extract_all" not in _plan(pairs)
    assert sorted(pairs.collect()) == sorted(full.select(pairs.columns).collect()) and pairs.count() == 6
    some = pairs.filter("job_id = 8")
    assert sorted(scoring.analyse_chosen(some, *tables[1:]).collect()) == sorted(full.filter("job_id = 8").collect())


def test_dashboard_scores_the_newest_only(tables):
    _, r, j = tables
    scored = reports.dashboard(r, j.withColumn("user_id", F.lit(9)), scoring.analyse(*tables))
    late = reports.dashboard(r, j.withColumn("user_id", F.lit(9)), scoring.eligible_pairs(*tables), score=lambda d: scoring.analyse_chosen(d, r, j))
    assert sorted(late.collect()) == sorted(scored.collect())


@pytest.mark.parametrize("name", ["history_page_starts", "catalog_delete_blockers"])
def test_no_resume_is_searched_for_skills(spark, name):
    plan = _plan(all_queries()[name](spark, SF))
    assert not [line for line in plan.split("\n") if "extracted_text" in line and "regexp_extract_all" in line]


def test_skills_in_use_are_those_of_the_items(tables):
    got = scoring.skills_in_use(*tables)
    want = scoring.explode_items(scoring.analyse(*tables, items=True)).select("skill_name").distinct()
    assert {r[0] for r in got.collect()} == {r[0] for r in want.collect()} == {"Python", "Java", "Docker"}


def test_deletion_by_rule_needs_no_join(spark, tables):
    a = scoring.analyse(*tables).select("analysis_id", "overall_score", F.col("total_job_skills").alias("items"))
    assert sorted(mt.delete_where(a, F.col("overall_score") < 20).collect()) == sorted(a.filter("overall_score >= 20").collect())
    assert "Join LeftAnti" not in _plan(all_queries()["retention_analysis_delete"](spark, SF))
