"""Queries over derived resumes, jobs and applications: extraction, scoring, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skilloom.functions.arrays import explode_structs
from skilloom.functions.taxonomy import SKILLS
from skilloom.operators import requirements, scoring, skills
from skilloom.oracle import base as o
from skilloom.sources import feeds

NAMES = skills.literal_array([s.name for s in SKILLS])


def _analyses(spark: SparkSession, sf: str, items: bool | tuple[str, ...] = False) -> DataFrame:
    return scoring.analyse(feeds.applications(spark, sf), feeds.resumes(spark, sf), feeds.jobs(spark, sf), items=items)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The same analyses without scores."""
    return scoring.eligible_pairs(feeds.applications(spark, sf), feeds.resumes(spark, sf), feeds.jobs(spark, sf))


def _chosen(spark: SparkSession, sf: str, pairs: DataFrame) -> DataFrame:
    """The analyses of a few pairs."""
    return scoring.analyse_chosen(pairs, feeds.resumes(spark, sf), feeds.jobs(spark, sf))


def top_applicants_per_job(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.top_applicants(_analyses(spark, sf), 5).select(
        "job_id", F.col("rank").cast("long").alias("rank"), "resume_id", "overall_score")


def resume_skills(spark: SparkSession, sf: str) -> DataFrame:
    d = skills.with_skills(feeds.resumes(spark, sf), "extracted_text")
    return skills.explode_skills(d, "resume_id").select(
        "resume_id", "skill_name", "category", "token", "match_type", "score", "confidence", "section_type", "evidence")


def job_requirements(spark: SparkSession, sf: str) -> DataFrame:
    d = requirements.with_requirements(feeds.jobs(spark, sf), "description")
    parts = [F.expr(f"transform(requirements.{b}, s -> named_struct('skill_name', s.skill_name, 'category', s.category, "
                    f"'bucket', '{b.upper()}'))") for b in requirements.BUCKETS]
    return explode_structs(d, F.concat(*parts), "job_id")


def match_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _analyses(spark, sf).select("resume_id", "job_id", "overall_score", *scoring.SUMMARY_COLUMNS)


def match_scores_library_variant(spark: SparkSession, sf: str) -> DataFrame:
    ok = scoring.analysable(feeds.resumes(spark, sf))
    pairs = scoring.pair_features(feeds.applications(spark, sf), scoring.resume_features(ok).drop("skills"),
                                  scoring.job_features(feeds.jobs(spark, sf)).drop("required_pos", "preferred_pos"))
    return scoring.with_scores(pairs, preferred_absent=1.0, epsilon=False).select("resume_id", "job_id", "overall_score")


def analysis_items(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.explode_items(_analyses(spark, sf, items=True), "resume_id", "job_id").select(
        "resume_id", "job_id", "skill_name", "category", "requirement_type", "status", "similarity_score", "evidence")


QUERIES = {f.__name__: f for f in (top_applicants_per_job, resume_skills, job_requirements, match_scores,
                                   match_scores_library_variant, analysis_items)}

_SCORE_COLS = """resume_id, job_id, overall_score, total AS total_job_skills, n_req AS required_skills_count,
  n_pref AS preferred_skills_count, m_req AS matched_required_count, m_pref AS matched_preferred_count,
  n_req - m_req AS missing_required_count, n_pref - m_pref AS missing_preferred_count,
  required_coverage, preferred_coverage, average_confidence"""

ORACLES = {
    "top_applicants_per_job": o.with_(*o.match_ctes()) + """
      SELECT job_id, rank, resume_id, overall_score FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall_score DESC, resume_id) AS rank FROM v_scores) WHERE rank <= 5""",
    "resume_skills": o.with_(o.RESUMES, o.TAXONOMY, *o.skills_of("v_resumes", "resume_id", "extracted_text", "r")) + """
      SELECT key AS resume_id, skill_name, category, token, match_type, score,
        CASE WHEN block THEN 1.0::double ELSE 0.8::double END AS confidence, section_type, header || ': ' || token AS evidence
      FROM r_skills JOIN v_taxonomy USING (skill_pos)""",
    "job_requirements": o.with_(o.JOBS, o.TAXONOMY, *o.requirements_of("v_jobs", "job_id", "description", "j")) + """
      SELECT key AS job_id, skill_name, category, CASE bucket WHEN 'R' THEN 'REQUIRED' WHEN 'P' THEN 'PREFERRED' ELSE 'UNKNOWN' END AS bucket
      FROM j_req JOIN v_taxonomy USING (skill_pos)""",
    "match_scores": o.with_(*o.match_ctes()) + f"SELECT {_SCORE_COLS} FROM v_scores",
    "match_scores_library_variant": o.with_(*o.match_ctes(1.0, False)) + "SELECT resume_id, job_id, overall_score FROM v_scores",
    "analysis_items": o.with_(*o.match_ctes()) + """
      SELECT resume_id, job_id, skill_name, category, requirement_type, status, similarity_score, evidence FROM v_items""",
}
