"""Queries that validate whole generated records: profiles, comparisons, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skilloom.operators import schema, validation
from skilloom.oracle import base as o
from skilloom.sources import feeds

# Parts of the records, as both engines read them; k is a resume, j a job, i the place in a list.
SUMMARY = "CASE WHEN k % 11 = 0 THEN repeat('s', 1001) ELSE '  Works with care ' END"
SKILL = "repeat('n', cast(k % 230 as int))"
SKILL_KIND = "CASE k % 3 WHEN 0 THEN 'ODD' WHEN 1 THEN 'METHODOLOGY' END"
SKILL_SHOWN = "CASE k % 4 WHEN 0 THEN 'ab' WHEN 1 THEN repeat('e', 401) WHEN 2 THEN NULL ELSE 'seen' END"
SCHOOL, SCHOOL_START = "CASE WHEN k % 6 = 0 THEN '' ELSE 'State' END", "repeat('1', cast(k % 40 as int))"
ABOUT_PROJECT, PROJECT_TOOL = "CASE WHEN k % 9 = 0 THEN NULL ELSE 'A project' END", "repeat('t', cast(k % 110 as int))"
OVERALL, OVERALL_SOURCE = "CASE WHEN j % 7 = 0 THEN 'abc' ELSE 'Fits well' END", "CASE WHEN k % 5 = 0 THEN 'GUESS' ELSE 'RESUME_EVIDENCE' END"
STRENGTH, STRENGTH_SOURCE = "CASE WHEN j % 3 = 0 THEN 'ok' ELSE 'Knows it' END", "CASE WHEN k % 4 = 1 THEN NULL ELSE 'JOB_REQUIREMENT' END"
CONTEXT, MATCH = "CASE WHEN k % 3 = 0 THEN '' ELSE 'asked for' END", "CASE j % 4 WHEN 0 THEN 'MAYBE' WHEN 1 THEN NULL ELSE 'ADJACENT' END"
QUOTE, REASON = "repeat('q', cast((k + j) % 500 as int))", "CASE WHEN j % 13 = 0 THEN NULL ELSE 'It helps' END"
STRATEGY = "CASE WHEN k % 8 = 0 THEN '' ELSE 'Go on' END"
CATEGORY = "CASE i % 3 WHEN 0 THEN 'SKILL_GAP' WHEN 1 THEN 'RESUME_STRENGTH' ELSE 'JOB_REQUIREMENT' END"
SOURCE = "CASE (i + k) % 3 WHEN 0 THEN 'DETERMINISTIC_ANALYSIS' WHEN 1 THEN 'RESUME_EVIDENCE' ELSE 'JOB_REQUIREMENT' END"
TITLE, SHOWN = "repeat('t', cast((k * i) % 210 as int))", "CASE (i * k) % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'quoted' END"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {c}" for n, c in fields.items()) + ")"


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON profile per resume."""
    record = _struct(
        professional_summary=f"if(k % 5 = 0, null, {_struct(text=SUMMARY)})",
        technical_skills=f"array({_struct(name=repr('Java'), category=repr('DATABASE'), evidence_snippet=repr('used daily'))}, "
                         f"{_struct(name=SKILL, category=SKILL_KIND, evidence_snippet=SKILL_SHOWN)})",
        soft_skills=f"array_repeat({_struct(name=repr('team'), evidence_snippet=repr('a team'))}, cast(k % 120 as int))",
        education=f"array({_struct(institution=SCHOOL, start_year=SCHOOL_START, evidence_snippet=repr('State 2015'))})",
        projects=f"array({_struct(name=repr('P'), description=ABOUT_PROJECT, technologies_used=f'array({PROJECT_TOOL})', evidence_snippet=repr('Built P'))})")
    return feeds.resumes(spark, sf).select(F.col("resume_id").alias("k")).select(F.col("k").alias("resume_id"), F.expr(f"to_json({record})").alias("profile"))


def _listed(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode_outer("violations").alias("violation")).filter(F.col("violation").isNotNull())


def profile_record_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(validation.profile_violations(_profiles(spark, sf), "profile"), "resume_id")


def accepted_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The stored form of profiles that nothing is wrong with: trimmed, with defaults."""
    judged = validation.profile_violations(_profiles(spark, sf), "profile").filter(F.size("violations") == 0)
    p = schema.accepted(F.col("profile"), validation.PROFILE)
    return judged.select("resume_id", p.alias("p")).select(
        "resume_id", F.col("p.professional_summary.text").alias("text"), F.col("p.professional_summary.verification_status").alias("summary_status"),
        F.col("p.technical_skills")[1]["category"].alias("category"), F.size("p.work_experience").cast("long").alias("work"),
        F.col("p.education")[0]["verification_status"].alias("school_status"))


def comparison_record_violations(spark: SparkSession, sf: str) -> DataFrame:
    """One typed comparison per application."""
    record = _struct(
        overall_context=f"if((k + j) % 17 = 0, null, {_struct(summary=OVERALL, source_type=OVERALL_SOURCE)})",
        strengths=f"array({_struct(claim=STRENGTH, source_type=STRENGTH_SOURCE)}, {_struct(claim=repr('Sure'), source_type=repr('JOB_REQUIREMENT'))})",
        requirement_analysis=f"array({_struct(requirement=repr('Java'), context=CONTEXT, match_type=MATCH, source_type=repr('JOB_REQUIREMENT'), evidence_snippet=QUOTE)})",
        recommendations=f"array({_struct(recommendation=repr('Read'), reason=REASON, source_type=repr('JOB_REQUIREMENT'))})")
    pairs = feeds.applications(spark, sf).select(F.col("resume_id").alias("k"), F.col("job_id").alias("j"))
    d = pairs.select(F.col("k").alias("resume_id"), F.col("j").alias("job_id"), F.expr(record).alias("comparison"))
    return _listed(validation.comparison_violations(d, "comparison"), "resume_id", "job_id")


def recommendation_record_violations(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON record per resume with 0 to 27 recommendations; some have no list, some can't be read."""
    item = _struct(id="concat('r', cast(i as string))", category=CATEGORY, source_type=SOURCE, title=TITLE, recommendation="'do'", rationale="'why'",
                   priority="'HIGH'", evidence_snippet=SHOWN)
    items = f"if(k % 29 = 28, null, transform(slice(sequence(0, 28), 1, cast(k % 29 as int)), i -> {item}))"
    text = f"if(k % 31 = 0, '{{oops', to_json({_struct(overall_strategy=_struct(summary=STRATEGY), recommendations=items)}))"
    d = feeds.resumes(spark, sf).select(F.col("resume_id").alias("k")).select(F.col("k").alias("resume_id"), F.expr(text).alias("record"))
    return _listed(validation.recommendations_violations(d, "record"), "resume_id")


QUERIES = {f.__name__: f for f in (profile_record_violations, accepted_profiles, comparison_record_violations, recommendation_record_violations)}

# --- SQL twins ---------------------------------------------------------------


def _rules(table: str, keys: str, rules: list[tuple[str, str]]) -> str:
    """One SELECT for every (path, condition); a path is text, or an expression where it starts with a quote."""
    return " UNION ALL ".join(f"SELECT {keys}, {p if p.startswith(chr(39)) else o.lit(p)} AS violation FROM {table} WHERE {w}" for p, w in rules)


_K = "p AS (SELECT c_custkey AS k FROM customer)"
_PROFILE_RULES = [
    ("professional_summary.text.max", f"k % 5 <> 0 AND length({SUMMARY}) > 1000"), ("technical_skills[1].name.min", f"{SKILL} = ''"),
    ("technical_skills[1].name.max", f"length({SKILL}) > 200"), ("technical_skills[1].category.enum", f"{SKILL_KIND} = 'ODD'"),
    ("technical_skills[1].evidence_snippet.missing", f"{SKILL_SHOWN} IS NULL"), ("technical_skills[1].evidence_snippet.min", f"length({SKILL_SHOWN}) < 3"),
    ("technical_skills[1].evidence_snippet.max", f"length({SKILL_SHOWN}) > 400"), ("soft_skills.max_items", "k % 120 > 100"),
    ("education[0].institution.min", f"{SCHOOL} = ''"), ("education[0].start_year.max", f"length({SCHOOL_START}) > 30"),
    ("projects[0].description.missing", f"{ABOUT_PROJECT} IS NULL"), ("projects[0].technologies_used[0].max", f"length({PROJECT_TOOL}) > 100")]
_I = "'recommendations[' || i || '].{}'"
ORACLES = {
    "profile_record_violations": o.with_(_K) + _rules("p", "k AS resume_id", _PROFILE_RULES),
    "accepted_profiles": o.with_(_K) + f"""SELECT k AS resume_id, CASE WHEN k % 5 <> 0 THEN trim({SUMMARY}) END AS text, CASE WHEN k % 5 <> 0 THEN 'UNVERIFIED' END AS summary_status,
      coalesce({SKILL_KIND}, 'TECHNICAL_OTHER') AS category, 0::BIGINT AS work, 'VERIFIED' AS school_status FROM p
      WHERE {' AND '.join(f'({w}) IS NOT TRUE' for _, w in _PROFILE_RULES)}""",
    "comparison_record_violations": o.with_(o.APPLICATIONS, "p AS (SELECT resume_id AS k, job_id AS j FROM v_applications)") + _rules("p", "k AS resume_id, j AS job_id", [
        ("overall_context.missing", "(k + j) % 17 = 0"), ("overall_context.summary.min", f"(k + j) % 17 <> 0 AND length({OVERALL}) < 5"),
        ("overall_context.source_type.enum", f"(k + j) % 17 <> 0 AND {OVERALL_SOURCE} = 'GUESS'"), ("strengths[0].claim.min", f"length({STRENGTH}) < 3"),
        ("strengths[0].source_type.missing", f"{STRENGTH_SOURCE} IS NULL"), ("requirement_analysis[0].context.min", f"{CONTEXT} = ''"),
        ("requirement_analysis[0].match_type.enum", f"{MATCH} = 'MAYBE'"), ("requirement_analysis[0].evidence_snippet.max", f"length({QUOTE}) > 400"),
        ("recommendations[0].reason.missing", f"{REASON} IS NULL")]),
    "recommendation_record_violations": o.with_(
        _K, "r AS (SELECT k FROM p WHERE k % 31 <> 0)",
        f"n AS (SELECT k, i, {CATEGORY} AS c, {SOURCE} AS s, {TITLE} AS t, {SHOWN} AS e FROM (SELECT k, unnest(range(k % 29)) AS i FROM r WHERE k % 29 <> 28))")
    + "SELECT k AS resume_id, 'json.invalid' AS violation FROM p WHERE k % 31 = 0 UNION ALL "
    + _rules("r", "k AS resume_id", [("overall_strategy.summary.min", f"{STRATEGY} = ''"), ("recommendations.missing", "k % 29 = 28"),
                                     ("recommendations.min_items", "k % 29 = 0"), ("recommendations.max_items", "k % 29 BETWEEN 26 AND 27")])
    + " UNION ALL " + _rules("n", "k AS resume_id", [
        (_I.format("title.min"), "t = ''"), (_I.format("title.max"), "length(t) > 200"),
        (_I.format("source_type.pairing"), "s <> CASE c WHEN 'SKILL_GAP' THEN 'DETERMINISTIC_ANALYSIS' WHEN 'RESUME_STRENGTH' THEN 'RESUME_EVIDENCE' ELSE c END"),
        (_I.format("evidence_snippet.must_be_null"), "s = 'DETERMINISTIC_ANALYSIS' AND e IS NOT NULL"),
        (_I.format("evidence_snippet.required"), "s = 'RESUME_EVIDENCE' AND trim(coalesce(e, '')) = ''")]),
}
