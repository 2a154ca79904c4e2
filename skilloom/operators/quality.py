"""Document quality diagnostics: section presence, length, bullets, verbs, metrics, score.

All rules are column expressions on the trimmed text; a row is scanned a fixed
number of times and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skilloom.functions import js
from skilloom.operators.sections import SKILLS_ANY_LINE

# --- fixed values: action verbs ----------------------------------------------
ACTION_VERBS = (
    "architected", "automated", "built", "configured", "constructed",
    "coordinated", "created", "debugged", "deployed", "designed",
    "developed", "engineered", "enhanced", "established", "executed",
    "expanded", "spearheaded", "implemented", "improved", "initiated",
    "installed", "integrated", "launched", "led", "maintained",
    "managed", "mentored", "migrated", "modernized", "monitored",
    "optimized", "orchestrated", "partitioned", "refactored", "resolved",
    "reviewed", "scaled", "tested", "tracked", "transformed",
)
METRIC_UNITS = ("users|clients|requests|qps|queries|rps|ms|seconds|minutes|hours|days|percent|records|rows|"
                "gb|tb|mb|customers")

# --- fixed values: header cues and contact patterns --------------------------
EXPERIENCE_CUES = r"experience|work{s}+experience|employment|work{s}+history|professional{s}+experience"
EDUCATION_CUES = r"education|academic{s}+background|academics|qualifications"
PROJECT_CUES = r"projects|technical{s}+projects|academic{s}+projects|personal{s}+projects"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.{w}]?)?\(?\d{3}\)?[-.{w}]?\d{3}[-.{w}]?\d{4}"

_E, _S = js.WORD_END, js.S


def _by_first_letter(words: tuple[str, ...]) -> str:
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{k}(?:{'|'.join(v)})" for k, v in groups.items())


# Texts are padded with a line feed in front, so "start of text" needs no case
# of its own and every pattern opens with a plain character, which scans fast.
_VERBS = f"(?i)[^{js.W}](?:{_by_first_letter(ACTION_VERBS)}){_E}"
_METRICS = (f"(?i)\\d(?<![{js.W}]\\d)\\d*(?:(?:\\.\\d+)?%|(?:\\.\\d+)?x{_E}|\\+?{_S}*(?:{METRIC_UNITS}){_E}"
            f"|(?:\\.\\d+)?[kmb](?:\\+(?=[{js.W}])|{_E}))|\\${_S}*\\d+")
_BULLETS = f"\\n{_S}*[-*•–—]{_S}+"


def _header(cues: str) -> str:
    return f"(?i){js.LINE_BREAK}{_S}*(?:{cues.replace('{s}', _S)}){_E}"


# --- fixed values: deductions, in report order -------------------------------
SECTION_RULES = (
    ("has_contact", "MISSING_CONTACT", 15.0,
     "Resume lacks essential contact information (email or phone number).",
     "Essential contact information (email or phone) is provided."),
    ("has_skills", "MISSING_SKILLS", 15.0,
     "Resume lacks a dedicated Skills or Technical Proficiencies section.",
     "Dedicated Skills or Technical Proficiencies section found."),
    ("has_experience", "MISSING_EXPERIENCE", 20.0,
     "Resume lacks a dedicated Experience or Work History section.",
     "Experience / Work History section found."),
    ("has_education", "MISSING_EDUCATION", 15.0,
     "Resume lacks a dedicated Education or Academic Background section.",
     "Education section found."),
    ("has_projects", "MISSING_PROJECTS", 10.0,
     "Resume lacks a dedicated Projects section demonstrating applied technical experience.",
     "Projects section found."),
)
LENGTH_RULES = {
    "TOO_BRIEF": ("WORD_COUNT_TOO_BRIEF", 20.0, "Resume is severely brief (under 150 words) and lacks sufficient detail."),
    "SHORT": ("WORD_COUNT_SHORT", 10.0,
              "Resume is on the shorter side (under 250 words); consider expanding role details."),
    "LONG": ("WORD_COUNT_LONG", 5.0, "Resume is lengthy (over 1000 words); consider editing for conciseness."),
    "EXCESSIVE": ("WORD_COUNT_EXCESSIVE", 15.0,
                  "Resume is excessively long (over 1500 words); standard resumes should be concise."),
}
BULLET_RULE = ("BULLET_POINTS_SPARSE", 10.0,
               "Resume has fewer than 3 bullet points, indicating dense narrative text that reduces scannability.")
VERB_RULE = ("ACTION_VERBS_LOW", 10.0,
             "Fewer than 3 strong action verbs detected; use verbs like 'developed', 'architected', or 'optimized' "
             "to highlight initiative.")
METRIC_ZERO = ("METRICS_ZERO", 15.0,
               "No quantifiable results or metrics detected; add numbers, percentages, or scale indicators to "
               "demonstrate impact.")
METRIC_SPARSE = ("METRICS_SPARSE", 5.0,
                 "Fewer than 3 quantifiable metrics detected; consider adding more measurable outcomes to project "
                 "and work bullets.")
OPTIMAL_STRENGTH = ("Word count (", " words) is within the optimal readability range (250–1,000 words).")
BULLET_STRENGTH = ("Bullet points (", " detected) provide clear structural scannability.")
VERB_STRENGTH = ("Strong action verbs (", " detected) demonstrate initiative and execution.")
METRIC_STRENGTH = ("Includes quantifiable metrics (", " detected) demonstrating tangible impact.")
UNAVAILABLE_REASON = "Original resume text is no longer retained"

FEATURES = ["quality_status", "has_contact", "has_skills", "has_experience", "has_education", "has_projects",
            "word_count", "word_count_status", "bullet_points_count", "action_verbs_count",
            "quantifiable_metrics_count"]


def _rlike(t: Column, pattern: str) -> Column:
    return F.regexp_like(t, F.lit(pattern))


def with_quality_features(df: DataFrame, text: str) -> DataFrame:
    """Add the measured features; all null except the status when the text is blank."""
    d = df.withColumn("_qt", F.concat(F.lit("\n"), F.nullif(js.trim(F.col(text)), F.lit(""))))
    t = F.col("_qt")
    words = F.col("word_count")
    d = d.withColumns({
        "quality_status": F.when(t.isNull(), "UNAVAILABLE").otherwise("AVAILABLE"),
        "has_contact": (F.contains(t, F.lit("@")) & _rlike(t, EMAIL)) | _rlike(t, "(?=[+(0-9])" + PHONE.replace("{w}", js.WS)),
        "has_skills": _rlike(t, SKILLS_ANY_LINE),
        "has_experience": _rlike(t, _header(EXPERIENCE_CUES)),
        "has_education": _rlike(t, _header(EDUCATION_CUES)),
        "has_projects": _rlike(t, _header(PROJECT_CUES)),
        "word_count": js.word_count(t).cast("long"),
        "bullet_points_count": F.regexp_count(t, F.lit(_BULLETS)).cast("long"),
        "action_verbs_count": F.regexp_count(t, F.lit(_VERBS)).cast("long"),
        "quantifiable_metrics_count": F.regexp_count(t, F.lit(_METRICS)).cast("long"),
    })
    return d.withColumn("word_count_status", F.when(words < 150, "TOO_BRIEF").when(words < 250, "SHORT")
                        .when(words <= 1000, "OPTIMAL").when(words <= 1500, "LONG")
                        .when(words > 1500, "EXCESSIVE")).drop("_qt")


def _deduction(rule: tuple[str, float, str]) -> Column:
    return F.struct(F.lit(rule[0]).alias("rule"), F.lit(rule[1]).alias("deduction"), F.lit(rule[2]).alias("reason"))


def _counted(parts: tuple[str, str], count: str) -> Column:
    return F.concat(F.lit(parts[0]), F.col(count).cast("string"), F.lit(parts[1]))


def with_quality_report(df: DataFrame, text: str) -> DataFrame:
    """Features plus ``deductions[]``, ``strengths[]`` and ``quality_score``."""
    d = with_quality_features(df, text)
    low = lambda c: F.col(c) < 3
    metrics = F.col("quantifiable_metrics_count")
    lost, kept = [], []
    for flag, rule, points, reason, strength in SECTION_RULES:
        lost.append(F.when(~F.col(flag), _deduction((rule, points, reason))))
        kept.append(F.when(F.col(flag), F.lit(strength)))
    for status, rule in LENGTH_RULES.items():
        lost.append(F.when(F.col("word_count_status") == status, _deduction(rule)))
    kept.append(F.when(F.col("word_count_status") == "OPTIMAL", _counted(OPTIMAL_STRENGTH, "word_count")))
    lost += [F.when(low("bullet_points_count"), _deduction(BULLET_RULE)),
             F.when(low("action_verbs_count"), _deduction(VERB_RULE)),
             F.when(metrics == 0, _deduction(METRIC_ZERO)).when(metrics < 3, _deduction(METRIC_SPARSE))]
    kept += [F.when(~low("bullet_points_count"), _counted(BULLET_STRENGTH, "bullet_points_count")),
             F.when(~low("action_verbs_count"), _counted(VERB_STRENGTH, "action_verbs_count")),
             F.when(metrics >= 3, _counted(METRIC_STRENGTH, "quantifiable_metrics_count"))]
    d = d.withColumns({"deductions": F.array_compact(F.array(*lost)), "strengths": F.array_compact(F.array(*kept))})
    total = F.aggregate("deductions", F.lit(0.0), lambda acc, x: acc + x["deduction"])
    score = js.round_half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) - total)), 2)
    return d.withColumns({
        "quality_score": F.when(F.col("quality_status") == "AVAILABLE", score),
        "quality_reason": F.when(F.col("quality_status") == "UNAVAILABLE", F.lit(UNAVAILABLE_REASON))})
