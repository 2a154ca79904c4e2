"""Bounds, enums and cross-field rules for claim records, as violation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skilloom.functions import js
from skilloom.operators.grounding import MATCH_TYPES, PAIRING, _any
from skilloom.operators.schema import Many, OneOf, Record, Shape, Text, checked

# --- fixed values: field bounds (min, max characters; None = unbounded) -------
SOURCE_TYPES = ("RESUME_EVIDENCE", "DETERMINISTIC_ANALYSIS", "JOB_REQUIREMENT")
PRIORITIES = ("HIGH", "MEDIUM", "LOW")
RECOMMENDATION_BOUNDS = {"id": (1, None), "title": (1, 200), "recommendation": (1, 1000), "rationale": (1, 1000)}
RECOMMENDATION_SNIPPET_MAX = 500
MIN_RECOMMENDATIONS, MAX_RECOMMENDATIONS = 1, 25
EVIDENCE_MIN, EVIDENCE_MAX, PROFILE_ITEMS_MAX = 3, 400, 100
STATUSES = ("VERIFIED", "UNVERIFIED")
SKILL_KINDS = ("PROGRAMMING_LANGUAGE", "FRAMEWORK_OR_LIBRARY", "DATABASE", "CLOUD_AND_DEVOPS", "TOOL_OR_UTILITY", "METHODOLOGY", "TECHNICAL_OTHER")
AWARD_KINDS = ("CERTIFICATION", "AWARD", "PUBLICATION", "PATENT", "OTHER")

# --- fixed values: shapes of profiles, comparisons and recommendations --------
_SHOWN = Text(EVIDENCE_MIN, EVIDENCE_MAX)
_NAME, _VALUE = Text(1, 200), Text(0, 200, optional=True, trim=False)


def _short(high: int) -> Text:
    return Text(0, high, optional=True, trim=False)


def _judged(default: str) -> dict[str, Shape]:
    return {"verification_status": OneOf(STATUSES, default), "unverified_reason": Text(optional=True, trim=False)}


def _section(**fields: Shape) -> Many:
    return Many(Record({**fields, "evidence_snippet": _SHOWN, **_judged("VERIFIED")}), high=PROFILE_ITEMS_MAX)


def _lines(high: int) -> Many:
    return Many(Text(0, high), high=PROFILE_ITEMS_MAX)


PROFILE = Record({
    "professional_summary": Record({"text": Text(0, 1000), "evidence_snippet": _short(EVIDENCE_MAX), **_judged("UNVERIFIED")}, optional=True),
    "technical_skills": _section(name=_NAME, category=OneOf(SKILL_KINDS, "TECHNICAL_OTHER")),
    "soft_skills": _section(name=_NAME),
    "education": _section(institution=_NAME, degree=_VALUE, field_of_study=_VALUE, start_year=_short(30), graduation_year=_short(30),
                          gpa_or_grade=_short(50)),
    "work_experience": _section(organization=_NAME, role=_NAME, location=_VALUE, start_date=_short(50), end_date=_short(50),
                                key_responsibilities=_lines(500), quantified_achievements=_lines(500)),
    "projects": _section(name=_NAME, description=Text(0, 1000), technologies_used=_lines(100), link_or_url=_short(300)),
    "certifications_and_achievements": _section(title=_NAME, issuer=_VALUE, issue_date=_short(50), type=OneOf(AWARD_KINDS, "OTHER")),
    "ambiguous_or_unclear_items": Many(Record({"section": Text(0, 100), "text_snippet": _SHOWN, "ambiguity_reason": Text(0, 400)}),
                                       high=PROFILE_ITEMS_MAX),
})


def _claims(**fields: Shape) -> Record:
    return Record({**fields, "source_type": OneOf(SOURCE_TYPES), "evidence_snippet": _short(EVIDENCE_MAX), **_judged("UNVERIFIED")})


COMPARISON = Record({
    "overall_context": _claims(summary=Text(5, 2000)),
    "strengths": Many(_claims(claim=Text(3, 500))),
    "gaps": Many(_claims(claim=Text(3, 500))),
    "requirement_analysis": Many(_claims(requirement=Text(1, 300), context=Text(1, 1000), match_type=OneOf(MATCH_TYPES, "NO_EVIDENCE"))),
    "transferable_experience": Many(_claims(claim=Text(3, 500))),
    "recommendations": Many(_claims(recommendation=Text(3, 500), reason=Text(3, 1000))),
})
RECOMMENDATION = Record(
    {"id": Text(1, trim=False), "category": OneOf(tuple(PAIRING)), "source_type": OneOf(SOURCE_TYPES), "title": Text(1, 200),
     "recommendation": Text(1, 1000), "rationale": Text(1, 1000), "priority": OneOf(PRIORITIES),
     "evidence_snippet": _short(RECOMMENDATION_SNIPPET_MAX), **_judged("UNVERIFIED")},
    {"source_type.pairing": lambda r: F.coalesce(_any([(r["category"] == c) & ~r["source_type"].eqNullSafe(s) for c, s in PAIRING.items()]), F.lit(False)),
     "evidence_snippet.must_be_null": lambda r: (r["source_type"] == "DETERMINISTIC_ANALYSIS") & r["evidence_snippet"].isNotNull(),
     "evidence_snippet.required": lambda r: (r["source_type"] == "RESUME_EVIDENCE") & (js.trim(F.coalesce(r["evidence_snippet"], F.lit(""))) == "")})
RECOMMENDATIONS = Record({
    "overall_strategy": Record({"summary": Text(1, 2000), **_judged("UNVERIFIED")}),
    "recommendations": Many(RECOMMENDATION, MIN_RECOMMENDATIONS, MAX_RECOMMENDATIONS, optional=False)})
RECOMMENDATION_SHAPE = ("id string, category string, source_type string, title string, recommendation string, "
                        "rationale string, priority string, evidence_snippet string")


def bounds(c: Column, name: str, low: int, high: int | None, required: bool = True) -> list[Column]:
    n = js.utf16_length(c)
    out = [F.when(c.isNull(), f"{name}.missing")] if required else []
    if low:
        out.append(F.when(n < low, f"{name}.min"))
    if high is not None:
        out.append(F.when(n > high, f"{name}.max"))
    return out


def one_of(c: Column, name: str, allowed: tuple[str, ...]) -> Column:
    return F.when(c.isNull() | ~c.isin(*allowed), f"{name}.enum")


def recommendation_violations(df: DataFrame, json_col: str, out: str = "violations") -> DataFrame:
    """Parse recommendation JSON and list what is wrong with it (empty = accepted)."""
    d = df.withColumn("_r", F.from_json(json_col, RECOMMENDATION_SHAPE))
    r = lambda f: F.col("_r")[f]
    checks: list[Column] = [F.when(F.col("_r").isNull(), "json.invalid")]
    for name, (low, high) in RECOMMENDATION_BOUNDS.items():
        checks += bounds(r(name), name, low, high)
    checks += [one_of(r("category"), "category", tuple(PAIRING)), one_of(r("source_type"), "source_type", SOURCE_TYPES),
               one_of(r("priority"), "priority", PRIORITIES)]
    checks += bounds(r("evidence_snippet"), "evidence_snippet", 0, RECOMMENDATION_SNIPPET_MAX, required=False)
    wrong = F.lit(False)
    for cat, src in PAIRING.items():
        wrong = wrong | ((r("category") == cat) & (r("source_type") != src))
    snippet = r("evidence_snippet")
    checks += [F.when(wrong, "source_type.pairing"),
               F.when((r("source_type") == "DETERMINISTIC_ANALYSIS") & snippet.isNotNull(), "evidence_snippet.must_be_null"),
               F.when((r("source_type") == "RESUME_EVIDENCE") & (js.trim(F.coalesce(snippet, F.lit(""))) == ""), "evidence_snippet.required")]
    return d.withColumn(out, F.array_compact(F.array(*checks))).drop("_r")


def profile_violations(df: DataFrame, profile: str, out: str = "violations") -> DataFrame:
    """What is wrong with a profile record (JSON or typed), as :func:`schema.checked` has it."""
    return checked(df, profile, PROFILE, out)


def comparison_violations(df: DataFrame, comparison: str, out: str = "violations") -> DataFrame:
    """The same for a whole comparison record."""
    return checked(df, comparison, COMPARISON, out)


def recommendations_violations(df: DataFrame, record: str, out: str = "violations") -> DataFrame:
    """The same for a record of recommendations and their strategy; one without items is reported."""
    return checked(df, record, RECOMMENDATIONS, out)


def summary_from_json(c: Column, evidence_max: int = EVIDENCE_MAX) -> Column:
    """Professional summary given as text or as an object; blank becomes null."""
    as_object = F.from_json(c, "text string, summary string, evidence_snippet string, verification_status string, unverified_reason string")
    plain = js.trim(F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"])
    is_object = js.trim(c).startswith("{")
    shape = lambda text, snip, status, why: F.struct(
        text.alias("text"), snip.alias("evidence_snippet"), status.alias("verification_status"), why.alias("unverified_reason"))
    none = F.lit(None).cast("string")
    obj = shape(js.trim(F.coalesce(as_object["text"], as_object["summary"], F.lit(""))), js.trim(as_object["evidence_snippet"]),
                F.when(as_object["verification_status"] == "VERIFIED", "VERIFIED").otherwise("UNVERIFIED"), as_object["unverified_reason"])
    txt = shape(plain, F.when(js.utf16_length(plain) <= evidence_max, plain), F.lit("UNVERIFIED"), none)
    return F.when(is_object, obj).when(plain != "", txt)
