"""Job requirement extraction: required / preferred / unknown skill lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from skilloom.functions import text as text_fn
from skilloom.functions.taxonomy import SKILLS, Skill
from skilloom.operators.skills import literal_array, with_section_matches

BUCKETS = ("required", "preferred", "unknown")


def with_requirement_positions(df: DataFrame, text: str, skills: tuple[Skill, ...] = SKILLS) -> DataFrame:
    """Add ``required_pos``, ``preferred_pos``, ``unknown_pos``: taxonomy positions in first-seen order.

    Sections are folded in reading order.  A skill is preferred only if it was
    not already required *by then*, and unknown only if it was in neither list,
    so a later required mention does not remove an earlier preferred one.  When
    nothing is required or preferred, the unknown skills become preferred.
    """
    df = with_section_matches(df, text, "_rq_sec", skills, brief=True)
    empty = "cast(array() as array<int>)"
    fold = (
        "aggregate(coalesce(transform(_rq_sec, s -> named_struct('type', s.type, 'ks', s.matches)), array()), "
        f"named_struct('r', {empty}, 'p', {empty}, 'u', {empty}), (acc, s) -> named_struct("
        "'r', if(s.type = 'REQUIRED', concat(acc.r, array_except(s.ks, acc.r)), acc.r), "
        "'p', if(s.type = 'PREFERRED', concat(acc.p, array_except(s.ks, concat(acc.r, acc.p))), acc.p), "
        "'u', if(s.type NOT IN ('REQUIRED', 'PREFERRED'), concat(acc.u, array_except(s.ks, concat(acc.r, acc.p, acc.u))), acc.u)))")
    none_named = "size(_rq.r) + size(_rq.p) = 0"
    return (df.withColumn("_rq", F.expr(fold))
            .withColumn("required_pos", F.expr("_rq.r"))
            .withColumn("preferred_pos", F.expr(f"if({none_named}, _rq.u, _rq.p)"))
            .withColumn("unknown_pos", F.expr(f"if({none_named}, {empty}, _rq.u)"))
            .drop("_rq", "_rq_sec"))


def with_requirements(df: DataFrame, text: str, out: str = "requirements",
                      skills: tuple[Skill, ...] = SKILLS) -> DataFrame:
    """Add ``out``: {required[], preferred[], unknown[], metadata} with names and categories."""
    names, cats = literal_array([s.name for s in skills]), literal_array([s.category for s in skills])
    df = with_requirement_positions(df, text, skills)
    item = f"p -> named_struct('skill_name', {names}[p], 'category', {cats}[p])"
    lists = ", ".join(f"'{b}', transform({b}_pos, {item})" for b in BUCKETS)
    totals = ", ".join(f"'total_{b}', size({b}_pos)" for b in BUCKETS)
    return (df.withColumn(out, F.expr(f"named_struct({lists}, 'metadata', named_struct({totals}))"))
            .drop(*[f"{b}_pos" for b in BUCKETS]))


def ingest_jobs(df: DataFrame, extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Clean title and description, then extract requirements from the cleaned text.

    ``extractor`` may be any ``DataFrame -> DataFrame`` that adds ``requirements``.
    """
    cleaned = (df.withColumn("title", text_fn.clean_title("title"))
               .withColumn("description", text_fn.clean_text("description")))
    return extractor(cleaned) if extractor else with_requirements(cleaned, "description")
