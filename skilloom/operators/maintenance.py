"""Upserts, deletions, audits and backfills on the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skilloom.functions import js
from skilloom.operators.requirements import with_requirements
from skilloom.functions import text as text_fn


# --- catalog and jobs --------------------------------------------------------

def catalog_insert_missing(target: DataFrame, incoming: DataFrame, name: str = "skill_name") -> DataFrame:
    """Target plus incoming rows whose name is new, ignoring case (first spelling in name order wins)."""
    fresh = (incoming.groupBy(F.lower(name).alias("_k")).agg(F.min_by(F.struct(*incoming.columns), F.col(name)).alias("_r"))
             .join(target.select(F.lower(name).alias("_k")).distinct(), "_k", "left_anti").select("_r.*"))
    return target.unionByName(fresh.select(*target.columns))


def job_upsert(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply partial updates (null = keep); new ids are inserted.

    Titles and descriptions are cleaned, and requirements are extracted again
    only for rows whose description was given.
    ``current``: job_id, title, description, requirements.
    """
    u = updates.select("job_id", text_fn.clean_title("title").alias("_title"),
                       F.when(F.col("description").isNotNull(), text_fn.clean_text("description")).alias("_desc"))
    # Extraction reads null texts for untouched rows and so does no work there.
    u = with_requirements(u, "_desc", "_req")
    d = current.join(u, "job_id", "full_outer")
    changed = F.col("_desc").isNotNull()
    return d.select("job_id", F.coalesce("_title", "title").alias("title"), F.coalesce("_desc", "description").alias("description"),
                    F.when(changed, F.col("_req")).otherwise(F.col("requirements")).alias("requirements"),
                    changed.alias("re_extracted"))


def json_set(doc: Column, key: str, value_json: Column) -> Column:
    """Set one top-level key of a JSON object, keeping the others.  A text that is no JSON object stays as it is (see ``json_error``)."""
    as_map = F.coalesce(F.from_json(doc, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(as_map, lambda k, v: k != key)
    merged = F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(value_json))))
    return F.when(json_error(doc).isNotNull(), doc).otherwise(merged)


def json_error(doc: Column) -> Column:
    """``INVALID_JSON`` for a text that is no JSON object, null for objects and for no text."""
    return F.when(doc.isNotNull() & F.from_json(doc, "map<string,variant>").isNull(), "INVALID_JSON")


def json_set_nested(doc: Column, outer: str, inner: Column, value_json: Column) -> Column:
    """Set ``doc[outer][inner]``, keeping every other key on both levels."""
    held = F.get_json_object(doc, f"$.{outer}")
    as_map = F.coalesce(F.from_json(held, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(as_map, lambda k, v: k != inner)
    return json_set(doc, outer, F.to_json(F.map_concat(kept, F.create_map(inner, F.parse_json(value_json)))))


# --- deletions ---------------------------------------------------------------

def detach_deleted(analyses: DataFrame, deleted: DataFrame, id_col: str) -> DataFrame:
    """Owner row deleted: analyses keep scores and snapshots, only the id becomes null."""
    gone = deleted.select(F.col(id_col)).distinct().withColumn("_gone", F.lit(True))
    return (analyses.join(gone, id_col, "left").withColumn(id_col, F.when(F.col("_gone").isNull(), F.col(id_col)))
            .drop("_gone").select(*analyses.columns))


def cascade_user_delete(users: DataFrame, resumes: DataFrame, jobs: DataFrame, analyses: DataFrame, items: DataFrame,
                        deleted: DataFrame) -> dict[str, DataFrame]:
    """Remove users with everything they own, items included."""
    drop = lambda df: df.join(deleted.select("user_id"), "user_id", "left_anti")
    doomed = analyses.join(deleted.select("user_id"), "user_id", "left_semi").select("analysis_id")
    return {"users": drop(users), "resumes": drop(resumes), "jobs": drop(jobs), "analyses": drop(analyses),
            "items": items.join(doomed, "analysis_id", "left_anti")}


def delete_analyses(analyses: DataFrame, items: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = deleted.select("analysis_id")
    return analyses.join(ids, "analysis_id", "left_anti"), items.join(ids, "analysis_id", "left_anti")


def delete_where(analyses: DataFrame, doomed: Column) -> DataFrame:
    """As :func:`delete_analyses` by a rule, for analyses that carry their items or the number of them: one pass, nothing is joined."""
    return analyses.filter(~F.coalesce(doomed, F.lit(False)))


def catalog_delete_blockers(requested: DataFrame, items: DataFrame, key: str = "skill_name") -> DataFrame:
    """Catalog rows that cannot be deleted because items still use them."""
    return requested.join(items.select(key).distinct(), key, "left_semi")


# --- audits ------------------------------------------------------------------

def audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the table; one row per rule with the number of violating rows."""
    counts = df.agg(*[F.count_if(~rule).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    pairs = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, violations)")


def in_range(c: str, low: float, high: float, nullable: bool = False) -> Column:
    ok = F.coalesce((F.col(c) >= low) & (F.col(c) <= high), F.lit(nullable))
    return ok


def length_between(c: str, low: int, high: int) -> Column:
    n = js.utf16_length(js.trim(F.col(c)))
    return F.coalesce((n >= low) & (n <= high), F.lit(False))


def one_of(c: str, *values: str) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


ANALYSIS_RULES = {f"{c}_0_100": (c, 0.0, 100.0) for c in
                  ("overall_score", "skill_score", "experience_score", "project_score", "education_score", "quality_score")}


def analysis_rules() -> dict[str, Column]:
    return {name: in_range(*spec) for name, spec in ANALYSIS_RULES.items()}


def item_rules() -> dict[str, Column]:
    return {"status_enum": one_of("status", "MATCHED", "MISSING", "PARTIAL"),
            "similarity_0_100": in_range("similarity_score", 0.0, 100.0, nullable=True),
            "confidence_0_1": in_range("confidence", 0.0, 1.0)}


def resume_rules() -> dict[str, Column]:
    return {"extraction_status_enum": one_of("extraction_status", "PENDING", "PROCESSING", "COMPLETED", "FAILED"),
            "file_size_min_0": F.coalesce(F.col("file_size") >= 0, F.lit(True)),
            "processing_attempts_min_0": F.coalesce(F.col("processing_attempts") >= 0, F.lit(False))}


def job_rules() -> dict[str, Column]:
    return {"title_3_255": length_between("title", 3, 255), "description_20_50000": length_between("description", 20, 50_000)}


def backfill(df: DataFrame, size: str = "file_size", mime: str = "mime_type", attempts: str = "processing_attempts") -> DataFrame:
    """Replace nulls left by older rows with the documented defaults."""
    return df.fillna({size: 0, mime: "application/octet-stream", attempts: 0})
