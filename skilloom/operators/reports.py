"""Lists, pages, searches and dashboard figures.

Per-tenant pages use ``row_number() <= n`` (limited before the shuffle) and
totals come from a partial aggregate, so one huge tenant stays cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from skilloom.functions import js

HIGH_SCORE, LOW_SCORE = 80, 60
MAX_PAGE_SIZE = 50


def total_pages(total: Column, limit: int) -> Column:
    return F.greatest(F.ceil(total / limit), F.lit(1)).cast("long")


def history_page(df: DataFrame, page: int = 1, limit: int = 10, tenant: str = "user_id", newest: str = "created_at",
                 tiebreak: str = "analysis_id") -> DataFrame:
    """Page ``page`` of every tenant's rows, newest first, with totals."""
    if page < 1 or not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError("page starts at 1 and limit is 1..50")
    w = Window.partitionBy(tenant).orderBy(F.desc(newest), F.asc(tiebreak))
    rows = df.withColumn("row_no", F.row_number().over(w)).filter(F.col("row_no") <= page * limit)
    totals = df.groupBy(tenant).agg(F.count("*").alias("total"))
    return (rows.filter(F.col("row_no") > (page - 1) * limit).join(totals, tenant)
            .withColumn("total_pages", total_pages(F.col("total"), limit)))


def tenant_page(df: DataFrame, user_id: int, page: int = 1, limit: int = 10, newest: str = "created_at",
                tiebreak: str = "analysis_id") -> DataFrame:
    """One tenant's page: filter is pushed to the scan, then a top-n with offset."""
    return (df.filter(F.col("user_id") == user_id).orderBy(F.desc(newest), F.asc(tiebreak))
            .offset((page - 1) * limit).limit(limit))


def point_lookup(df: DataFrame, id_col: str, value, user_id) -> DataFrame:
    """Row by id, visible only to its tenant."""
    return df.filter((F.col(id_col) == value) & (F.col("user_id") == user_id))


def score_band(score: Column) -> Column:
    """high / medium / low badge."""
    return F.when(score >= HIGH_SCORE, "high").when(score >= LOW_SCORE, "medium").otherwise("low")


def band_filter(df: DataFrame, band: str, score: str = "overall_score") -> DataFrame:
    """``high`` (>= 80), ``review`` (< 80), ``low`` (< 60) or ``all``."""
    s = F.col(score)
    rule = {"high": s >= HIGH_SCORE, "review": s < HIGH_SCORE, "low": s < LOW_SCORE}.get(band)
    return df if rule is None else df.filter(rule)


def band_counts(df: DataFrame, *keys: str, score: str = "overall_score") -> DataFrame:
    s = F.col(score)
    return df.groupBy(*keys).agg(F.count("*").alias("all_count"), F.count_if(s >= HIGH_SCORE).alias("high_count"),
                                 F.count_if(s < LOW_SCORE).alias("low_count"))


def search(df: DataFrame, term: str, *cols: str) -> DataFrame:
    """Rows where any column contains ``term``, ignoring case; nulls count as empty."""
    needle = term.lower()
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle)
    return df.filter(hit)


def status_filter(df: DataFrame, status: str, col: str = "extraction_status") -> DataFrame:
    return df if status.upper() == "ALL" else df.filter(F.upper(col) == status.upper())


STATUSES = ("COMPLETED", "PROCESSING", "PENDING", "FAILED")


def status_counts(df: DataFrame, *keys: str, col: str = "extraction_status") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("all_count"),
                                 *[F.count_if(F.upper(col) == s).alias(f"{s.lower()}_count") for s in STATUSES])


def job_skill_counts(df: DataFrame, requirements: str = "requirements") -> DataFrame:
    """required / preferred / total per job and the first three required names."""
    req = F.coalesce(F.size(F.col(requirements)["required"]), F.lit(0)).cast("long")
    pref = F.coalesce(F.size(F.col(requirements)["preferred"]), F.lit(0)).cast("long")
    preview = F.array_join(F.slice(F.col(requirements)["required"]["skill_name"], 1, 3), ", ")
    return df.withColumns({"required_count": req, "preferred_count": pref, "total_count": req + pref,
                           "preview": preview, "extracted": req + pref > 0})


def extraction_status_counts(jobs_with_counts: DataFrame, *keys: str) -> DataFrame:
    return jobs_with_counts.groupBy(*keys).agg(F.count("*").alias("all_count"), F.count_if("extracted").alias("extracted_count"),
                                               F.count_if(~F.col("extracted")).alias("pending_count"))


def dashboard(resumes: DataFrame, jobs: DataFrame, analyses: DataFrame, latest: int = 5,
              score: Callable[[DataFrame], DataFrame] = lambda newest: newest) -> DataFrame:
    """Per tenant: entity totals and the rounded mean score of the newest analyses (null when none).

    ``score`` gives the newest rows their ``user_id`` and ``overall_score`` where ``analyses`` come without scores.
    """
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("analysis_id"))
    newest = analyses.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= latest).drop("_n")
    recent = (score(newest).groupBy("user_id").agg(js.round_half_up(F.avg("overall_score"), 0).cast("long").alias("latest_average")))
    count = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    tenants = resumes.select("user_id").union(jobs.select("user_id")).distinct()
    out = tenants
    for part in (count(resumes, "resume_count"), count(jobs, "job_count"), count(analyses, "analysis_count"), recent):
        out = out.join(part, "user_id", "left")
    return out.fillna(0, ["resume_count", "job_count", "analysis_count"])


def duplicate_keys(df: DataFrame, col: str) -> DataFrame:
    """Values that collide when case is ignored."""
    return (df.groupBy(F.lower(col).alias("folded")).agg(F.count("*").alias("copies"))
            .filter(F.col("copies") > 1))
