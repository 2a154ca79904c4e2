"""Resumes, jobs and applications derived from the star-schema tables.

The given tables hold no resumes, so these views write one document per
customer and one posting per part, with skills picked by key arithmetic; orders
joined to their line items say who applied where.  Every row of the base tables
takes part.  The text formulas are plain SQL that reads the same in Spark and
in the SQL oracle; ``pick`` is the only dialect-specific piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skilloom.functions import js
from skilloom.functions.taxonomy import SKILLS

SPELLINGS = [v for s in SKILLS for v in (s.name, *s.aliases)]
NL = "chr(10)"


def _lines(*parts: str) -> str:
    return f"concat_ws({NL}, {', '.join(parts)})"


def resume_text_sql(k: str, name: str, pick: Callable[[str], str]) -> str:
    """Resume text for customer key ``k``; some have no skills block, contact or education."""
    p = [pick(f"({k} * 7 + {i} * 29)") for i in range(10)]
    ks = f"cast({k} as string)"
    contact = (f"CASE {k} % 3 WHEN 1 THEN concat('user', {ks}, '@example.com') "
               f"WHEN 2 THEN concat('(555) 010-', lpad(cast({k} % 10000 as string), 4, '0')) END")
    skills = (f"CASE {k} % 5 WHEN 0 THEN concat('Technical Skills: ', {p[0]}, ', ', {p[1]}, ', ', {p[2]}, ', ', {p[3]}) "
              f"WHEN 1 THEN concat('SKILLS', {NL}, '- ', {p[0]}, {NL}, '- ', {p[1]}, {NL}, '- ', {p[2]}) "
              f"WHEN 2 THEN concat('Tech Stack:', {NL}, {p[0]}, ', ', {p[1]}, {NL}, {NL}, {p[2]}, ' / ', {p[3]}) "
              f"WHEN 3 THEN concat('Core Competencies: ', {p[0]}, '; ', {p[1]}) END")
    work = (f"CASE WHEN {k} % 7 <> 3 THEN concat(CASE WHEN {k} % 2 = 0 THEN 'Experience:' ELSE 'EXPERIENCE' END, {NL}, "
            f"'- Developed and tested services with ', {p[4]}, ' for 12 clients.', {NL}, "
            f"'- Improved ', {p[5]}, ' throughput by ', cast({k} % 90 as string), '%', {NL}, "
            f"'* Led a team using ', {p[6]}, ', ', {p[7]}, ' daily.') END")
    school = f"CASE WHEN {k} % 4 <> 1 THEN concat('Education:', {NL}, 'Bachelor degree, 2015') END"
    phrases = ["C programming and compilers", "Go developer since 2019", "wrote an R package", "take a rest",
               "REST endpoints", "Vitamin C daily", "RESTful apis", "the rest of C and C++ tools", "golang notes"]
    phrase = f"CASE {k} % 9 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(phrases)) + " END"
    projects = (f"CASE WHEN {k} % 6 <> 2 THEN concat('Projects:', {NL}, '- Built with ', {p[8]}, ', then ', {p[9]}, '.', "
                f"{NL}, 'Notes on ', {phrase}) END")
    prose = f"repeat('Planned delivery across teams with care. ', cast({k} % 300 as int))"
    return (f"CASE WHEN {k} % 23 = 13 THEN NULL WHEN {k} % 19 = 0 THEN '' "
            f"ELSE {_lines(name, contact, skills, work, school, projects, prose)} END")


def job_text_sql(k: str, pick: Callable[[str], str]) -> str:
    p = [pick(f"({k} * 11 + {i} * 17)") for i in range(6)]
    bullet = lambda *xs: ", ".join(f"{NL}, '- ', {x}" for x in xs)
    return (f"CASE WHEN {k} % 17 = 0 THEN 'General office work. No specialist tools needed here.' "
            f"WHEN {k} % 10 = 0 THEN concat('We want someone who knows ', {p[0]}, ', ', {p[1]}, ', and ', {p[2]}, ', every day.') "
            f"WHEN {k} % 7 = 3 THEN concat('Nice to have:', {bullet(p[0], p[1])}, {NL}, 'Requirements:', {bullet(p[0], p[2], p[3])}) "
            f"WHEN {k} % 7 = 5 THEN concat('Tech Stack: ', {p[0]}, ', ', {p[1]}, {NL}, 'Must have: ', {p[2]}, ', ', {p[3]}, {NL}, "
            f"'Bonus points: ', {p[3]}, ', ', {p[4]}) "
            f"ELSE concat('About the role', {NL}, 'Team of ', {p[5]}, ' people.', {NL}, 'Requirements:', "
            f"{bullet(p[0], p[1], p[2], p[3])}, {NL}, 'Preferred:', {bullet(p[3], p[4])}) END")


STATUS_SQL = ("CASE {k} % 23 WHEN 7 THEN 'PENDING' WHEN 11 THEN 'PROCESSING' WHEN 13 THEN 'FAILED' ELSE 'COMPLETED' END")


def _pick(i: str) -> str:
    return f"element_at(split({js.quote('|'.join(SPELLINGS))}, '[|]'), cast({i} % {len(SPELLINGS)} as int) + 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy text work when the input has too few splits.

    Large inputs already come in many splits and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a table from which one task makes texts.
ROWS_A_TASK = 20_000


def spread_rows(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """As :func:`spread`, for narrow rows that each give a text: more rows give more tasks, not longer ones."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resume_id, user_id, file_name, extraction_status, extracted_text."""
    k = "c_custkey"
    return spread_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")).select(
        F.col(k).alias("resume_id"), F.col("c_nationkey").alias("user_id"),
        F.concat(F.lit("resume_"), F.col(k).cast("string"), F.lit(".docx")).alias("file_name"),
        F.expr(STATUS_SQL.format(k=k)).alias("extraction_status"),
        F.expr(resume_text_sql(k, "c_name", _pick)).alias("extracted_text"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, user_id, title, description, created_at."""
    k = "p_partkey"
    return spread_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")).select(
        F.col(k).alias("job_id"), (F.col("p_size") % 25).alias("user_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.expr(job_text_sql(k, _pick)).alias("description"),
        F.expr(f"timestampadd(MINUTE, {k}, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("created_at"))


def application_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every application: resume_id, job_id, applied_at, order key and line (repeats possible)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return o.join(l, o.o_orderkey == l.l_orderkey).select(
        F.col("o_custkey").alias("resume_id"), F.col("l_partkey").alias("job_id"),
        F.col("o_orderdate").alias("applied_at"), F.col("o_orderkey").alias("event_key"),
        F.col("l_linenumber").alias("event_line"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (resume_id, job_id) with the first application date."""
    return (application_events(spark, sf_dir).groupBy("resume_id", "job_id")
            .agg(F.min("applied_at").alias("applied_at")))
