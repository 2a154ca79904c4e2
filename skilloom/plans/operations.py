"""Queries over events, stored tables and files: limits, attempts, retention, audits, ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from skilloom.functions.arrays import explode_structs
from skilloom.functions.taxonomy import SECOND_SEED, taxonomy_df
from skilloom.operators import lifecycle as lc, maintenance as mt, reports, requirements, scoring
from skilloom.oracle import base as o
from skilloom.plans.matching import _analyses
from skilloom.session import materialize
from skilloom.sources import feeds, files

DAY = 86_400


def range_request_count(spark: SparkSession, sf: str) -> DataFrame:
    ev = feeds.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return lc.range_counts(ev, "user_id", "ts", "event_id", DAY).select("event_id", "user_id", "requests")


def rate_limit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    # Every seventh user comes without an id; all of those share one log.
    ev = feeds.table(spark, sf, "events").selectExpr("event_id", "if(user_id % 7 = 0, null, user_id) AS user_id", "ts")
    return lc.rate_limit_decisions(ev, "user_id", "ts", "event_id", DAY, 3).select("event_id", "user_id", "accepted", "retry_after_seconds")


KIND = ("CASE event_type WHEN 'signup' THEN 'upload' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'claim' "
        "WHEN 'purchase' THEN 'complete' ELSE 'fail' END")
FAIL_CODE = "CASE WHEN event_id % 2 = 0 THEN 'EXTRACTION_TIMEOUT' ELSE 'CORRUPTED_DOCUMENT' END"


def attempt_events(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.expr(KIND).alias("kind"), lc.micros("ts").alias("us"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 3 + 1).alias("token"), F.expr(FAIL_CODE).alias("error_code"))


# The events of a user lie hours apart, so the limit on a running attempt is scaled to them.
STALE_MINUTES = 7 * 1440


def attempt_states(spark: SparkSession, sf: str) -> DataFrame:
    d = lc.attempt_states(attempt_events(spark, sf), stale_minutes=STALE_MINUTES)
    return d.select("doc_id", "status", F.col("attempts").cast("long").alias("attempts"), "error_code", "started_us", "finished_us",
                    lc.can_retry(F.col("status"), F.col("attempts")).alias("can_retry"))


AS_OF = 1_705_276_800_000_000  # 2024-01-15 00:00:00 UTC


def _at_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return lc.attempt_states(attempt_events(spark, sf), as_of_us=AS_OF)


def stale_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return lc.sweep_stale(_at_sweep(spark, sf), F.lit(AS_OF), STALE_MINUTES).select("doc_id", "status", "error_code", "finished_us")


def orphan_reset(spark: SparkSession, sf: str) -> DataFrame:
    return lc.reset_orphans(_at_sweep(spark, sf), F.lit(AS_OF)).select("doc_id", "status", "error_code", "finished_us")


def cooldown(spark: SparkSession, sf: str) -> DataFrame:
    ev = feeds.table(spark, sf, "events").filter(F.col("event_type") == "error")
    us = lc.micros("ts")
    return ev.select("event_id", lc.cooldown_seconds(us, us + (F.col("event_id") * 7919) % 12_000_000).alias("seconds"))


def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return reports.duplicate_keys(feeds.table(spark, sf, "part"), "p_name")


#: What the rules read of an analysis.
AUDITED = tuple(f for f, _, _ in mt.ANALYSIS_RULES.values())


def constraint_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = materialize(_analyses(spark, sf, items=("status", "similarity_score", "confidence")).select(*AUDITED, "items"), "analyses")
    return (mt.audit(a, mt.analysis_rules())
            .unionByName(mt.audit(scoring.explode_items(a), mt.item_rules()))
            .unionByName(mt.audit(feeds.jobs(spark, sf), mt.job_rules()))
            .unionByName(mt.audit(feeds.table(spark, sf, "documents"), {"text_20_2000": mt.length_between("text", 20, 2000)})))


# Stored records as an audit meets them: the tables' own values fall on both sides of every bound, some are missing.
STORED_RESUME = {"extraction_status": "CASE c_custkey % 9 WHEN 0 THEN 'completed' WHEN 1 THEN NULL WHEN 2 THEN 'FAILED' ELSE 'COMPLETED' END",
                 "file_size": "CASE WHEN c_custkey % 5 <> 0 THEN cast(floor(c_acctbal) AS bigint) END",
                 "processing_attempts": "CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey - 2 END"}
STORED_ITEM = {"status": "CASE l_linenumber WHEN 1 THEN 'MATCHED' WHEN 2 THEN 'MISSING' WHEN 3 THEN 'PARTIAL' WHEN 4 THEN 'matched' END",
               "similarity_score": "CASE WHEN l_linenumber < 6 THEN cast(l_quantity AS double) * 2.5 - 5 END",
               "confidence": "CASE WHEN l_linenumber < 7 THEN cast(l_discount AS double) * 16 END"}
STORED_ANALYSIS = {f: f"CASE WHEN o_orderkey % 50 <> {i} THEN cast(o_totalprice AS double) / {1000 * (i + 3)} - {i} END"
                   for i, (f, _, _) in enumerate(mt.ANALYSIS_RULES.values())}
STORED_JOB = {"title": "CASE WHEN p_size % 7 <> 0 THEN repeat(p_name, cast(p_size % 20 AS int)) END",
              "description": "CASE WHEN p_size % 10 <> 0 THEN repeat(p_brand, cast(p_size * (p_partkey % 200) AS int)) END"}


def stored_record_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Range, enum and length rules over stored records, with the number of rows that break each."""
    def rows(name: str, fields: dict[str, str]) -> DataFrame:
        return feeds.table(spark, sf, name).select(*[F.expr(e).alias(c) for c, e in fields.items()])

    return (mt.audit(rows("customer", STORED_RESUME), mt.resume_rules()).unionByName(mt.audit(rows("lineitem", STORED_ITEM), mt.item_rules()))
            .unionByName(mt.audit(rows("orders", STORED_ANALYSIS), mt.analysis_rules())).unionByName(mt.audit(rows("part", STORED_JOB), mt.job_rules())))


def metadata_backfill(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    d = feeds.table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 2 == 0, k).alias("file_size"), F.when(k % 3 == 0, "application/pdf").alias("mime_type"),
        F.when(k % 5 == 0, k % 4).alias("processing_attempts"))
    return mt.backfill(d)


def _parents(spark: SparkSession, sf: str) -> DataFrame:
    return _analyses(spark, sf).select("analysis_id", "user_id", "resume_id", "job_id", "resume_file_name", "job_title", "overall_score")


def retention_resume_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = feeds.table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("resume_id"))
    return mt.detach_deleted(_parents(spark, sf), gone, "resume_id")


def retention_job_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = feeds.table(spark, sf, "part").filter(F.col("p_size") <= 10).select(F.col("p_partkey").alias("job_id"))
    return mt.detach_deleted(_parents(spark, sf), gone, "job_id")


def retention_user_delete(spark: SparkSession, sf: str) -> DataFrame:
    a = materialize(_analyses(spark, sf, items=("skill_name",)).select("user_id", "analysis_id", "items"), "analyses")
    users = feeds.table(spark, sf, "nation").select(F.col("n_nationkey").alias("user_id"), "n_regionkey")
    left = mt.cascade_user_delete(users, feeds.resumes(spark, sf), feeds.jobs(spark, sf), a.drop("items"), scoring.explode_items(a, "analysis_id"),
                                  users.filter(F.col("n_regionkey") == 1))
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("kept")).select(F.lit(name).alias("entity"), "kept")
        out = row if out is None else out.unionByName(row)
    return out


def retention_analysis_delete(spark: SparkSession, sf: str) -> DataFrame:
    a = _analyses(spark, sf).select("analysis_id", "overall_score", F.col("total_job_skills").alias("items"))
    return mt.delete_where(a, F.col("overall_score") < 20)


def catalog_delete_blockers(spark: SparkSession, sf: str) -> DataFrame:
    items = scoring.skills_in_use(feeds.application_events(spark, sf), feeds.resumes(spark, sf), feeds.jobs(spark, sf))
    return mt.catalog_delete_blockers(taxonomy_df(spark).select("skill_name"), items)


def catalog_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base = taxonomy_df(spark).filter(~F.col("skill_name").isin(*SECOND_SEED)).select("skill_name", "category")
    parts = feeds.table(spark, sf, "part").select(F.initcap("p_name").alias("skill_name"), F.lit("Part").alias("category"))
    again = taxonomy_df(spark).select(F.upper("skill_name").alias("skill_name"), "category")
    return mt.catalog_insert_missing(base, parts.unionByName(again))


def job_upsert(spark: SparkSession, sf: str) -> DataFrame:
    jobs = feeds.jobs(spark, sf)
    current = requirements.with_requirements(jobs, "description").select("job_id", "title", "description", "requirements")
    k = F.col("p_partkey")
    updates = feeds.table(spark, sf, "part").filter(F.col("p_size") > 10).select(
        k.alias("job_id"), F.when(k % 2 == 0, F.concat(F.lit("  New   "), "p_name")).alias("title"),
        F.when(k % 3 == 0, F.lit("Requirements:\n- Rust\n- Kotlin\nPreferred:\n- Redis")).alias("description"))
    d = reports.job_skill_counts(mt.job_upsert(current, updates))
    return d.select("job_id", "title", "required_count", "preferred_count", "re_extracted")


def json_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = feeds.table(spark, sf, "events").select("event_id", "props", "user_id")
    doc = mt.json_set(F.col("props"), "profile", F.to_json(F.struct(F.col("event_id").alias("id"))))
    doc = mt.json_set_nested(doc, "jobs", F.col("user_id").cast("string"), F.to_json(F.struct(F.lit(1).alias("v"))))
    return d.select("event_id", F.get_json_object(doc, "$.k").cast("long").alias("k"),
                    F.get_json_object(doc, "$.profile.id").cast("long").alias("profile_id"),
                    F.size(F.json_object_keys(doc)).cast("long").alias("n_keys"), F.json_object_keys(F.get_json_object(doc, "$.jobs"))[0].alias("job_key"))


# --- ingest: DOCX files built from the documents, then read back -------------

def _docx_files(spark: SparkSession, sf: str) -> DataFrame:
    """One DOCX archive per document; a line is a paragraph.  A seventh are damaged on purpose."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile
        from xml.sax.saxutils import escape
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        for pdf in batches:
            blobs = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("[Content_Types].xml", "<Types/>")
                    z.writestr("word/document2.xml" if doc_id % 7 == 3 else "word/document.xml",
                               f"<w:document {ns}><w:body>{body}</w:body></w:document>")
                blobs.append(buf.getvalue())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": blobs})

    docs = feeds.table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("text"))
    return feeds.spread(docs).mapInPandas(build, "doc_id bigint, content binary")


def docx_text(spark: SparkSession, sf: str) -> DataFrame:
    return files.docx_text(_docx_files(spark, sf), "doc_id").select("doc_id", "text", "error_code")


NAME = "concat('up/load: ', cast(doc_id as string), CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.docx' ELSE '.txt' END)"


def file_admission(spark: SparkSession, sf: str) -> DataFrame:
    mime = F.when(F.col("doc_id") % 8 == 2, "text/plain").otherwise(files.MIME_BY_EXTENSION[".docx"])
    mime = F.when(F.col("doc_id") % 4 == 0, files.MIME_BY_EXTENSION[".pdf"]).otherwise(mime)
    d = _docx_files(spark, sf).withColumn("name", F.expr(NAME))
    return d.select("doc_id", files.admission_code(F.col("name"), F.col("content"), mime).alias("code"),
                    files.display_name(F.col("name")).alias("display_name"), (F.length(files.content_hash(F.col("content"))) == 64).alias("hashed"))


def content_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a plain file: the hash of its bytes."""
    docs = feeds.table(spark, sf, "documents")
    return docs.select("doc_id", files.content_hash(F.encode("text", "UTF-8")).alias("content_sha256"))


QUERIES = {f.__name__: f for f in (
    range_request_count, rate_limit_decisions, attempt_states, stale_attempts, orphan_reset, cooldown, duplicate_names, constraint_audit, stored_record_audit,
    metadata_backfill, retention_resume_delete, retention_job_delete, retention_user_delete, retention_analysis_delete, catalog_delete_blockers, catalog_upsert,
    job_upsert, json_merge, docx_text, file_admission, content_fingerprints)}

# --- SQL twins ---------------------------------------------------------------

_M = o.match_ctes()
_ID = o.ANALYSIS_ID


def _attempt_rounds(limit_us: int | None, until: str = "TRUE") -> list[str]:
    """CTEs ending in ``s6``: the state after three claims and outcomes; running attempts fail after ``limit_us``."""
    due, over = ("TRUE", "FALSE") if limit_us is None else (f"e.us <= s.started + {limit_us}", "x IS NULL AND status = 'PROCESSING' AND n = {i}")
    stop = f"started + {limit_us or 0}"
    out = [f"e AS (SELECT user_id AS d, {KIND} AS kind, epoch_us(ts) AS us, event_id AS seq, event_id % 3 + 1 AS token, {FAIL_CODE} AS err FROM events WHERE {until})",
           "s0 AS (SELECT d, min((us, seq))  AS pt, 'PENDING' AS status, 0 AS n, NULL::varchar AS err, NULL::bigint AS started, NULL::bigint AS ended FROM e WHERE kind = 'upload' GROUP BY d)"]
    for i in (1, 2, 3):
        out.append(f"""a{i} AS (SELECT s.*, (SELECT min((e.us, e.seq)) FROM e WHERE e.d = s.d AND e.kind = 'claim' AND s.status IN ('PENDING', 'FAILED') AND s.n = {i - 1}
          AND (e.us, e.seq) > s.pt AND (coalesce(s.err, '') <> 'EXTRACTION_TIMEOUT' OR e.us >= s.ended + 10000000)) AS c FROM s{2 * i - 2} s)""")
        out.append(f"""s{2 * i - 1} AS (SELECT d, coalesce(c, pt)  AS pt, CASE WHEN c IS NULL THEN status ELSE 'PROCESSING' END AS status, CASE WHEN c IS NULL THEN n ELSE {i} END AS n,
          CASE WHEN c IS NULL THEN err END AS err, CASE WHEN c IS NULL THEN started ELSE c[1] END AS started, CASE WHEN c IS NULL THEN ended END AS ended FROM a{i})""")
        out.append(f"""b{i} AS (SELECT s.*, (SELECT min((e.us, e.seq, e.kind, e.err)) FROM e WHERE e.d = s.d AND e.kind IN ('complete', 'fail') AND s.status = 'PROCESSING' AND s.n = {i}
          AND e.token = {i} AND {due} AND (e.us, e.seq) > s.pt) AS x FROM s{2 * i - 1} s)""")
        late = over.replace("{i}", str(i))
        out.append(f"""s{2 * i} AS (SELECT d, CASE WHEN {late} THEN ({stop}, {2**63 - 1}) WHEN x IS NULL THEN pt ELSE (x[1], x[2]) END AS pt,
          CASE WHEN {late} THEN 'FAILED' WHEN x IS NULL THEN status WHEN x[3] = 'complete' THEN 'COMPLETED' ELSE 'FAILED' END AS status, n,
          CASE WHEN {late} THEN '{lc.STALE_CODE}' WHEN x[3] = 'fail' THEN x[4] WHEN x IS NULL THEN err END AS err, started,
          CASE WHEN {late} THEN {stop} WHEN x IS NULL THEN ended ELSE x[1] END AS ended FROM b{i})""")
    return out


def _swept(which: str, code: str) -> str:
    return o.with_(*_attempt_rounds(None, f"epoch_us(ts) <= {AS_OF}"), f"st AS (SELECT *, status = 'PROCESSING' AND ({which}) AS swept FROM s6)") + f"""
      SELECT d AS doc_id, CASE WHEN swept THEN 'FAILED' ELSE status END AS status, CASE WHEN swept THEN '{code}' ELSE err END AS error_code,
      CASE WHEN swept THEN {AS_OF}::bigint ELSE ended END AS finished_us FROM st"""


_DOCX_TEXT = r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(text, chr(10), chr(10) || chr(10))), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '" \
             + f"[{o.WS.replace(chr(92) + 't', '').replace(chr(92) + 'n', '')}]+', ' ', 'g'), '(?m)[ " + r"\t]+$', '', 'g')"

ORACLES = {
    "range_request_count": f"""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
      RANGE BETWEEN {DAY * lc.SECOND - 1} PRECEDING AND CURRENT ROW) AS requests FROM events""",
    "rate_limit_decisions": f"""WITH RECURSIVE e AS (SELECT event_id, u AS user_id, coalesce(u::VARCHAR, '') AS who, us,
        row_number() OVER (PARTITION BY u ORDER BY us, event_id) AS n FROM (SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN user_id END AS u, epoch_us(ts) AS us FROM events)),
      f AS (SELECT 0::BIGINT AS n, who, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, []::BIGINT[] AS log, TRUE AS accepted, NULL::BIGINT AS retry FROM (SELECT DISTINCT who FROM e)
        UNION ALL SELECT n, who, event_id, user_id, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END, len(live) < 3,
          CASE WHEN len(live) >= 3 THEN greatest(1, (live[1] + {DAY * lc.SECOND} - us + 999999) // 1000000) END
        FROM (SELECT e.n, e.who, e.event_id, e.user_id, e.us, list_filter(f.log, lambda t: t > e.us - {DAY * lc.SECOND}) AS live FROM f JOIN e ON e.who = f.who AND e.n = f.n + 1))
      SELECT event_id, user_id, accepted, retry AS retry_after_seconds FROM f WHERE n > 0""",
    "attempt_states": o.with_(*_attempt_rounds(STALE_MINUTES * 60 * lc.SECOND)) + """SELECT d AS doc_id, status, n::bigint AS attempts, err AS error_code, started AS started_us, ended AS finished_us,
      n < 3 AND status <> 'COMPLETED' AS can_retry FROM s6""",
    "stale_attempts": _swept(f"started < {AS_OF} - {STALE_MINUTES * 60 * lc.SECOND}", lc.STALE_CODE),
    "orphan_reset": _swept("TRUE", lc.RESTART_CODE),
    "cooldown": "SELECT event_id, cast(ceil(greatest(0, 10000000 - (event_id * 7919) % 12000000) / 1000000.0) as bigint) AS seconds FROM events WHERE event_type = 'error'",
    "duplicate_names": "SELECT lower(p_name) AS folded, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1",
    "constraint_audit": "SELECT rule, 0::bigint AS violations FROM (VALUES " + ", ".join(
        f"('{r}')" for r in [*mt.ANALYSIS_RULES, "status_enum", "similarity_0_100", "confidence_0_1", "title_3_255", "description_20_50000"])
        + f") t(rule) UNION ALL SELECT 'text_20_2000', count(*) FROM documents WHERE NOT (length({o.trim('text')}) BETWEEN 20 AND 2000)",
    "stored_record_audit": " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {broken}) AS violations FROM (SELECT {', '.join(f'{e} AS {c}' for c, e in fields.items())} FROM {name})"
        for name, fields, rule, broken in (
            ("customer", STORED_RESUME, "extraction_status_enum", "extraction_status IS NULL OR extraction_status = 'completed'"),
            ("customer", STORED_RESUME, "file_size_min_0", "file_size < 0"),
            ("customer", STORED_RESUME, "processing_attempts_min_0", "processing_attempts IS NULL OR processing_attempts < 0"),
            ("lineitem", STORED_ITEM, "status_enum", "status IS NULL OR status = 'matched'"),
            ("lineitem", STORED_ITEM, "similarity_0_100", "similarity_score < 0 OR similarity_score > 100"),
            ("lineitem", STORED_ITEM, "confidence_0_1", "confidence IS NULL OR confidence < 0 OR confidence > 1"),
            *(("orders", STORED_ANALYSIS, r, f"{c} IS NULL OR {c} < 0 OR {c} > 100") for r, (c, _, _) in mt.ANALYSIS_RULES.items()),
            ("part", STORED_JOB, "title_3_255", f"title IS NULL OR length({o.trim('title')}) < 3 OR length({o.trim('title')}) > 255"),
            ("part", STORED_JOB, "description_20_50000",
             f"description IS NULL OR length({o.trim('description')}) < 20 OR length({o.trim('description')}) > 50000"))),
    "metadata_backfill": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS file_size,
      CASE WHEN c_custkey % 3 = 0 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type,
      CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 ELSE 0 END AS processing_attempts FROM customer""",
    "retention_resume_delete": o.with_(*_M) + f"""SELECT {_ID.replace('job_id', 's.job_id')} AS analysis_id, s.user_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE resume_id END AS resume_id,
      s.job_id, file_name AS resume_file_name, title AS job_title, overall_score FROM v_scores s JOIN v_jobs j ON j.job_id = s.job_id JOIN customer ON c_custkey = resume_id""",
    "retention_job_delete": o.with_(*_M) + f"""SELECT {_ID.replace('job_id', 's.job_id')} AS analysis_id, s.user_id, resume_id,
      CASE WHEN p_size <= 10 THEN NULL ELSE s.job_id END AS job_id, file_name AS resume_file_name, title AS job_title, overall_score
      FROM v_scores s JOIN v_jobs j ON j.job_id = s.job_id JOIN part ON p_partkey = s.job_id""",
    "retention_user_delete": o.with_(*_M, "gone AS (SELECT n_nationkey AS user_id FROM nation WHERE n_regionkey = 1)") + """
      SELECT 'users' AS entity, count(*) AS kept FROM nation WHERE n_regionkey <> 1
      UNION ALL SELECT 'resumes', count(*) FROM v_resumes WHERE user_id NOT IN (SELECT user_id FROM gone)
      UNION ALL SELECT 'jobs', count(*) FROM v_jobs WHERE user_id NOT IN (SELECT user_id FROM gone)
      UNION ALL SELECT 'analyses', count(*) FROM v_scores WHERE user_id NOT IN (SELECT user_id FROM gone)
      UNION ALL SELECT 'items', count(*) FROM v_items WHERE user_id NOT IN (SELECT user_id FROM gone)""",
    "retention_analysis_delete": o.with_(*_M) + f"SELECT {_ID} AS analysis_id, overall_score, total AS items FROM v_scores WHERE overall_score >= 20",
    "catalog_delete_blockers": o.with_(*_M) + "SELECT DISTINCT skill_name FROM v_items",
    "catalog_upsert": o.with_(o.TAXONOMY) + f"""SELECT skill_name, category FROM v_taxonomy WHERE skill_name NOT IN ({', '.join(map(o.lit, SECOND_SEED))})
      UNION ALL SELECT upper(skill_name), category FROM v_taxonomy WHERE skill_name IN ({', '.join(map(o.lit, SECOND_SEED))})
      UNION ALL SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), 'Part' FROM part""",
    "job_upsert": o.with_(o.JOBS, *o.requirements_of("v_jobs", "job_id", "description", "j"),
        "q AS (SELECT key, count(*) FILTER (WHERE bucket = 'R') AS r, count(*) FILTER (WHERE bucket = 'P') AS p FROM j_req GROUP BY key)") + """
      SELECT job_id, CASE WHEN p_size > 10 AND job_id % 2 = 0 THEN 'New ' || p_name ELSE title END AS title,
        CASE WHEN p_size > 10 AND job_id % 3 = 0 THEN 2 ELSE coalesce(r, 0) END AS required_count,
        CASE WHEN p_size > 10 AND job_id % 3 = 0 THEN 1 ELSE coalesce(p, 0) END AS preferred_count, p_size > 10 AND job_id % 3 = 0 AS re_extracted
      FROM v_jobs JOIN part ON p_partkey = job_id LEFT JOIN q ON q.key = job_id""",
    "json_merge": """SELECT event_id, (props::json->>'k')::bigint AS k, event_id AS profile_id, 2 + len(json_keys(props::json)) AS n_keys,
      user_id::varchar AS job_key FROM events""",
    "docx_text": f"""WITH t AS (SELECT doc_id, {o.trim(f"regexp_replace({_DOCX_TEXT}, '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM documents)
      SELECT doc_id, CASE WHEN doc_id % 7 <> 3 AND length(regexp_replace(text, '{o.S}', '', 'g')) >= 20 THEN text END AS text,
        CASE WHEN doc_id % 7 = 3 THEN 'CORRUPTED_DOCUMENT' WHEN length(regexp_replace(text, '{o.S}', '', 'g')) < 20 THEN 'NO_READABLE_TEXT' END AS error_code FROM t""",
    "file_admission": """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'UNSUPPORTED_EXTENSION' WHEN doc_id % 8 = 2 THEN 'MIME_MISMATCH'
        WHEN doc_id % 4 = 0 THEN 'MAGIC_MISMATCH' END AS code, 'load_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.docx' ELSE '.txt' END AS display_name,
        TRUE AS hashed FROM documents""",
    "content_fingerprints": "SELECT doc_id, sha256(text) AS content_sha256 FROM documents",
}
