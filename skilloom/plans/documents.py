"""Queries over free text: quality, redaction, clean-up, readability, hashing, term matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skilloom.functions import js, pii, text as text_fn
from skilloom.operators import quality, skills, terms
from skilloom.functions.arrays import explode_structs
from skilloom.oracle import base as o, quality as oq
from skilloom.sources import feeds


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.spread(feeds.table(spark, sf, "documents").select("doc_id", "text"))


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    res = feeds.resumes(spark, sf).select(F.concat(F.lit("r"), F.col("resume_id").cast("string")).alias("id"),
                                          F.col("extracted_text").alias("text"))
    d = quality.with_quality_report(docs.unionByName(res), "text")
    return d.select("id", *quality.FEATURES, "quality_score")


def quality_deductions(spark: SparkSession, sf: str) -> DataFrame:
    d = quality.with_quality_report(_documents(spark, sf), "text")
    return explode_structs(d, "deductions", "doc_id").select("doc_id", "rule", "deduction")


def quality_strengths(spark: SparkSession, sf: str) -> DataFrame:
    d = quality.with_quality_report(feeds.resumes(spark, sf), "extracted_text")
    return (d.select("resume_id", F.explode_outer("strengths").alias("strength")).filter(F.col("strength").isNotNull()))


def pii_redacted_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", pii.redact("text").alias("redacted"))


def pii_redacted_pages(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.table(spark, sf, "pages").select("page_id", pii.redact("html").alias("redacted"))


ADDRESS = "concat(cast(c_custkey % 900 + 1 as string), ' Elm Street, Springfield')"
POSTCODE = "cast(10000 + c_custkey % 80000 as string)"


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    return feeds.table(spark, sf, "customer").select("c_custkey", F.struct(
        F.col("c_name").alias("name"), F.concat(F.lit("user"), k, F.lit("@example.com")).alias("email"),
        F.struct(F.expr(ADDRESS).alias("street"), F.expr(POSTCODE).alias("postal_code")).alias("home"),
        F.array(F.concat(F.lit("call (555) 010-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")),
                F.concat(F.lit("lives at "), F.expr(ADDRESS))).alias("notes")).alias("contact"))


def pii_redacted_records(spark: SparkSession, sf: str) -> DataFrame:
    d = pii.redact_columns(_contacts(spark, sf), "contact")
    return d.select("c_custkey", "contact.name", "contact.email", F.col("contact.home.street").alias("street"),
                    F.col("contact.home.postal_code").alias("postal_code"),
                    F.array_join("contact.notes", "; ").alias("notes"))


def pii_redacted_json(spark: SparkSession, sf: str) -> DataFrame:
    return _contacts(spark, sf).select("c_custkey", pii.redact_json(F.to_json("contact")).alias("redacted"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", text_fn.clean_text("text").alias("cleaned"))


def clean_titles(spark: SparkSession, sf: str) -> DataFrame:
    d = feeds.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" \t\n "), "p_brand", F.lit(" ")).alias("t"))
    return d.select("p_partkey", text_fn.clean_title("t").alias("title"), text_fn.slug("t").alias("slug"))


def readability_check(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    d = _documents(spark, sf).unionByName(feeds.table(spark, sf, "conversations").select(
        (-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("doc_id"), "text"))
    return d.select("doc_id", text_fn.readability_code("text").alias("error_code"),
                    js.utf16_length(t).alias("character_count"), js.word_count(t).cast("long").alias("word_count"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", text_fn.sha256("text").alias("text_hash"),
                                        text_fn.sha256(text_fn.normalize_for_match("text")).alias("normalized_hash"))


def rest_word_precision(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    rest = tuple(s for s in skills.SKILLS if s.name == "REST APIs")
    block = skills.with_skills(d, "text", "as_block", skills=rest, override=True)
    both = skills.with_skills(block, "text", "as_prose", skills=rest, override=False)
    has = lambda c: F.exists(c, lambda s: s["skill_name"] == "REST APIs")
    return both.select("doc_id", has("as_block").alias("hit_in_skills_block"), has("as_prose").alias("hit_in_prose"))


def document_skills(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Skills:\n"), F.col("text"))
    d = skills.with_skills(_documents(spark, sf).withColumn("text", text), "text")
    return skills.explode_skills(d, "doc_id").select("doc_id", "skill_name", "token", "match_type", "score", "evidence")


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every benchmark item, alone and followed by an article."""
    words = feeds.table(spark, sf, "benchmark").select(F.explode_outer(F.split(F.lower("text"), "[^a-z]+")).alias("name"))
    return words.filter(F.col("name") != "").distinct().select(
        "name", F.lit("Term").alias("category"), F.array(F.concat("name", F.lit(" the"))).alias("aliases"))


def term_matches_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    return terms.match_terms(_documents(spark, sf), "doc_id", "text", _terms(spark, sf), most_pieces=2)


QUERIES = {f.__name__: f for f in (
    quality_report, quality_deductions, quality_strengths, pii_redacted_documents, pii_redacted_pages,
    pii_redacted_records, pii_redacted_json, clean_text, clean_titles, readability_check, content_hashes,
    rest_word_precision, document_skills, term_matches_in_documents)}


# --- SQL twins ---------------------------------------------------------------

def redact_sql(e: str) -> str:
    for pattern, tag in pii.REDACTIONS:
        e = f"regexp_replace({e}, '{pii.render(pattern, o.WS, chr(92) + 'b', chr(92) + 'b', chr(92) + 'b')}', '{tag}', 'g')"
    return e


_RULES = [*[(f"NOT {f}", rule, pts) for f, rule, pts, _, _ in quality.SECTION_RULES],
          *[(f"word_count_status = '{s}'", r[0], r[1]) for s, r in quality.LENGTH_RULES.items()],
          ("bullet_points_count < 3", quality.BULLET_RULE[0], 10.0), ("action_verbs_count < 3", quality.VERB_RULE[0], 10.0),
          ("quantifiable_metrics_count = 0", "METRICS_ZERO", 15.0), ("quantifiable_metrics_count IN (1, 2)", "METRICS_SPARSE", 5.0)]
_SCORE = "greatest(0.0::double, 100.0::double - (" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, _, p in _RULES) + ")::double)"


def _strengths_sql() -> str:
    rows = [f"SELECT resume_id, {o.lit(s)} AS strength FROM f WHERE {flag}" for flag, _, _, _, s in quality.SECTION_RULES]
    for (a, b), col, cond in ((quality.OPTIMAL_STRENGTH, "word_count", "word_count_status = 'OPTIMAL'"),
                              (quality.BULLET_STRENGTH, "bullet_points_count", "bullet_points_count >= 3"),
                              (quality.VERB_STRENGTH, "action_verbs_count", "action_verbs_count >= 3"),
                              (quality.METRIC_STRENGTH, "quantifiable_metrics_count", "quantifiable_metrics_count >= 3")):
        rows.append(f"SELECT resume_id, {o.lit(a)} || {col} || {o.lit(b)} FROM f WHERE {cond}")
    return " UNION ALL ".join(rows)


_BLANKS = o.WS.replace(r"\t", "").replace(r"\n", "")
_CLEAN = "nfc_normalize(text)"
for _p, _r in ((r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "''"), (r"\r\n?", "chr(10)"), (f"[{_BLANKS}]+", "' '"),
               (f"(?m)[{_BLANKS}\\t]+$", "''"), (r"\n{3,}", "chr(10) || chr(10)")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', {_r}, 'g')"
_CLEAN = o.trim(_CLEAN)
_UNITS = "(length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"
_CUT = f"[{o.WS},;:(/\\[{{<>\"''`)\\]}}!?.]+"
_BLOCK_DOCS = "v_d AS (SELECT doc_id, 'Skills:' || chr(10) || text AS text FROM documents)"

ORACLES = {
    "quality_report": o.with_("v AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'r' || resume_id, extracted_text FROM v_resumes)",
                              *oq.features("v", "id", "text", "f")).replace("WITH ", f"WITH {o.RESUMES},\n", 1) + f"""
      SELECT v.id, CASE WHEN f.id IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS quality_status,
        f.* EXCLUDE (id), CASE WHEN f.id IS NOT NULL THEN {_SCORE} END AS quality_score FROM v LEFT JOIN f ON f.id = v.id""",
    "quality_deductions": o.with_(*oq.features("documents", "doc_id", "text", "f")) + " UNION ALL ".join(
        f"SELECT doc_id, '{r}' AS rule, {p}::double AS deduction FROM f WHERE {c}" for c, r, p in _RULES),
    "quality_strengths": o.with_(o.RESUMES, *oq.features("v_resumes", "resume_id", "extracted_text", "f")) + _strengths_sql(),
    "pii_redacted_documents": f"SELECT doc_id, {redact_sql('text')} AS redacted FROM documents",
    "pii_redacted_pages": f"SELECT page_id, {redact_sql('html')} AS redacted FROM pages",
    "pii_redacted_records": f"""SELECT c_custkey, {redact_sql('c_name')} AS name, '[EMAIL_REDACTED]' AS email, '[ADDRESS_REDACTED]' AS street,
      '[POSTAL_REDACTED]' AS postal_code, {redact_sql("'call (555) 010-' || lpad((c_custkey % 10000)::varchar, 4, '0')")} || '; ' ||
      {redact_sql(f"'lives at ' || {ADDRESS}")} AS notes FROM customer""",
    "pii_redacted_json": f"""SELECT c_custkey, '{{"name":"' || {redact_sql('c_name')} || '","email":"[EMAIL_REDACTED]","home":{{"street":"[ADDRESS_REDACTED]","postal_code":"[POSTAL_REDACTED]"}},"notes":["'
      || {redact_sql("'call (555) 010-' || lpad((c_custkey % 10000)::varchar, 4, '0')")} || '","' || {redact_sql(f"'lives at ' || {ADDRESS}")} || '"]}}' AS redacted FROM customer""",
    "clean_text": f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents",
    "clean_titles": """SELECT p_partkey, p_name || ' ' || p_brand AS title,
      regexp_replace(lower(p_name || '_' || p_brand), '[^a-z0-9]+', '_', 'g') AS slug FROM part""",
    "readability_check": f"""SELECT doc_id, CASE WHEN text IS NULL OR {_UNITS.format("regexp_replace(text, '" + o.S + "', '', 'g')")} < 20 THEN 'NO_READABLE_TEXT'
        WHEN {_UNITS.format('text')} > 500000 THEN 'TEXT_LIMIT_EXCEEDED' END AS error_code,
        {_UNITS.format('text')} AS character_count, len(regexp_extract_all(text, '[^{o.WS}]+')) AS word_count
      FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -conv_id * 1000 - turn - 1, text FROM conversations)""",
    "content_hashes": f"SELECT doc_id, sha256(text) AS text_hash, sha256({o.norm('text')}) AS normalized_hash FROM documents",
    "rest_word_precision": f"""SELECT doc_id, regexp_matches(text, '(?i){o.LEFT}(?:RESTful(?:{o.S}*APIs?)?|REST{o.S}+APIs?|REST){o.RIGHT}') AS hit_in_skills_block,
        CASE WHEN regexp_matches(text, '(?i)^{o._STRIP}(?:{o._cues(o.SKILLS_CUES)})')
             THEN regexp_matches(text, '(?i){o.LEFT}REST{o.RIGHT}') ELSE FALSE END
        OR regexp_matches(text, '{o.LEFT}(?:(?i:RESTful(?:{o.S}*APIs?)?|REST{o.S}+APIs?)|REST){o.RIGHT}') AS hit_in_prose FROM documents""",
    "document_skills": o.with_(_BLOCK_DOCS, o.TAXONOMY, *o.skills_of("v_d", "doc_id", "text", "d")) + """
      SELECT key AS doc_id, skill_name, token, match_type, score, header || ': ' || token AS evidence FROM d_skills JOIN v_taxonomy USING (skill_pos)""",
    "term_matches_in_documents": o.with_("t AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS name FROM benchmark)",
        "c AS (SELECT doc_id, chr(10) || text || chr(10) AS x FROM documents)",
        f"p AS (SELECT doc_id, string_split_regex(x, '{_CUT}') AS w, regexp_extract_all(x, '{_CUT}') AS g FROM c)",
        "q AS (SELECT doc_id, unnest(w) AS w, unnest(w[2:]) AS w2, generate_subscripts(w, 1) AS i, unnest(list_concat([NULL], g)) AS g0, unnest(g) AS g1, unnest(g[2:]) AS g2 FROM p)",
        f"v AS (SELECT *, g0[-1:] NOT IN ('.', ')', ']', '}}', '!', '?') AS l, g1[1:1] NOT IN ('(', '[', '{{') AS r, g1 = ' ' AND lower(w2) = 'the' AND g2[1:1] NOT IN ('(', '[', '{{') AS a FROM q WHERE w <> '')",
        "k AS (SELECT doc_id, lower(w) AS name, min(i) AS i FROM v WHERE l AND (r OR a) GROUP BY ALL)") + """
      SELECT doc_id, name AS term, CASE WHEN a THEN w || ' ' || w2 ELSE w END AS token, CASE WHEN a THEN 'ALIAS' ELSE 'EXACT' END AS match_type
      FROM k JOIN t USING (name) JOIN v USING (doc_id, i)""",
}
