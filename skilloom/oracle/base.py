"""DuckDB building blocks for the reference results.

Written line by line (unnest, running sums, plain patterns) rather than from
the Spark expressions, so the two sides can disagree when one is wrong.
"""

from __future__ import annotations

from skilloom.functions.taxonomy import (BARE_HEADER_WORDS, PREFERRED_CUES, REQUIRED_CUES, SECOND_SEED, SKILLS,
                                         SKILLS_CUES)
from skilloom.sources.feeds import SPELLINGS, STATUS_SQL, job_text_sql, resume_text_sql

WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
S = f"[{WS}]"
LEFT = f"(?:^|[{WS},;:(/\\[{{<>\"''`])"
RIGHT = f"(?:$|[{WS},;:)/\\[\\]}}<>\"''`!?.])"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(e: str) -> str:
    return f"regexp_replace({e}, '^{S}+|{S}+$', '', 'g')"


def norm(e: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({e}, '')), '{S}+', ' ', 'g'))"


def round_js(e: str, digits: int, eps: bool = False) -> str:
    k = float(10 ** digits)
    x = f"(({e}) + 2.220446049250313e-16)" if eps else f"({e})"
    return f"floor({x} * {k} + 0.5) / {k}"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _pick(i: str) -> str:
    return f"list_extract([{', '.join(lit(v) for v in SPELLINGS)}], cast({i} % {len(SPELLINGS)} as int) + 1)"


RESUMES = f"""v_resumes AS (
  SELECT c_custkey AS resume_id, c_nationkey AS user_id, concat('resume_', c_custkey, '.docx') AS file_name,
         {STATUS_SQL.format(k='c_custkey')} AS extraction_status,
         {resume_text_sql('c_custkey', 'c_name', _pick)} AS extracted_text
  FROM customer)"""

JOBS = f"""v_jobs AS (
  SELECT p_partkey AS job_id, p_size % 25 AS user_id, concat_ws(' ', p_name, p_brand) AS title,
         {job_text_sql('p_partkey', _pick)} AS description,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) AS created_at
  FROM part)"""

APPLICATIONS = """v_applications AS (
  SELECT o_custkey AS resume_id, l_partkey AS job_id, min(o_orderdate) AS applied_at
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""

_NAMES = {s.name: i for i, s in enumerate(SKILLS)}
TAXONOMY = "v_taxonomy(skill_pos, skill_name, category) AS (VALUES " + ", ".join(
    f"({i}, {lit(s.name)}, {lit(s.category)})" for i, s in enumerate(SKILLS)) + ")"


def _cues(cues: tuple[str, ...]) -> str:
    return "|".join(c.replace("{s}", S).replace("'", "''") for c in cues)


_STRIP = r"[-*#•\d.)" + WS + "]*"


def sections(source: str, key: str, text: str, p: str = "x") -> list[str]:
    """CTEs ending in ``{p}_sec(key, sec, type, header, content)``."""
    head = f"regexp_replace(cand, '^{_STRIP}', '')"
    return [
        f"{p}_l0 AS (SELECT {key} AS key, string_split_regex({text}, '\\r?\\n') AS ls FROM {source} WHERE {text} <> '')",
        f"{p}_l1 AS (SELECT key, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM {p}_l0)",
        f"{p}_l2 AS (SELECT *, {trim('line')} AS t FROM {p}_l1)",
        f"{p}_l3 AS (SELECT *, instr(t, ':') BETWEEN 2 AND 50 AS has FROM {p}_l2)",
        f"{p}_l4 AS (SELECT *, CASE WHEN has THEN {trim('split_part(t, chr(58), 1)')} ELSE t END AS cand, "
        f"CASE WHEN has THEN {trim('substr(t, instr(t, chr(58)) + 1)')} ELSE '' END AS after FROM {p}_l3)",
        f"""{p}_l5 AS (SELECT *, CASE
            WHEN NOT (cand <> '' AND length(cand) < 50 AND (has OR upper(cand) = cand
                 OR regexp_matches(cand, '(?i)^(?:{"|".join(BARE_HEADER_WORDS)})'))) THEN NULL
            WHEN regexp_matches({head}, '(?i)^(?:{_cues(SKILLS_CUES)})') THEN 'SKILLS_SECTION'
            WHEN regexp_matches({head}, '(?i)^(?:{_cues(REQUIRED_CUES)})') THEN 'REQUIRED'
            WHEN regexp_matches({head}, '(?i)^QUALIFICATIONS') AND NOT regexp_matches({head}, '(?i)^QUALIFICATIONS{S}+PREFERRED') THEN 'REQUIRED'
            WHEN regexp_matches({head}, '(?i)^(?:{_cues(PREFERRED_CUES)})') THEN 'PREFERRED'
            ELSE 'UNKNOWN' END AS htype FROM {p}_l4)""",
        f"{p}_l6 AS (SELECT *, htype IS NOT NULL AND (htype <> 'UNKNOWN' OR (has AND after = '' AND length(cand) < 40)) AS opens FROM {p}_l5)",
        f"{p}_l7 AS (SELECT *, sum(opens::int) OVER (PARTITION BY key ORDER BY pos) AS sec, "
        f"CASE WHEN NOT opens THEN line WHEN after <> '' THEN after END AS piece FROM {p}_l6)",
        f"""{p}_s0 AS (SELECT key, sec, coalesce(max(CASE WHEN opens THEN htype END), 'UNKNOWN') AS type,
            coalesce(max(CASE WHEN opens THEN cand END), 'Preamble') AS header,
            string_agg(piece, chr(10) ORDER BY pos) AS body FROM {p}_l7 GROUP BY key, sec)""",
        f"{p}_sec AS (SELECT key, sec, type, header, {trim('body')} AS content FROM {p}_s0 WHERE body IS NOT NULL)",
    ]


def _plain(variants: list[str], name: str) -> tuple[str, str]:
    import re
    alt = "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", v) for v in sorted(variants, key=lambda v: -len(v)))
    return f"(?i){LEFT}({alt}){RIGHT}", f"lower(t) = {lit(name.lower())}"


def _token_sql(name: str, variants: list[str]) -> tuple[str, str]:
    """(token in skills block, token in prose) for one skill over ``content``."""
    def pick(pattern: str, exact: str) -> tuple[str, str]:
        every = f"regexp_extract_all(content, '{pattern}', 1)"
        return f"coalesce(list_filter({every}, lambda t: {exact})[1], {every}[1])", f"{every}[1]"

    def first(pattern: str) -> str:
        return f"nullif(regexp_extract(content, '{pattern}', 1), '')"

    if name == "C":
        bare = f"regexp_replace(content, '(?i)(ANSI|Embedded){S}+C', 'x', 'g')"
        block = f"CASE WHEN regexp_matches({bare}, '{LEFT}C{RIGHT}') THEN 'C' ELSE {first(f'(?i){LEFT}((?:ANSI|Embedded){S}+C){RIGHT}')} END"
        ctx = f"C(?:{S}+(?:language|programming|developer|compiler|code)|{S}*/{S}*C\\+\\+|{S}+and{S}+C\\+\\+)"
        hit = f"regexp_extract(content, '{LEFT}((?i:(?:ANSI|Embedded){S}+C)|{ctx}){RIGHT}', 1)"
        prose = f"CASE WHEN {hit} = '' THEN NULL WHEN {hit} LIKE 'C%' THEN 'C' ELSE {hit} END"
        return block, prose
    if name in ("Go", "R"):
        alias = {"Go": "Golang", "R": "RStudio"}[name]
        cue = {"Go": "language|programming|developer|runtime|routine|backend|code",
               "R": "language|programming|developer|package|script|analytics|statistical"}[name]
        a = first(f"(?i){LEFT}({alias}){RIGHT}")
        return (f"CASE WHEN regexp_matches(content, '{LEFT}{name}{RIGHT}') THEN '{name}' ELSE {a} END",
                f"coalesce({a}, CASE WHEN regexp_matches(content, '{LEFT}{name}{S}+(?:{cue}){RIGHT}') THEN '{name}' END)")
    if name == ".NET":
        return pick(f"{LEFT}(ASP\\.NET(?:{S}*Core)?|\\.(?:NET|Net)(?:{S}*Core)?){RIGHT}", "lower(t) = '.net'")
    if name == "SQL":
        return pick(f"(?i){LEFT}(T-SQL|PL/SQL|SQL){RIGHT}", "upper(t) = 'SQL'")
    if name == "REST APIs":
        exact = f"upper(regexp_replace(t, '{S}+', ' ', 'g')) = 'REST APIS'"
        comp = f"(?i:RESTful(?:{S}*APIs?)?|REST{S}+APIs?)"
        return pick(f"{LEFT}({comp}|(?i:REST)){RIGHT}", exact)[0], pick(f"{LEFT}({comp}|REST){RIGHT}", exact)[1]
    return pick(*_plain(variants, name))


def _exact_sql(name: str) -> str:
    if name == "REST APIs":
        return f"upper(regexp_replace(token, '{S}+', ' ', 'g')) = 'REST APIS'"
    if name in ("C", "Go", "R"):
        return f"token = '{name}'"
    return f"lower(token) = {lit(name.lower())}"


def matches(p: str) -> list[str]:
    """CTEs from ``{p}_sec`` to ``{p}_m``: one row per (key, sec, skill) with a token."""
    structs = []
    for i, s in enumerate(SKILLS):
        block, prose = _token_sql(s.name, [s.name, *s.aliases])
        structs.append(f"{{'p': {i}, 'token': CASE WHEN block THEN {block} ELSE {prose} END}}")
    exact = "CASE skill_pos " + " ".join(f"WHEN {i} THEN {_exact_sql(s.name)}" for i, s in enumerate(SKILLS)) + " END"
    ctx = "skill_pos IN (" + ", ".join(str(_NAMES[n]) for n in ("C", "Go", "R")) + ")"
    return [
        f"{p}_blk AS (SELECT *, type = 'SKILLS_SECTION' OR regexp_matches(regexp_replace(split_part(content, chr(10), 1), '^{_STRIP}', ''), "
        f"'(?i)^(?:{_cues(SKILLS_CUES)})') AS block FROM {p}_sec)",
        f"{p}_u AS (SELECT key, sec, type, header, block, unnest([{', '.join(structs)}]) AS x FROM {p}_blk)",
        f"{p}_t AS (SELECT key, sec, type, header, block, x.p AS skill_pos, x.token AS token FROM {p}_u WHERE x.token IS NOT NULL)",
        f"""{p}_m AS (SELECT *, CASE WHEN {exact} THEN CASE WHEN NOT block AND {ctx} THEN 'CONTEXT' ELSE 'EXACT' END ELSE 'ALIAS' END AS match_type,
            CASE WHEN NOT block THEN 80.0 WHEN {exact} THEN 100.0 ELSE 90.0 END::double AS score FROM {p}_t)""",
    ]


def skills_of(source: str, key: str, text: str, p: str = "x") -> list[str]:
    """CTEs ending in ``{p}_skills``: best match per (key, skill)."""
    return [*sections(source, key, text, p), *matches(p),
            f"""{p}_skills AS (SELECT key, skill_pos, token, match_type, score, block, type AS section_type, header
                FROM {p}_m QUALIFY row_number() OVER (PARTITION BY key, skill_pos ORDER BY score DESC, sec) = 1)"""]


def requirements_of(source: str, key: str, text: str, p: str = "j") -> list[str]:
    """CTEs ending in ``{p}_req(key, skill_pos, bucket)`` before required-over-preferred precedence."""
    return [*sections(source, key, text, p), *matches(p),
            f"""{p}_b AS (SELECT key, skill_pos, CASE type WHEN 'REQUIRED' THEN 'R' WHEN 'PREFERRED' THEN 'P' ELSE 'U' END AS b,
                min(sec) AS sec FROM {p}_m GROUP BY ALL)""",
            f"""{p}_c AS (SELECT a.* FROM {p}_b a WHERE NOT EXISTS (SELECT 1 FROM {p}_b o WHERE o.key = a.key AND o.skill_pos = a.skill_pos
                AND o.sec < a.sec AND ((a.b = 'P' AND o.b = 'R') OR (a.b = 'U' AND o.b IN ('R', 'P')))))""",
            f"{p}_n AS (SELECT key, count(*) FILTER (WHERE b IN ('R', 'P')) AS named FROM {p}_c GROUP BY key)",
            f"""{p}_req AS (SELECT c.key, c.skill_pos, CASE WHEN b = 'U' AND n.named = 0 THEN 'P' ELSE b END AS bucket, sec
                FROM {p}_c c JOIN {p}_n n USING (key))"""]


REJECT = f"""CASE extraction_status WHEN 'PENDING' THEN 'RESUME_NOT_PROCESSED' WHEN 'PROCESSING' THEN 'RESUME_PROCESSING_IN_PROGRESS'
   WHEN 'FAILED' THEN 'RESUME_PROCESSING_FAILED'
   ELSE CASE WHEN extracted_text IS NULL OR length({trim('extracted_text')}) < 20 THEN 'RESUME_NO_TEXT' END END"""

ELIGIBLE = f"v_ok AS (SELECT * FROM v_resumes WHERE {REJECT} IS NULL)"

# One row per (application, evaluated skill).
ITEMS = ["""v_want AS (SELECT key AS job_id, skill_pos, min(bucket = 'P') AS pref FROM j_req WHERE bucket <> 'U' GROUP BY ALL)""",
         f"""v_items AS (SELECT a.resume_id, a.job_id, a.applied_at, r.user_id, r.file_name, t.skill_name, t.category,
             CASE WHEN w.pref THEN 'PREFERRED' ELSE 'REQUIRED' END AS requirement_type,
             CASE WHEN s.key IS NULL THEN 'MISSING' ELSE 'MATCHED' END AS status,
             coalesce(s.score, 0.0) AS similarity_score, s.block,
             '[' || CASE WHEN w.pref THEN 'PREFERRED' ELSE 'REQUIRED' END || '] ' || CASE WHEN s.key IS NULL
               THEN 'Skill not detected in candidate resume'
               ELSE CASE WHEN s.block THEN 'Skills section' ELSE 'Body context' END || ' '
                 || CASE WHEN s.match_type = 'ALIAS' THEN 'alias' ELSE 'exact' END || ' match: ''' || s.token
                 || ''' (Confidence: ' || CASE WHEN s.block THEN '1.00' ELSE '0.80' END || ')' END AS evidence
             FROM v_applications a JOIN v_ok r USING (resume_id) JOIN v_want w USING (job_id)
             JOIN v_taxonomy t USING (skill_pos)
             LEFT JOIN r_skills s ON s.key = a.resume_id AND s.skill_pos = w.skill_pos)"""]


def scores_cte(pref_absent: float = 0.0, eps: bool = True) -> str:
    conf = "CASE WHEN hits > 0 THEN (n_sec * 1.0::double + n_body * 0.8::double) / hits ELSE 0.0::double END"
    raw = (f"(0.7::double * (CASE WHEN n_req > 0 THEN m_req / n_req::double WHEN n_pref > 0 THEN 1.0::double ELSE 0.0::double END)"
           f" + 0.2::double * (CASE WHEN n_pref > 0 THEN m_pref / n_pref::double WHEN n_req > 0 THEN {pref_absent}::double ELSE 0.0::double END)"
           f" + 0.1::double * ({conf})) * 100.0::double")
    rounded = round_js(f"least(100.0::double, greatest(0.0::double, {raw}))", 2, eps)
    return f"""v_scores AS (
      SELECT *, n_req + n_pref AS total, CASE WHEN n_req + n_pref = 0 THEN 0.0::double ELSE {rounded} END AS overall_score,
             {round_js(conf, 3)} AS average_confidence,
             CASE WHEN n_req > 0 THEN {round_js('m_req / n_req::double', 3)} WHEN n_pref > 0 THEN 1.0::double ELSE 0.0::double END AS required_coverage,
             CASE WHEN n_pref > 0 THEN {round_js('m_pref / n_pref::double', 3)} ELSE 0.0::double END AS preferred_coverage
      FROM (SELECT a.resume_id, a.job_id, a.applied_at, r.user_id, r.file_name,
              count(i.skill_name) FILTER (WHERE i.requirement_type = 'REQUIRED') AS n_req,
              count(i.skill_name) FILTER (WHERE i.requirement_type = 'PREFERRED') AS n_pref,
              count(*) FILTER (WHERE i.requirement_type = 'REQUIRED' AND i.status = 'MATCHED') AS m_req,
              count(*) FILTER (WHERE i.requirement_type = 'PREFERRED' AND i.status = 'MATCHED') AS m_pref,
              count(*) FILTER (WHERE i.status = 'MATCHED') AS hits,
              count(*) FILTER (WHERE i.block) AS n_sec, count(*) FILTER (WHERE NOT i.block) AS n_body
            FROM v_applications a JOIN v_ok r USING (resume_id)
            LEFT JOIN v_items i ON i.resume_id = a.resume_id AND i.job_id = a.job_id GROUP BY ALL))"""


def match_ctes(pref_absent: float = 0.0, eps: bool = True) -> list[str]:
    """Everything up to ``v_items`` and ``v_scores``."""
    return [RESUMES, JOBS, APPLICATIONS, TAXONOMY, ELIGIBLE, *skills_of("v_ok", "resume_id", "extracted_text", "r"),
            *requirements_of("v_jobs", "job_id", "description", "j"), *ITEMS, scores_cte(pref_absent, eps)]


ANALYSIS_ID = "sha256(concat_ws('|', resume_id, job_id))"
CATALOG_FIRST = [s.name for s in SKILLS if s.name not in SECOND_SEED]
