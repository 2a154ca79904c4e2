"""DuckDB side of the quality features."""

from __future__ import annotations

from skilloom.functions.taxonomy import SKILLS_CUES
from skilloom.operators.quality import (ACTION_VERBS, EDUCATION_CUES, EMAIL, EXPERIENCE_CUES, METRIC_UNITS, PHONE,
                                        PROJECT_CUES)
from skilloom.oracle.base import S, WS, _STRIP, _cues, trim


def _head(cues: str) -> str:
    return f"regexp_matches(t, '(?im)(?:^|\\n){S}*(?:{cues.replace('{s}', S)})\\b')"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))::bigint"


def features(source: str, key: str, text: str, out: str) -> list[str]:
    """CTEs ending in ``{out}``: key plus features of every non-blank text."""
    metrics = (r"(?i)\b\d+(?:\.\d+)?%|\b\d+(?:\.\d+)?x\b|\$" + S + r"*\d+|\b\d+\+?" + S + f"*(?:{METRIC_UNITS})" + r"\b"
               r"|\b\d+(?:\.\d+)?[kKmMbB]\+?\b")
    line_has_cue = (f"len(list_filter(string_split_regex(t, '\\r?\\n'), lambda l: regexp_matches(regexp_replace({trim('l')}, '^{_STRIP}', ''), "
                    f"'(?i)^(?:{_cues(SKILLS_CUES)})'))) > 0")
    return [f"{out}_t AS (SELECT {key}, {trim(text)} AS t FROM {source} WHERE {text} IS NOT NULL)",
            f"""{out}_f AS (SELECT {key}, regexp_matches(t, '{EMAIL}') OR regexp_matches(t, '{PHONE.replace("{w}", WS)}') AS has_contact,
              {line_has_cue} AS has_skills, {_head(EXPERIENCE_CUES)} AS has_experience, {_head(EDUCATION_CUES)} AS has_education,
              {_head(PROJECT_CUES)} AS has_projects, {_n(f'[^{WS}]+')} AS word_count,
              {_n(f'(?:^|[{chr(92)}n]){S}*[-*•–—]{S}+')} AS bullet_points_count,
              {_n('(?i)' + chr(92) + 'b(?:' + '|'.join(ACTION_VERBS) + ')' + chr(92) + 'b')} AS action_verbs_count,
              {_n(metrics)} AS quantifiable_metrics_count FROM {out}_t WHERE t <> '')""",
            f"""{out} AS (SELECT *, CASE WHEN word_count < 150 THEN 'TOO_BRIEF' WHEN word_count < 250 THEN 'SHORT'
              WHEN word_count <= 1000 THEN 'OPTIMAL' WHEN word_count <= 1500 THEN 'LONG' ELSE 'EXCESSIVE' END AS word_count_status FROM {out}_f)"""]
