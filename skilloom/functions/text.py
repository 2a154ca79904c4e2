"""Text clean-up, readability checks, slugs and hashes."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from skilloom.functions import js

MIN_READABLE_CHARS, MAX_TEXT_UNITS = 20, 500_000



@lru_cache(maxsize=1)
def _nfkc():
    # Defined locally so it ships to executors by value.
    def normalize(s: pd.Series) -> pd.Series:
        from unicodedata import normalize as n
        return s.map(lambda t: n("NFKC", t), na_action="ignore")

    return pandas_udf(normalize, T.StringType())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC.  ASCII text is already normal, so only other text visits Python."""
    c = _col(c)
    return F.coalesce(_nfkc()(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def clean_text(c: Column | str, normalize: bool = True) -> Column:
    """Document clean-up that keeps paragraphs, bullets and tabs."""
    c = _col(c)
    t = nfkc(c) if normalize else c
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, f"[{js.WS_BLANKS}]+", " ")
    t = F.regexp_replace(t, r"[" + js.WS_INLINE + r"]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.coalesce(js.trim(t), F.lit(""))


def clean_title(c: Column | str) -> Column:
    return js.collapse(_col(c))


def normalize_for_match(c: Column | str) -> Column:
    """Lower-case, whitespace runs to one blank, trimmed; null counts as empty."""
    return js.collapse(F.lower(F.coalesce(_col(c), F.lit(""))))


def _plain(c: Column) -> Column:
    """Whether the only white space and the only non-letter bytes to mind are blanks: ASCII without tabs, feeds or line ends.

    Byte searches cost a fraction of a pattern, which first has to decode the string.
    """
    plain = F.octet_length(c) == F.char_length(c)
    for control in "\t\n\x0B\f\r":
        plain = plain & ~F.contains(c, F.lit(control))
    return plain


def trim_short(c: Column) -> Column:
    """As ``js.trim``, for many short strings."""
    return F.when(_plain(c), F.trim(c)).otherwise(js.trim(c))


def normalize_short(c: Column | str) -> Column:
    """As :func:`normalize_for_match`, for many short strings."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(_plain(c) & ~F.contains(c, F.lit("  ")), F.lower(F.trim(c))).otherwise(normalize_for_match(c))


def slug(c: Column | str) -> Column:
    t = F.regexp_replace(js.trim(F.lower(F.coalesce(_col(c), F.lit("")))), "[^a-z0-9]+", "_")
    return F.regexp_replace(t, r"^_+|_+\z", "")


def readable_chars(c: Column | str) -> Column:
    return js.utf16_length(F.regexp_replace(_col(c), f"{js.S}+", ""))


def readability_code(c: Column | str, min_chars: int = MIN_READABLE_CHARS, max_units: int = MAX_TEXT_UNITS) -> Column:
    """NO_READABLE_TEXT / TEXT_LIMIT_EXCEEDED, or null when the text is usable."""
    c = _col(c)
    return (F.when(c.isNull() | (c == "") | (readable_chars(c) < min_chars), "NO_READABLE_TEXT")
            .when(js.utf16_length(c) > max_units, "TEXT_LIMIT_EXCEEDED"))


def sha256(c: Column | str) -> Column:
    return F.sha2(F.encode(_col(c), "UTF-8"), 256)


def contains_search(c: Column | str, needle: str) -> Column:
    """Case-insensitive substring search; null columns never match a non-empty needle."""
    return F.lower(F.coalesce(_col(c), F.lit(""))).contains(needle.lower())
