"""String and number helpers with ECMAScript semantics, as Spark expressions.

The matching rules were specified on ECMAScript strings, which differ from the
JVM in small ways: whitespace covers more code points, word boundaries are
ASCII-only, lengths count UTF-16 units and rounding is ``floor(x + 0.5)``.
Everything here stays inside the JVM.  Each helper has a Column form and, where
generated SQL needs it, a text form with the suffix ``_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bodies of character classes holding every ECMAScript whitespace code point.
# The non-ASCII members sit behind a range test, so the common ASCII character
# is decided by one bitmap probe instead of a chain of comparisons.
_ASCII_WS = r"\t\n\x0B\f\r "
_WIDE_WS = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WIDE = r"[\x{A0}-\x{FFFF}&&[" + _WIDE_WS + "]]"
WS = _ASCII_WS + _WIDE
# The same without the line feed, for rules that must stay on one line.
WS_INLINE = _ASCII_WS.replace(r"\n", "") + _WIDE
# Without tab and line feed: the blanks that clean-up folds together.
WS_BLANKS = WS_INLINE.replace(r"\t", "")
S = f"[{WS}]"
NOT_S = r"[[\x00-\x7F&&[^" + _ASCII_WS + r"]][\x{80}-\x{10FFFF}&&[^" + _WIDE_WS + "]]]"

# ASCII word boundaries (the JVM's own \b follows Unicode letters).
W = "0-9A-Za-z_"
WORD_START = f"(?<![{W}])"
WORD_END = f"(?![{W}])"
BOUNDARY = f"(?:(?<=[{W}])(?![{W}])|(?<![{W}])(?=[{W}]))"

# What ends a line in ECMAScript multi-line patterns.
LINE_BREAK = r"[\n\r\x{2028}\x{2029}]"


def quote(text: str) -> str:
    """Spark SQL string literal for arbitrary text (patterns included)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _whitespace_chars() -> str:
    singles = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    return "".join(map(chr, [*singles, *range(0x2000, 0x200B)]))


WS_CHARS = _whitespace_chars()


def trim_sql(e: str) -> str:
    return f"btrim({e}, {quote(WS_CHARS)})"


def trim(c: Column) -> Column:
    """``String.prototype.trim``: only looks at both ends of the text."""
    return F.btrim(c, F.lit(WS_CHARS))


def utf16_length_sql(e: str) -> str:
    return f"(octet_length(encode({e}, 'UTF-16BE')) div 2)"


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def collapse(c: Column) -> Column:
    """Trim and fold every whitespace run to one blank."""
    return F.trim(F.regexp_replace(c, f"{S}+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NOT_S + "+"))


def round_half_up(x: Column, digits: int, epsilon: bool = False) -> Column:
    """``Math.round``-style rounding on doubles: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10 ** digits)
    if epsilon:
        x = x + F.lit(2.220446049250313e-16)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
