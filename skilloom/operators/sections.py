"""Split free text into typed sections, one row in, one array out, no shuffle.

A line opens a section when it is a recognised header (skills, required,
preferred) or a short ``something:`` line of its own.  Work is linear in the
text: every line is classified once, then each section is a slice of the line
array between two header positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skilloom.functions import js, taxonomy

NEWLINE = r"\n"  # inside a SQL literal
SECTION_TYPE = "array<struct<type:string,header:string,content:string>>"

_STRIP = r"[-*#\x{2022}\d.)" + js.WS + "]*"
_STRIP_INLINE = r"[-*#\x{2022}\d.)" + js.WS_INLINE + "]*"


def _alternatives(cues: tuple[str, ...], space: str = js.S) -> str:
    return "|".join(c.replace("{s}", space) for c in cues)


SKILLS_HEADER = f"(?i)^{_STRIP}(?:{_alternatives(taxonomy.SKILLS_CUES)})"
REQUIRED_HEADER = (f"(?i)^{_STRIP}(?:{_alternatives(taxonomy.REQUIRED_CUES)}"
                   f"|{taxonomy.REQUIRED_UNLESS_PREFERRED}(?!{js.S}+PREFERRED))")
PREFERRED_HEADER = f"(?i)^{_STRIP}(?:{_alternatives(taxonomy.PREFERRED_CUES)})"
# First line of a block reads like a skills header (never looks past that line).
_SKILLS_INLINE = f"{_STRIP_INLINE}(?:{_alternatives(taxonomy.SKILLS_CUES, '[' + js.WS_INLINE + ']')})"
SKILLS_FIRST_LINE = f"(?i)^{_SKILLS_INLINE}"
# Any line is a skills header, for texts padded with a leading line feed.
SKILLS_ANY_LINE = f"(?i)\\n{_SKILLS_INLINE}"
_BARE = "(?i)^(?:" + "|".join(taxonomy.BARE_HEADER_WORDS) + ")"


def header_type_sql(e: str) -> str:
    """SKILLS_SECTION / REQUIRED / PREFERRED / UNKNOWN for a trimmed header line."""
    q = js.quote
    return (f"CASE WHEN {e} RLIKE {q(SKILLS_HEADER)} THEN 'SKILLS_SECTION' "
            f"WHEN {e} RLIKE {q(REQUIRED_HEADER)} THEN 'REQUIRED' "
            f"WHEN {e} RLIKE {q(PREFERRED_HEADER)} THEN 'PREFERRED' ELSE 'UNKNOWN' END")


def is_skills_block_sql(content: str, section_type: str) -> str:
    return f"({section_type} = 'SKILLS_SECTION' OR {content} RLIKE {js.quote(SKILLS_FIRST_LINE)})"


def _shorter_than(e: str, n: int) -> str:
    return f"(length({e}) < {n} AND {js.utf16_length_sql(e)} < {n})"


def _trim_long_sql(e: str) -> str:
    """As ``js.trim_sql``, for texts that mostly begin and end in a plain character: trimming walks the whole text."""
    plain = f"ascii({e}) BETWEEN 33 AND 126 AND ascii(right({e}, 1)) BETWEEN 33 AND 126"
    return f"if({plain}, {e}, {js.trim_sql(e)})"


def _line_heads_sql(lines: str) -> str:
    """Per line: header text, text after the colon, type, and whether it opens a section."""
    before, after = "substring_index({v}.t, ':', 1)", "substr({v}.t, instr({v}.t, ':') + 1)"
    step1 = f"transform({lines}, l -> named_struct('t', {_trim_long_sql('l')}))"
    step2 = (f"transform({step1}, a -> named_struct('t', a.t, 'has', "
             f"instr(a.t, ':') > 1 AND {_shorter_than(before.format(v='a'), 50)}))")
    step3 = (f"transform({step2}, b -> named_struct('has', b.has, "
             f"'cand', if(b.has, {js.trim_sql(before.format(v='b'))}, b.t), "
             f"'after', if(b.has, {js.trim_sql(after.format(v='b'))}, '')))")
    step4 = (f"transform({step3}, c -> named_struct('cand', c.cand, 'after', c.after, 'has', c.has, 'type', "
             f"CASE WHEN c.cand <> '' AND {_shorter_than('c.cand', 50)} AND "
             f"(c.has OR upper(c.cand) = c.cand OR c.cand RLIKE {js.quote(_BARE)}) "
             f"THEN {header_type_sql('c.cand')} END))")
    return (f"transform({step4}, d -> named_struct('header', d.cand, 'after', d.after, "
            f"'type', coalesce(d.type, 'UNKNOWN'), 'opens', d.type IS NOT NULL AND (d.type <> 'UNKNOWN' "
            f"OR (d.has AND d.after = '' AND {_shorter_than('d.cand', 40)}))))")


def lines_sql(text: str) -> str:
    """The lines of a text, null without any; a plain character is split at far faster than a pattern."""
    return f"split(replace(nullif({text}, ''), '\\r\\n', '\\n'), '\\n', -1)"


def with_sections(df: DataFrame, text: str, out: str = "sections") -> DataFrame:
    """Add ``out``: the typed sections of column ``text`` in reading order."""
    body = ("concat(if(j > 0 AND heads[starts[j] - 1].after <> '', array(heads[starts[j] - 1].after), "
            "cast(array() as array<string>)), slice(lines, starts[j] + 1, ends[j] - starts[j] - 1))")
    body = (body.replace("heads", "_sl_heads").replace("starts", "_sl_starts")
            .replace("ends", "_sl_ends").replace("lines", "_sl_lines"))
    pieces = (f"transform(sequence(0, size(_sl_starts) - 1), j -> named_struct("
              f"'type', if(j = 0, 'UNKNOWN', _sl_heads[_sl_starts[j] - 1].type), "
              f"'header', if(j = 0, 'Preamble', _sl_heads[_sl_starts[j] - 1].header), 'body', {body}))")
    return (
        df.withColumn("_sl_lines", F.expr(lines_sql(_ident(text))))
        .withColumn("_sl_heads", F.expr(_line_heads_sql("_sl_lines")))
        .withColumn("_sl_hidx", F.expr("filter(sequence(1, size(_sl_lines)), i -> _sl_heads[i - 1].opens)"))
        .withColumn("_sl_starts", F.expr("concat(array(0), _sl_hidx)"))
        .withColumn("_sl_ends", F.expr("concat(_sl_hidx, array(size(_sl_lines) + 1))"))
        .withColumn(out, F.expr(
            f"transform(filter({pieces}, p -> size(p.body) > 0), p -> named_struct('type', p.type, "
            f"'header', p.header, 'content', transform(array(array_join(p.body, '{NEWLINE}')), c -> {_trim_long_sql('c')})[0]))"))
        .drop("_sl_lines", "_sl_heads", "_sl_hidx", "_sl_starts", "_sl_ends")
    )


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
