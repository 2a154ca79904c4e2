"""Skill extraction over whole tables of text.

Plan per row (nothing shuffles):

1. one scan of every line finds which skills can occur at all, and long lines
   without any are shortened to what later steps can look at,
2. only texts with a candidate are split into sections,
3. on each section only the patterns of candidate skills run whose spellings
   it holds,
4. the best match per skill wins: highest tier first, then reading order.

Patterns are generated as literals, so each compiles once per task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from skilloom.functions import js, taxonomy
from skilloom.functions.arrays import explode_structs
from skilloom.functions.taxonomy import SKILLS, Skill
from skilloom.operators.sections import _ident, is_skills_block_sql, lines_sql, with_sections

# A token starts after one of these and ends before one of those.  Texts are
# padded with a line feed on both sides, so the start and the end of a text
# need no case of their own and each pattern begins with a plain character
# class, which the JVM scans fastest.
LEFT = f"[{js.WS},;:(/\\[{{<>\"'`]"
RIGHT = f"(?=[{js.WS},;:)/\\[\\]}}<>\"'`!?.])"
_RIGHT_CHARS = " \t\r\n,;:)/[]}<>\"'`!?."

SCORE_SECTION_EXACT, SCORE_SECTION_OTHER, SCORE_BODY = 100.0, 90.0, 80.0
CONFIDENCE_SECTION, CONFIDENCE_BODY = 1.0, 0.8


def escape(text: str) -> str:
    """Escape pattern metacharacters only (blanks stay readable)."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


@dataclass(frozen=True)
class Matcher:
    """SQL for a skill's tokens, in emission order, in a skills block and in prose."""

    block: str
    prose: str


def _all(pattern: str) -> str:
    return f"regexp_extract_all(s.content, {js.quote(pattern)}, 1)"


def _same(pattern: str) -> Matcher:
    return Matcher(_all(pattern), _all(pattern))


def _plain(skill: Skill) -> Matcher:
    alternatives = "|".join(escape(v) for v in taxonomy.variants(skill))
    return _same(f"(?i){LEFT}({alternatives}){RIGHT}")


def _c() -> Matcher:
    s = js.S
    alias = f"(?i:(?:ANSI|Embedded){s}+C){RIGHT}"
    # 15 characters before a bare C must not end in "ANSI " / "Embedded ".
    bare = f"(?<!(?i:ANSI){s}{{1,11}})(?<!(?i:Embedded){s}{{1,7}})C"
    cues = (f"(?:(?={s}+(?:language|programming|developer|compiler|code){RIGHT})"
            f"|(?={s}*/{s}*C\\+\\+){RIGHT}|(?={s}+and{s}+C\\+\\+){RIGHT})")
    return Matcher(block=f"concat({_all(f'{LEFT}({alias})')}, {_all(f'{LEFT}({bare}){RIGHT}')})",
                   prose=_all(f"{LEFT}({alias}|{bare}{cues})"))


def _word_with_cue(name: str, alias: str, cues: str) -> Matcher:
    found_alias = _all(f"(?i){LEFT}({alias}){RIGHT}")
    return Matcher(block=f"concat({found_alias}, {_all(f'{LEFT}({name}){RIGHT}')})",
                   prose=f"concat({found_alias}, {_all(f'{LEFT}({name}){js.S}+(?:{cues}){RIGHT}')})")


def _rest() -> Matcher:
    """A lone REST is dropped when a compound starts closer to it than the compound is long, whatever blanks the compound holds."""
    s = js.S
    compound = f"(?i:RESTful(?:{s}*APIs?)?|REST{s}+APIs?)"

    def tokens(lone: str) -> str:
        pattern = js.quote(f"{LEFT}({compound}{RIGHT}|{lone}{RIGHT})")
        placed = f"""aggregate(zip_with(split(s.content, {pattern}, -1), zip_with(regexp_extract_all(s.content, {pattern}, 0),
            regexp_extract_all(s.content, {pattern}, 1), (hit, token) -> struct(hit, token)), (part, h) -> struct(part, h.hit as hit, h.token as token)),
            struct(0 as at, cast(array() as array<struct<at: int, token: string>>) as found),
            (acc, x) -> if(x.hit is null, acc, struct(acc.at + length(x.part) + length(x.hit) as at,
                array_append(acc.found, named_struct('at', acc.at + length(x.part) + 1, 'token', x.token)) as found)), acc -> acc.found)"""
        return (f"transform(array({placed}), all -> transform(filter(all, x -> length(x.token) > 4 or not exists(all, c -> length(c.token) > 4 "
                "and abs(c.at - x.at) < length(c.token))), x -> x.token))[0]")

    return Matcher(tokens("(?i:REST)"), tokens("REST"))


def matcher_for(skill: Skill) -> Matcher:
    """Short or punctuation-heavy names have their own rules; the rest are plain."""
    s = js.S
    if skill.name == "C":
        return _c()
    if skill.name == "Go":
        return _word_with_cue("Go", "Golang", "language|programming|developer|runtime|routine|backend|code")
    if skill.name == "R":
        return _word_with_cue("R", "RStudio", "language|programming|developer|package|script|analytics|statistical")
    if skill.name == ".NET":
        return _same(f"{LEFT}(ASP\\.NET(?:{s}*Core)?|\\.(?:NET|Net)(?:{s}*Core)?){RIGHT}")
    if skill.name == "SQL":
        return _same(f"(?i){LEFT}(T-SQL|PL/SQL|SQL){RIGHT}")
    if skill.name == "REST APIs":
        return _rest()
    return _plain(skill)


# Found in prose only through a neighbouring word; such a hit is "CONTEXT".
CONTEXT_SKILLS = ("C", "Go", "R")

# Spellings the special rules accept beyond the listed names and aliases.
_EXTRA_SPELLINGS = {"REST APIs": ("RESTfulAPI", "RESTfulAPIs"), ".NET": (".NETCore", "ASP.NETCore"),
                    "C": ("ANSI", "Embedded")}


def candidate_pattern(skills: tuple[Skill, ...] = SKILLS) -> tuple[str, dict[str, list[int]]]:
    """One pattern for every spelling, and which skills each hit may stand for.

    The scan is zero-width, so overlapping tokens all surface; a hit also stands
    for every shorter spelling that ends at a delimiter inside it.
    """
    spellings: dict[str, set[int]] = {}
    for i, sk in enumerate(skills):
        for v in (sk.name, *sk.aliases, *_EXTRA_SPELLINGS.get(sk.name, ())):
            spellings.setdefault(v.lower(), set()).add(i)
    means: dict[str, list[int]] = {}
    for v in spellings:
        found: set[int] = set()
        for w, ids in spellings.items():
            if v == w or (v.startswith(w) and v[len(w)] in _RIGHT_CHARS):
                found |= ids
        means[v] = sorted(found)
    heads = sorted({v[0] for v in spellings})
    guarded = []  # a few heads behind one test, so that most words are turned down after a handful of them
    for at in range(0, len(heads), HEADS_AT_ONCE):
        some = heads[at:at + HEADS_AT_ONCE]
        guarded.append(f"(?=[{''.join(map(escape, some))}])(?:{_trie([v for v in spellings if v[0] in some])})")
    return f"{LEFT}(?=((?:{'|'.join(guarded)})){RIGHT})", means


HEADS_AT_ONCE = 5


def _trie(words: list[str]) -> str:
    """A pattern for any of the words, longest first, in which words share their beginnings."""
    branches = []
    for head, group in groupby(sorted(w for w in words if w), key=lambda w: w[0]):
        tails = [w[1:] for w in group]
        inner = _trie(tails)
        branches.append(escape(head) + (f"(?:{inner}){'?' if '' in tails else ''}" if inner else ""))
    return "|".join(branches)


def _hits_sql(text: str, pattern: str) -> str:
    return f"regexp_extract_all(concat('\\n', lower({text}), '\\n'), {js.quote(pattern)}, 1)"


def _line_hits_sql(line: str, pattern: str, skills: tuple[Skill, ...]) -> str:
    """As :func:`_hits_sql`.  A long line is first reduced to its distinct blank-separated words, which are far fewer; only where
    one of them holds the first word of a spelling the whole line is scanned."""
    first = _trie(sorted({v.lower().split(" ")[0] for i, sk in enumerate(skills) for v in (sk.name, *sk.aliases, *_EXTRA_SPELLINGS.get(sk.name, ()))}))
    words = f"concat(' ', array_join(array_distinct(split(lower({line}), ' ')), ' '), ' ')"
    return (f"if(octet_length({line}) > {LONG_LINE} AND NOT {words} RLIKE {js.quote(f'{LEFT}(?:{first}){RIGHT}')}, "
            f"cast(array() as array<string>), {_hits_sql(line, pattern)})")


def _positions_sql(hits: str, means: dict[str, list[int]]) -> str:
    table = "|".join(f"{k}={','.join(map(str, v))}" for k, v in means.items())
    return f"array_distinct(flatten(transform(array_distinct({hits}), h -> split(str_to_map({js.quote(table)}, '[|]', '=')[h], ','))))"


def candidates_sql(text: str, skills: tuple[Skill, ...] = SKILLS) -> str:
    """Positions (as strings) of the skills that can occur in ``text`` at all."""
    pattern, means = candidate_pattern(skills)
    return _positions_sql(_hits_sql(text, pattern), means)


#: Lines of more bytes are shortened to their first and last characters where no spelling occurs in them.
LONG_LINE, LINE_HEAD, LINE_TAIL = 800, 100, 40
# A REST compound this wide could reach over a shortened line.
_WIDE_COMPOUND = f"(?i)REST(?:ful)?{js.S}{{40,}}API"


def shortened_sql(line: str) -> str:
    """A line without any spelling, cut to what sections and patterns can depend on.

    A header ends within 50 characters, a cue behind a token of the line before
    is among the first words, what a token of the next line looks back to is at
    the end, and no token touches the mark at the cut.  The longest skills cue
    has 22 letters, so none reaches the cut over 30.
    """
    letters = "".join(c + c.upper() for c in "abcdefghijklmnopqrstuvwxyz")
    wordy = f"char_length(translate(substr({line}, 51, 50), '{letters}', '')) <= 20"
    return (f"if(octet_length({line}) > {LONG_LINE} AND ascii({line}) BETWEEN 33 AND 126 AND {wordy}, "
            f"concat(left({line}, {LINE_HEAD}), '_', right({line}, {LINE_TAIL})), {line})")


# What any token of a special rule holds: as written, or in lower case.
_HOLDS = {"C": (("C",), ("ansi", "embedded")), "Go": (("Go",), ("golang",)), "R": (("R",), ("rstudio",)), ".NET": ((), (".net",)),
          "SQL": ((), ("sql",)), "REST APIs": ((), ("rest",))}
BITS = 63


def _may_hold_sql(skill: Skill, content: str, low: str) -> str:
    """Whether a text can hold a token of the skill: byte searches, far cheaper than a pattern that finds none."""
    exact, folded = _HOLDS.get(skill.name, ((), tuple(v.lower() for v in taxonomy.variants(skill))))
    least = [v for v in dict.fromkeys(folded) if not any(w != v and w in v for w in folded)]
    tests = [f"contains({content}, {js.quote(v)})" for v in exact] + [f"contains({low}, {js.quote(v)})" for v in least]
    return "(" + " OR ".join(tests) + ")"


def _tokens_sql(skill: Skill) -> str:
    """Tokens of a skill in section ``s``.  Where no token spans lines, its pattern runs on the lines alone that can hold one."""
    m = matcher_for(skill)
    if skill.name in _HOLDS and skill.name != "SQL":
        return m.block if m.block == m.prose else f"if(s.block, {m.block}, {m.prose})"
    lines = f"array_join(transform(filter(s.lines, l -> {_may_hold_sql(skill, 'l.line', 'l.low')}), l -> l.line), '\n')"
    return m.block.replace("s.content", f"concat('\\n', {lines}, '\\n')", 1)


SKILLS_AT_ONCE = 7  # behind one test of the candidates; divides BITS


def _section_matches_sql(skills: tuple[Skill, ...], brief: bool = False) -> str:
    """Matches of the candidate skills in section ``s`` (fields type, header, content, low, lines, block); ``brief``: their positions only."""
    tests = []
    for i, sk in enumerate(skills):
        may = f"(_sk_w{i // BITS} & {1 << i % BITS}L) <> 0 AND {_may_hold_sql(sk, 's.content', 's.low')}"
        if sk.name == "REST APIs":  # in prose a lone one has to be in capitals
            may += " AND (s.block OR contains(s.content, 'REST') OR contains(s.low, 'restful') OR contains(s.low, 'api'))"
        tests.append(f"if({may} AND size({_tokens_sql(sk)}) > 0, {i}, null)" if brief else f"if({may}, named_struct('p', {i}, 'a', {_tokens_sql(sk)}), null)")
    groups = []
    for at in range(0, len(tests), SKILLS_AT_ONCE):
        some = tests[at:at + SKILLS_AT_ONCE]
        mask = sum(1 << (at + k) % BITS for k in range(len(some)))
        groups.append(f"if((_sk_w{at // BITS} & {mask}L) <> 0, array({', '.join(some)}), null)")
    found = f"flatten(filter(array({', '.join(groups)}), g -> g IS NOT NULL))"
    if brief:
        return f"filter({found}, p -> p IS NOT NULL)"
    canonical = literal_array([s.name.lower() for s in skills])
    context = ", ".join(str(i) for i, s in enumerate(skills) if s.name in CONTEXT_SKILLS) or "-1"

    def exact(token: str) -> str:
        return f"lower(regexp_replace({token}, {js.quote(js.S + '+')}, ' ')) = {canonical}[f.p]"

    token = f"if(s.block, coalesce(get(filter(f.a, t -> {exact('t')}), 0), f.a[0]), f.a[0])"
    best = (f"transform(filter({found}, f -> size(f.a) > 0), f -> named_struct('p', f.p, 't', {token}))")
    typed = (f"transform({best}, f -> named_struct('p', f.p, 't', f.t, 'k', CASE WHEN NOT {exact('f.t')} THEN 'ALIAS' "
             f"WHEN NOT s.block AND f.p IN ({context}) THEN 'CONTEXT' ELSE 'EXACT' END))")
    return (f"transform({typed}, m -> named_struct('skill_pos', m.p, 'token', m.t, 'match_type', m.k, "
            f"'score', CASE WHEN NOT s.block THEN {SCORE_BODY}D WHEN m.k = 'EXACT' THEN {SCORE_SECTION_EXACT}D "
            f"ELSE {SCORE_SECTION_OTHER}D END, 'in_skills_section', s.block, 'section_type', s.type, 'header', s.header))")


def with_section_matches(df: DataFrame, text: str, out: str, skills: tuple[Skill, ...] = SKILLS,
                         override: bool | str | None = None, brief: bool = False) -> DataFrame:
    """Add ``out``: per section its type, header and skill matches; ``brief``: its type, block and the positions of its skills,
    without tokens and their kinds.

    ``override`` skips the splitter: ``True`` / ``False`` treats the whole text
    as a skills block or as prose.
    """
    t = _ident(text)
    pattern, means = candidate_pattern(skills)
    if override is None:
        df = df.withColumn("_sk_found", F.expr(
            f"transform({lines_sql(t)}, l -> named_struct('line', l, 'hits', {_line_hits_sql('l', pattern, skills)}))"))
        df = df.withColumn("_sk_cand", F.expr(_positions_sql("flatten(transform(_sk_found, x -> x.hits))", means)))
    else:
        df = df.withColumn("_sk_cand", F.expr(candidates_sql(t, skills)))
    words = [f"_sk_w{w}" for w in range(-(-len(skills) // BITS))]
    df = df.withColumns({c: F.expr(f"aggregate(_sk_cand, 0L, (a, p) -> if(cast(p as int) div {BITS} = {w}, a | shiftleft(1L, cast(p as int) % {BITS}), a))")
                         for w, c in enumerate(words)})
    if override is None:
        short = f"array_join(transform(_sk_found, x -> if(size(x.hits) > 0, x.line, {shortened_sql('x.line')})), '\n')"
        df = df.withColumn("_sk_text", F.expr(f"if(size(_sk_cand) > 0, {short}, null)")).drop("_sk_found")
        df = df.withColumn("_sk_text", F.expr(f"if(_sk_text RLIKE {js.quote(_WIDE_COMPOUND)}, {t}, _sk_text)"))
        df = with_sections(df, "_sk_text", "_sk_sections")
    else:
        kind = "SKILLS_SECTION" if override else "BODY"
        df = df.withColumn("_sk_text", F.lit(None).cast("string")).withColumn("_sk_sections", F.expr(
            f"if(size(_sk_cand) > 0, array(named_struct('type', '{kind}', 'header', 'Override', 'content', {t})), null)"))
    blocks = (f"transform(_sk_sections, s -> named_struct('type', s.type, 'header', s.header, 'content', concat('\\n', s.content, '\\n'), 'low', lower(s.content), "
              "'lines', transform(split(s.content, '\\n'), l -> named_struct('line', l, 'low', lower(l))), "
              f"'block', {is_skills_block_sql('s.content', 's.type')}))")
    about = "'block', s.block" if brief else "'header', s.header"
    return (df.withColumn("_sk_blocks", F.expr(blocks))
            .withColumn(out, F.expr(f"transform(_sk_blocks, s -> named_struct('type', s.type, {about}, 'matches', {_section_matches_sql(skills, brief)}))"))
            .drop("_sk_cand", "_sk_text", "_sk_sections", "_sk_blocks", *words))


def literal_array(values: list[str]) -> str:
    """A constant string array (folded once by the optimizer)."""
    return f"split({js.quote('|'.join(values))}, '[|]')"


def with_skills(df: DataFrame, text: str, out: str = "skills", skills: tuple[Skill, ...] = SKILLS,
                override: bool | None = None) -> DataFrame:
    """Add ``out``: the deduplicated skills of ``text``, best match each."""
    names, cats = literal_array([s.name for s in skills]), literal_array([s.category for s in skills])
    best = ("aggregate(filter(_sk_flat, m -> m.skill_pos = p), cast(null as struct<skill_pos:int,token:string,"
            "match_type:string,score:double,in_skills_section:boolean,section_type:string,header:string>), "
            "(acc, m) -> if(acc IS NULL OR m.score > acc.score, m, acc))")
    shaped = ("transform(transform(array_distinct(transform(_sk_flat, m -> m.skill_pos)), p -> " + best + "), b -> named_struct("
              f"'skill_pos', b.skill_pos, 'skill_name', {names}[b.skill_pos], 'category', {cats}[b.skill_pos], "
              "'token', b.token, 'match_type', b.match_type, 'score', b.score, "
              f"'confidence', if(b.in_skills_section, {CONFIDENCE_SECTION}D, {CONFIDENCE_BODY}D), "
              "'in_skills_section', b.in_skills_section, 'section_type', b.section_type, "
              "'evidence', concat(b.header, ': ', b.token)))")
    df = with_section_matches(df, text, "_sk_sec", skills, override)
    return (df.withColumn("_sk_flat", F.expr("coalesce(flatten(transform(_sk_sec, s -> s.matches)), array())"))
            .withColumn(out, F.expr(shaped)).drop("_sk_sec", "_sk_flat"))


def with_skill_tiers(df: DataFrame, text: str, section: str = "section_pos", body: str = "body_pos", skills: tuple[Skill, ...] = SKILLS) -> DataFrame:
    """Add the positions of the skills that :func:`with_skills` finds in a skills section, and of those that it finds in prose only."""
    df = with_section_matches(df, text, "_sk_sec", skills, brief=True)
    of = "array_distinct(coalesce(flatten(transform(filter(_sk_sec, s -> {no}s.block), s -> s.matches)), cast(array() as array<int>)))"
    return (df.withColumn(section, F.expr(of.format(no=""))).withColumn("_sk_body", F.expr(of.format(no="NOT ")))
            .withColumn(body, F.array_except("_sk_body", section)).drop("_sk_sec", "_sk_body"))


def explode_skills(df: DataFrame, key: str, skills_col: str = "skills") -> DataFrame:
    """One row per (document, skill)."""
    return explode_structs(df, skills_col, key)
