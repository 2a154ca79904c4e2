"""A slow, one-text-at-a-time model of sections and skill matching, for comparison only.

It works on positions and candidate lists instead of generated patterns: tokens
are located by direct string comparison at delimiter boundaries.
"""

from __future__ import annotations

import re

from skilloom.functions.js import WS_CHARS
from skilloom.functions.taxonomy import SKILLS

OPEN = set(WS_CHARS) | set(",;:(/[{<>\"'`")
CLOSE = set(WS_CHARS) | set(",;:)/[]}<>\"'`!?.")
SKILL_HEADS = ("skills", "technical skills", "core competencies", "languages", "programming languages", "technologies", "tech stack",
               "tools & platforms", "tools and platforms", "technical proficiencies", "areas of expertise")
NEED_HEADS = ("requirements", "minimum qualifications", "required", "what you need", "what you will need", "what you'll need",
              "what you bring", "what you will bring", "what you'll bring", "must have", "basic qualifications")
WISH_HEADS = ("preferred", "nice to have", "bonus", "pluses", "desired", "good to have", "additional")
BARE = ("requirements", "qualifications", "skills", "technical skills", "nice to have", "must have", "preferred", "tech stack")


def kind(header: str) -> str:
    h = re.sub(r"\s+", " ", header.strip(WS_CHARS).lstrip("-*#•.)0123456789" + WS_CHARS).lower())
    if h.startswith(SKILL_HEADS):
        return "SKILLS_SECTION"
    if h.startswith(NEED_HEADS) or (h.startswith("qualifications") and not h.startswith("qualifications preferred")):
        return "REQUIRED"
    return "PREFERRED" if h.startswith(WISH_HEADS) else "UNKNOWN"


def sections(text: str) -> list[dict]:
    out, now, lines = [], {"type": "UNKNOWN", "header": "Preamble"}, []
    for line in re.split(r"\r?\n", text):
        t = line.strip(WS_CHARS)
        cut = t.find(":")
        colon = 0 < cut < 50
        head = t[:cut].strip(WS_CHARS) if colon else t
        rest = t[cut + 1:].strip(WS_CHARS) if colon else ""
        looks = bool(head) and len(head) < 50 and (colon or head.upper() == head or head.lower().startswith(BARE))
        k = kind(head) if looks else "UNKNOWN"
        if t and looks and (k != "UNKNOWN" or (colon and not rest and len(head) < 40)):
            if lines:
                out.append({**now, "content": "\n".join(lines).strip(WS_CHARS)})
            now, lines = {"type": k, "header": head}, [rest] if rest else []
        else:
            lines.append(line)
    if lines:
        out.append({**now, "content": "\n".join(lines).strip(WS_CHARS)})
    return out


def _starts(text: str, i: int) -> bool:
    return i == 0 or text[i - 1] in OPEN


def _ends(text: str, j: int) -> bool:
    return j == len(text) or text[j] in CLOSE


def _scan(text: str, spellings: list[str], fold: bool = True) -> list[tuple[int, str]]:
    """Non-overlapping tokens, leftmost first, longest spelling first."""
    hay = text.lower() if fold else text
    words = sorted(spellings, key=lambda w: -len(w))
    hits, i = [], 0
    while i < len(text):
        found = next((w for w in words if _starts(text, i) and hay.startswith(w.lower() if fold else w, i) and _ends(text, i + len(w))), None)
        if found:
            hits.append((i, text[i:i + len(found)]))
            i += len(found)
        else:
            i += 1
    return hits


def _followed(text: str, name: str, cues: tuple[str, ...]) -> list[tuple[int, str]]:
    hits = []
    for i, tok in _scan(text, [name], fold=False):
        after = text[i + len(name):]
        gap = len(after) - len(after.lstrip(WS_CHARS))
        tail = after[gap:]
        if gap and any(tail.startswith(c) and _ends(tail, len(c)) for c in cues):
            hits.append((i, tok))
    return hits


def _stretch(*spellings: str) -> list[str]:
    """Spellings whose inner blanks may be any whitespace: one or two blanks, or a line feed."""
    return [w.replace(" ", gap) for w in spellings for gap in ((" ", "  ", "\t", "\n") if " " in w else ("",))]


def candidates(name: str, aliases: tuple[str, ...], text: str, block: bool) -> list[tuple[str, str]]:
    """(token, match type) in emission order."""
    if name in ("Go", "R"):
        alias = {"Go": "Golang", "R": "RStudio"}[name]
        cues = {"Go": ("language", "programming", "developer", "runtime", "routine", "backend", "code"),
                "R": ("language", "programming", "developer", "package", "script", "analytics", "statistical")}[name]
        own = _scan(text, [name], fold=False) if block else _followed(text, name, cues)
        return [(t, "ALIAS") for _, t in _scan(text, [alias])] + [(t, "EXACT" if block else "CONTEXT") for _, t in own]
    if name == "C":
        alias = _scan(text, _stretch("ANSI C", "Embedded C"))
        ok = [(i, t) for i, t in _scan(text, ["C"], fold=False) if not re.search(r"(?:ANSI|Embedded)\s+$", text[max(0, i - 15):i], re.I)]
        if not block:
            ok = [(i, t) for i, t in ok if re.match(r"\s+(?:language|programming|developer|compiler|code)(?=$|[\s,;:)/\[\]}<>\"'`!?.])|\s*/\s*C\+\+|\s+and\s+C\+\+",
                                                    text[i + 1:])]
        both = [(i, t, "ALIAS") for i, t in alias] + [(i, t, "EXACT" if block else "CONTEXT") for i, t in ok]
        return [(t, m) for _, t, m in sorted(both, key=lambda x: x[0])]
    if name == ".NET":
        hits = _scan(text, _stretch(".NET", ".Net", ".NET Core", ".Net Core", ".NETCore", ".NetCore", "ASP.NET", "ASP.NET Core", "ASP.NETCore"), fold=False)
        return [(t, "EXACT" if t.lower() == ".net" else "ALIAS") for _, t in hits]
    if name == "SQL":
        return [(t, "EXACT" if t.upper() == "SQL" else "ALIAS") for _, t in _scan(text, ["T-SQL", "PL/SQL", "SQL"])]
    if name == "REST APIs":
        wide = _scan(text, _stretch("RESTful", "RESTful API", "RESTful APIs", "RESTfulAPI", "RESTfulAPIs", "REST API", "REST APIs"))
        alone = [(i, t) for i, t in _scan(text, ["REST"], fold=block)
                 if not any(abs(j - i) < max(len(w), len(t)) for j, w in wide)]
        return [(t, "EXACT" if " ".join(t.upper().split()) == "REST APIS" else "ALIAS") for _, t in sorted(wide + alone)]
    hits = _scan(text, [name, *aliases])
    return [(t, "EXACT" if t.lower() == name.lower() else "ALIAS") for _, t in hits]


def is_block(section: dict) -> bool:
    first = re.split(r"\r?\n", section["content"])[0]
    return section["type"] == "SKILLS_SECTION" or kind(first.split(":")[0] if first.find(":") > 0 else first) == "SKILLS_SECTION"


def matches(section: dict) -> list[tuple[str, str, str, float]]:
    block, out = is_block(section), []
    for s in SKILLS:
        for token, m in candidates(s.name, s.aliases, section["content"], block):
            out.append((s.name, token, m, (100.0 if m == "EXACT" else 90.0) if block else 80.0))
    return out


def skills(text: str) -> dict[str, tuple]:
    best: dict[str, tuple] = {}
    for sec in sections(text) if text else []:
        for name, token, m, score in matches(sec):
            if name not in best or score > best[name][2]:
                best[name] = (token, m, score, f"{sec['header']}: {token}")
    return best


def requirements(text: str) -> dict[str, list[str]]:
    req, pref, unk = [], [], []
    for sec in sections(text) if text else []:
        for name in dict.fromkeys(m[0] for m in matches(sec)):
            if sec["type"] == "REQUIRED":
                req += [name] if name not in req else []
            elif sec["type"] == "PREFERRED":
                pref += [name] if name not in req + pref else []
            else:
                unk += [name] if name not in req + pref + unk else []
    if not req and not pref:
        pref, unk = unk, []
    return {"required": req, "preferred": pref, "unknown": unk}
