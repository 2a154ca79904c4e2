from pyspark.sql import functions as F

from skilloom.functions import pii, text as text_fn
from skilloom.operators import quality, scoring

RESUME = "\n".join(["Jane Doe", "jane@example.com", "Skills: Python", "Experience", "Education", "Projects",
                    "- Developed and tested tools for 12 clients", "- Improved speed by 30%", "- Scaled to 10k users"]) + "\n" + "word " * 260


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn("t").alias("x")).first().x


def test_quality_complete_and_penalised(spark):
    rows = spark.createDataFrame([(0, RESUME), (1, "nothing much"), (2, "  \n "), (3, None)], "i int, t string")
    got = {r.i: r for r in quality.with_quality_report(rows, "t").collect()}
    assert got[0].quality_score == 100.0 and not got[0].deductions and len(got[0].strengths) == 9
    assert got[1].quality_score == 0.0
    assert {d.rule for d in got[1].deductions} == {"MISSING_CONTACT", "MISSING_SKILLS", "MISSING_EXPERIENCE", "MISSING_EDUCATION", "MISSING_PROJECTS",
                                                   "WORD_COUNT_TOO_BRIEF", "BULLET_POINTS_SPARSE", "ACTION_VERBS_LOW", "METRICS_ZERO"}
    for i in (2, 3):
        assert got[i].quality_status == "UNAVAILABLE" and got[i].quality_score is None and got[i].quality_reason


def test_quality_counts(spark):
    cases = {"50% and 2x and $40 and 100 users and 5M": 5, "100k+ rows": 1, "100k": 1, "v2x": 0, "led, built led": 3, "écreated": 1, "tested_x": 0}
    d = quality.with_quality_features(spark.createDataFrame([(k,) for k in cases], "t string"), "t")
    for r in d.collect():
        assert cases[r.t] == r.quantifiable_metrics_count + r.action_verbs_count, r.t


def test_clean_text(spark):
    assert _one(spark, "ofﬁce\u0000 a\u0007\r\nb   \rc\n\n\n\n\nd\t x ", text_fn.clean_text) == "office a\nb\nc\n\nd\t x"
    assert _one(spark, " ﻿x  y ", text_fn.clean_text) == "x y"
    assert _one(spark, None, text_fn.clean_text) == ""


def test_readability(spark):
    got = [_one(spark, t, text_fn.readability_code) for t in ("a" * 19, "a b " * 10, "x" * 500_001, "", "\U0001F600" * 10)]
    assert got == ["NO_READABLE_TEXT", None, "TEXT_LIMIT_EXCEEDED", "NO_READABLE_TEXT", None]


def test_slug(spark):
    assert [_one(spark, t, text_fn.slug) for t in ("C++", "C#", ".NET Core", "  Node.js ")] == ["c", "c", "net_core", "node_js"]


def test_redaction(spark):
    t = "Mail a.b@c.io or +1 (555) 123-4567. Live at 12 Oak Street, CA 94103. Worked 2020-2024. PIN: 500081"
    out = _one(spark, t, pii.redact)
    assert out == ("Mail [EMAIL_REDACTED] or [PHONE_REDACTED]. Live at [ADDRESS_REDACTED] [POSTAL_REDACTED]. Worked 2020-2024. [POSTAL_REDACTED]")
    doc = '{"a":{"postal_code":"x","street":""},"l":[{"m":"q@w.er"},5],"n":null}'
    assert _one(spark, doc, pii.redact_json) == '{"a":{"postal_code":"[POSTAL_REDACTED]","street":""},"l":[{"m":"[EMAIL_REDACTED]"},5],"n":null}'


def test_scores(spark):
    c = lambda *v: [F.lit(x) for x in v]
    cases = [(c(1, 2, 1, 1), (1.0 + 0.8) / 2, 64.0), (c(0, 0, 2, 2), 1.0, 100.0), (c(2, 2, 0, 0), 1.0, 80.0), (c(0, 0, 0, 0), 0.0, 0.0), (c(1, 2, 0, 0), 1.0, 45.0)]
    for (a, b, d, e), conf, want in cases:
        assert spark.range(1).select(scoring.overall_score(a, b, d, e, F.lit(conf)).alias("s")).first().s == want
    lib = scoring.overall_score(*c(2, 2, 0, 0), F.lit(1.0), preferred_absent=1.0, epsilon=False)
    assert spark.range(1).select(lib.alias("s")).first().s == 100.0


def test_analysis_report_and_history(spark):
    r = spark.createDataFrame([(1, 9, "a.docx", "COMPLETED", "Skills: Python\nNotes:\nUses Docker daily in teams"), (2, 9, "b", "FAILED", None), (3, 9, "c", "COMPLETED", "short")],
                              "resume_id int, user_id int, file_name string, extraction_status string, extracted_text string")
    j = spark.createDataFrame([(7, "Dev", "Requirements: Python, Java\nPreferred: Docker, Python")], "job_id int, title string, description string")
    a = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "resume_id int, job_id int").withColumn("applied_at", F.lit("2024-01-01"))
    full = scoring.analyse(a, r, j, items=True)
    row = full.first()
    assert full.count() == 1 and row.overall_score == 64.0 and row.total_job_skills == 3
    items = {i.skill_name: i for i in row["items"]}
    assert items["Docker"].evidence == "[PREFERRED] Body context exact match: 'Docker' (Confidence: 0.80)"
    assert items["Java"].evidence == "[REQUIRED] Skill not detected in candidate resume" and items["Python"].requirement_type == "REQUIRED"
    again = scoring.summarise_items(scoring.explode_items(full, "analysis_id"), "analysis_id").first()
    assert (again.matched_required_count, again.missing_required_count, again.required_coverage) == (1, 1, 0.5)
    resolved, missing = scoring.resolve_catalog(scoring.explode_items(full, "analysis_id"),
                                                spark.createDataFrame([(1, "PYTHON"), (2, "java")], "skill_id int, skill_name string"))
    assert resolved.count() == 2 and [m.skill_name for m in missing.collect()] == ["Docker"]


def test_terms_equal_a_pattern_scan(spark):
    """Every spelling at every boundary, against one regular expression per term."""
    import random
    import re

    from skilloom.operators import terms

    rnd = random.Random(11)
    named = [("node.js", ["nodejs", "node"]), (".NET", ["dotnet"]), ("go", None), ("the cat", ["cat the", "cat"]), ("a/b", []), ("c", ["c."]), ("...", [])]
    bits = ["node.js", "Node", ".net", "x.net", "GO", "go's", "the", "cat", "a", "b", "a/b", "c", "c.", "c..", "#c", "(cat)", "cat)", "é", "[go]", "go[", "\n", ""]
    rows = [(i, "".join(rnd.choice(bits) + rnd.choice([" ", " ", "  ", "/", ".", " ", "-", ""]) for _ in range(rnd.randint(0, 14)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, " . ")]
    ws = r"\s"
    want = set()
    for i, text in rows:
        for name, aliases in named:
            if name == "...":
                continue
            alt = "|".join(re.escape(s) for s in sorted([name, *(aliases or [])], key=lambda s: -len(s)))
            m = re.search(rf"(?i)[{ws},;:(/\[{{<>\"'`]({alt})(?=[{ws},;:)/\[\]}}<>\"'`!?.])", f"\n{text or ''}\n")
            if m:
                want.add((i, name, m[1], "EXACT" if m[1].lower() == name.lower() else "ALIAS"))
    d = terms.match_terms(spark.createDataFrame(rows, "id long, text string"), "id", "text",
                          spark.createDataFrame([(n, "T", a) for n, a in named], "name string, category string, aliases array<string>"))
    got = [tuple(r) for r in d.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
