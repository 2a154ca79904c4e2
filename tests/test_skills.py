import random

from pyspark.sql import functions as F
import pytest
import row_model

from skilloom.functions.taxonomy import SKILLS
from skilloom.operators import requirements, sections, skills

# (mode, text, present, absent): S = skills block, B = prose, A = automatic.
GOLDEN = [
    ("S", "Skills: C, C++, Java", {"C", "C++"}, set()),
    ("B", "Proficient in C programming and compilers", {"C"}, set()),
    ("B", "c programming", set(), {"C"}),
    ("B", "Takes Vitamin C daily", set(), {"C"}), ("B", "Refer to Section C of document", set(), {"C"}),
    ("B", "Received Grade C in math", set(), {"C"}),
    ("S", "Objective-C", set(), {"C"}), ("B", "Wrote Objective-C code", set(), {"C"}),
    ("S", "Objective C", {"C"}, set()),
    ("S", "Skills: C++ and C#", {"C++", "C#"}, {"C"}),
    ("B", "Let's go to the office.", set(), {"Go"}), ("B", "Go to market strategy for Q3.", set(), {"Go"}),
    ("B", "Developed backend in Golang", {"Go"}, set()), ("B", "Expert in Go programming", {"Go"}, set()),
    ("B", "Worked in R&D department", set(), {"R"}), ("B", "Toys R Us store", set(), {"R"}),
    ("B", "Registered a .net domain name", set(), {".NET"}), ("B", "High speed internet access", set(), {".NET"}),
    ("B", "NoSQL database architecture", set(), {"SQL"}), ("B", "SQL-like syntax for queries", set(), {"SQL"}),
    ("B", "restful apis", {"REST APIs"}, set()), ("B", "take a rest", set(), {"REST APIs"}), ("B", "rest of the year", set(), {"REST APIs"}),
    ("S", "C,C++", {"C", "C++"}, set()), ("S", "Java,Python", {"Java", "Python"}, set()), ("S", "Node.js,React", {"Node.js", "React"}, set()),
    ("S", "C++/CLI", {"C++"}, set()),
]


def test_golden_presence(spark):
    for mode, override in (("S", True), ("B", False)):
        cases = [(i, g[1]) for i, g in enumerate(GOLDEN) if g[0] == mode]
        d = skills.with_skills(spark.createDataFrame(cases, "i int, text string"), "text", override=override)
        for row in d.collect():
            names = {s.skill_name for s in row.skills}
            _, text, present, absent = GOLDEN[row.i]
            assert present <= names and not (absent & names), (text, names)


def test_tiers_and_confidence(spark):
    d = skills.with_skills(spark.createDataFrame([("ANSI C",), ("PostgreSQL",), ("Postgres",)], "text string"), "text", "b", override=True)
    d = skills.with_skills(d, "text", "p", override=False)
    got = {r.text: (r.b[0].score, r.b[0].confidence, r.p[0].score, r.p[0].confidence) for r in d.collect()}
    assert got == {"ANSI C": (90.0, 1.0, 80.0, 0.8), "PostgreSQL": (100.0, 1.0, 80.0, 0.8), "Postgres": (90.0, 1.0, 80.0, 0.8)}


def test_job_buckets_and_fallback(spark):
    job = "We use AWS and Docker.\nRequirements:\n- Python\n- PostgreSQL\nNice to Have:\n- Redis\n- Kubernetes"
    rows = [(0, job), (1, "Know Python, Docker and Redis."), (2, ""), (3, None),
            (4, "Nice to have: Python\nRequirements: Python, Java")]
    d = requirements.with_requirements(spark.createDataFrame(rows, "i int, t string"), "t")
    got = {r.i: tuple([s.skill_name for s in r.requirements[b]] for b in requirements.BUCKETS) for r in d.collect()}
    assert got[0] == (["Python", "PostgreSQL"], ["Redis", "Kubernetes"], ["AWS", "Docker"])
    assert got[1][0] == [] and sorted(got[1][1]) == ["Docker", "Python", "Redis"] and got[1][2] == []
    assert got[2] == got[3] == ([], [], [])
    assert got[4] == (["Python", "Java"], ["Python"], [])


def _texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    words = [v for s in SKILLS for v in (s.name, *s.aliases)]
    words += ["C", "Go", "R", "REST", "rest", "c", "programming", "language", "and", "the", "package", "code", "restful  apis", "embedded  C",
              "REST  APIs", "go", "Vitamin", "R&D", "Objective-C", "x", "T-SQL", "internet", " ", " "]
    heads = ["Skills:", "SKILLS", "Technical Skills: ", "Tech Stack:", "Requirements:", "- Must have:", "Nice to have", "PREFERRED", "Qualifications",
             "Qualifications preferred", "Experience:", "EXPERIENCE", "About us: we do", "12345", "---", "Tools & Platforms", "Languages and more",
             "Skills required for a very long header line that runs past fifty characters", "1) Requirements", "•  Core Competencies :", "Core\tCompetencies"]
    seps = [", ", ",", " ", "; ", "/", " / ", ". ", ")", "(", "\t", "'", " - "]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(rnd.randint(1, 7)):
            if rnd.random() < 0.4:
                lines.append(rnd.choice(heads) + (rnd.choice(words) if rnd.random() < 0.3 else ""))
            elif rnd.random() < 0.15:
                lines.append(rnd.choice(["", "  ", "\t"]))
            else:
                lines.append("".join(rnd.choice(["- ", "", " "]) if j == 0 else rnd.choice(seps) + rnd.choice(words)
                                     for j in range(rnd.randint(1, 7))))
        out.append(rnd.choice(["\n", "\r\n"]).join(lines))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sections_and_skills_match_row_model(spark, seed):
    texts = _texts(600, seed)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    d = sections.with_sections(df, "t")
    d = skills.with_skills(d, "t")
    d = requirements.with_requirements(d, "t")
    checked = 0
    for r in d.collect():
        t = texts[r.i]
        want_sections = row_model.sections(t) if t else []
        assert [s.asDict() for s in (r.sections or [])] == want_sections, repr(t)
        got = {s.skill_name: (s.token, s.match_type, s.score, s.evidence) for s in r.skills}
        assert got == row_model.skills(t), repr(t)
        want = row_model.requirements(t)
        assert {b: [s.skill_name for s in r.requirements[b]] for b in requirements.BUCKETS} == want, repr(t)
        checked += len(got)
    assert checked > 500


def test_custom_taxonomy_over_one_bit_word(spark):
    from skilloom.functions.taxonomy import Skill
    from skilloom.operators import scoring
    many = tuple(Skill(f"Tool{i}", "Tool") for i in range(130))
    r = spark.createDataFrame([(1, "Skills: Tool0, Tool64, Tool129\nNotes:\nTool5 was here")], "resume_id int, extracted_text string")
    j = spark.createDataFrame([(7, "Requirements: Tool64, Tool5, Tool99\nPreferred: Tool129")], "job_id int, description string")
    a = spark.createDataFrame([(1, 7)], "resume_id int, job_id int")
    row = scoring.with_scores(scoring.pair_features(a, scoring.resume_features(r, many), scoring.job_features(j, many)), many).first()
    assert (row.required_skills_count, row.matched_required_count, row.preferred_skills_count, row.matched_preferred_count) == (3, 2, 1, 1)
    assert row.average_confidence == 0.933




def test_rest_overlap_is_by_position(spark):
    import skilloom.operators.skills as sk

    rest = tuple(s for s in sk.SKILLS if s.name == "REST APIs")
    texts = ["REST tools, RESTful" + " " * n + "APIs" for n in range(1, 9)] + ["REST and then much later RESTful APIs"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s[0].token for r in sk.with_skills(d, "t", "s", skills=rest, override=False).collect()}
    # "REST" starts 12 before the compound: dropped once the compound is longer than that, which holds from two blanks on.
    assert [got[i].split()[0] for i in range(9)] == ["REST"] + ["RESTful"] * 7 + ["REST"]


def test_patterns_run_on_the_lines_that_hold_a_spelling(spark):
    from skilloom.functions.taxonomy import SKILLS
    from skilloom.operators import skills
    by_name = {s.name: s for s in SKILLS}
    assert "s.lines" in skills._tokens_sql(by_name["Python"]) and "s.lines" not in skills._tokens_sql(by_name["C"])
    prose = "Planned delivery across teams with care. " * 50
    text = f"{prose}\nused python3 and\tPYTHON\n{prose}\nANSI\nC and R\nlanguage, take a rest, REST\nAPIs, T-SQL\nC\n/ C++"
    got = spark.createDataFrame([(1, text)], "id long, t string")
    found = {r.skill_name: r.token for r in skills.explode_skills(skills.with_skills(got, "t"), "id").collect()}
    assert found == {"Python": "python3", "C": "ANSI\nC", "R": "R", "REST APIs": "REST\nAPIs", "SQL": "T-SQL", "C++": "C++"}


def test_a_derived_text_is_made_once(spark):
    from skilloom.operators import scoring
    from skilloom.sources import feeds
    d = scoring.resume_features(scoring.analysable(feeds.resumes(spark, "/root/testdata/sf0.001")))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Planned delivery across teams") == 1
    texts = spark.createDataFrame([(1, None), (2, " " * 100 + "x" * 19), (3, " " * 100 + "x" * 20), (4, "　" + "x" * 20), (5, "\U0001F600" * 10)], "id long, t string")
    codes = texts.select("id", scoring.analysis_reject_code(F.lit("COMPLETED"), F.col("t")).alias("c")).collect()
    assert [r.id for r in codes if r.c is None] == [3, 4, 5]


def test_tasks_that_make_texts_are_bounded(spark, tmp_path):
    from skilloom.sources import feeds
    rows = spark.range(1000).coalesce(1)
    assert feeds.spread_rows(rows, 50).rdd.getNumPartitions() == 20 and feeds.spread_rows(rows, 50).count() == 1000
    spark.range(5 * feeds.ROWS_A_TASK).selectExpr("id as c_custkey", "concat('n', id) as c_name", "id % 25 as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert feeds.resumes(spark, str(tmp_path)).rdd.getNumPartitions() == 5


def test_long_lines_without_spellings_are_shortened_and_change_nothing(spark):
    prose = "Planned delivery across towns with care and some more of it. " * 20
    ends = ["", "ANSI", "xANSI", "xANSI   ", "xEmbedded", "programming", "and C", "REST", "rest", "skills", " "]
    starts = ["", "C ", "C", "programming and ", "language ", "APIs ", "/ C++ ", "RESTful", "REST" + " " * 300, "Go", "R", "Skills: ", "Notes: ", "-" * 300 + " Skills "]
    texts = [f"Skills: Go, {a}\n{b}{prose}{c}\n{d}{prose}\n{a} endpoints" for a in ("C", "R", "REST", "Go", ".NET") for b in starts for c in ends for d in ("C", "APIs ", "REST ", "Kotlin ")]
    texts = random.Random(3).sample(texts, 120)
    texts += [f"REST\n{prose}\nREST{' ' * n}APIs and rest" for n in (1, 39, 40, 300)] + [f"REST\r\n{prose}\r\r\nC\r\n"]
    d = skills.with_skills(spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8), "t")
    for r in d.collect():
        assert {s.skill_name: (s.token, s.match_type, s.score, s.evidence) for s in r.skills} == row_model.skills(texts[r.i]), repr(texts[r.i])
    short = spark.createDataFrame([(prose,), ("Planned " * 99 + "a",)], "t string").select(F.expr(skills.shortened_sql("t")).alias("t"))
    assert [len(r.t) for r in short.collect()] == [141, 799 - 6]
