"""Skill taxonomy and section cues.

The tables below are fixed values: results only agree with existing catalogs
when the names, categories, aliases and cues are exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Skill:
    name: str
    category: str
    aliases: tuple[str, ...] = ()


LANG, FRAMEWORK, DATABASE = "Programming language", "Framework", "Database"
CLOUD, DEVOPS, TOOL, SOFT = "Cloud", "DevOps", "Tool", "Soft skill"

# --- fixed values: skill names, categories and aliases -----------------------
SKILLS: tuple[Skill, ...] = (
    Skill("Python", LANG, ("python3", "py")),
    Skill("JavaScript", LANG, ("JS", "ECMAScript", "ES6", "ES2015", "ES2020")),
    Skill("TypeScript", LANG, ("TS",)),
    Skill("Java", LANG, ("Java8", "Java11", "Java17", "Java21")),
    Skill("C++", LANG, ("CPP", "C plus plus")),
    Skill("C#", LANG, ("CSharp", "C sharp")),
    Skill("C", LANG, ("ANSI C", "Embedded C")),
    Skill("Go", LANG, ("Golang",)),
    Skill("Rust", LANG, ("Rustlang",)),
    Skill("Ruby", LANG),
    Skill("PHP", LANG, ("PHP7", "PHP8")),
    Skill("Swift", LANG),
    Skill("Kotlin", LANG),
    Skill("R", LANG, ("RStudio",)),
    Skill("SQL", LANG, ("T-SQL", "PL/SQL", "SQL queries")),
    Skill("HTML5", LANG, ("HTML",)),
    Skill("CSS3", LANG, ("CSS",)),
    Skill(".NET", FRAMEWORK, (".NET Core", "ASP.NET", "ASP.NET Core", ".Net")),
    Skill("React", FRAMEWORK, ("React.js", "ReactJS")),
    Skill("Node.js", FRAMEWORK, ("NodeJS", "Node JS", "Node")),
    Skill("Express.js", FRAMEWORK, ("Express", "ExpressJS")),
    Skill("Next.js", FRAMEWORK, ("NextJS", "Next")),
    Skill("FastAPI", FRAMEWORK),
    Skill("Django", FRAMEWORK),
    Skill("Flask", FRAMEWORK),
    Skill("Spring Boot", FRAMEWORK, ("Spring", "SpringBoot")),
    Skill("Vue.js", FRAMEWORK, ("Vue", "VueJS")),
    Skill("Angular", FRAMEWORK, ("AngularJS", "Angular2+")),
    Skill("Tailwind CSS", FRAMEWORK, ("Tailwind", "TailwindCSS")),
    Skill("Redux", FRAMEWORK, ("Redux Toolkit", "RTK")),
    Skill("PostgreSQL", DATABASE, ("Postgres", "PSQL", "PostgreSql")),
    Skill("MySQL", DATABASE),
    Skill("MongoDB", DATABASE, ("Mongo",)),
    Skill("Redis", DATABASE),
    Skill("SQLite", DATABASE, ("SQLite3",)),
    Skill("Elasticsearch", DATABASE, ("ElasticSearch", "ELK")),
    Skill("Cassandra", DATABASE, ("Apache Cassandra",)),
    Skill("AWS", CLOUD, ("Amazon Web Services",)),
    Skill("Microsoft Azure", CLOUD, ("Azure",)),
    Skill("Google Cloud", CLOUD, ("GCP", "Google Cloud Platform")),
    Skill("Docker", DEVOPS, ("Docker Compose",)),
    Skill("Kubernetes", DEVOPS, ("K8s", "Kube")),
    Skill("Terraform", DEVOPS),
    Skill("CI/CD", DEVOPS, ("Continuous Integration", "Continuous Delivery", "CI-CD",
                            "GitHub Actions", "GitLab CI")),
    Skill("Linux", DEVOPS, ("GNU/Linux", "Ubuntu", "Debian", "CentOS", "RedHat")),
    Skill("Git", TOOL, ("Version Control",)),
    Skill("GitHub", TOOL),
    Skill("REST APIs", TOOL, ("REST", "REST API", "RESTful", "RESTful API", "RESTful APIs")),
    Skill("GraphQL", TOOL),
    Skill("Communication", SOFT, ("Written Communication", "Verbal Communication")),
    Skill("Problem Solving", SOFT, ("Troubleshooting", "Analytical Thinking")),
    Skill("Teamwork", SOFT, ("Collaboration", "Team Player")),
    Skill("Leadership", SOFT, ("Mentoring", "Team Lead")),
    Skill("Critical Thinking", SOFT),
    Skill("Time Management", SOFT, ("Prioritization",)),
    Skill("Agile Methodology", SOFT, ("Agile", "Scrum", "Kanban")),
)

# --- fixed values: section header cues, as ``|``-free alternatives -----------
# ``{s}`` stands for the engine's whitespace class.
SKILLS_CUES = (
    r"(?:TECHNICAL{s}+)?SKILLS",
    r"CORE{s}+COMPETENCIES",
    r"(?:PROGRAMMING{s}+)?LANGUAGES",
    r"TECHNOLOGIES",
    r"TECH{s}+STACK",
    r"TOOLS{s}*(?:&|AND){s}*PLATFORMS",
    r"TECHNICAL{s}+PROFICIENCIES",
    r"AREAS{s}+OF{s}+EXPERTISE",
)
REQUIRED_CUES = (
    r"REQUIREMENTS",
    r"MINIMUM{s}+QUALIFICATIONS",
    r"REQUIRED",
    r"WHAT{s}+YOU(?:'LL|{s}+WILL)?{s}+(?:NEED|BRING)",
    r"MUST{s}+HAVE",
    r"BASIC{s}+QUALIFICATIONS",
)
# "Qualifications" is required unless directly followed by "preferred".
REQUIRED_UNLESS_PREFERRED = r"QUALIFICATIONS"
PREFERRED_CUES = (
    r"PREFERRED",
    r"NICE{s}+TO{s}+HAVE",
    r"BONUS",
    r"PLUSES",
    r"DESIRED",
    r"GOOD{s}+TO{s}+HAVE",
    r"ADDITIONAL",
)
# Words that make a bare line (no colon, mixed case) a header candidate.
BARE_HEADER_WORDS = ("requirements", "qualifications", "skills", "technical skills",
                     "nice to have", "must have", "preferred", "tech stack")

# --- fixed values: catalog order of the master dictionary --------------------
# The first seed holds every skill except these three; the second adds them.
SECOND_SEED = ("C", "R", ".NET")

TAXONOMY_SCHEMA = "skill_pos int, skill_name string, category string, aliases array<string>"


def variants(skill: Skill) -> list[str]:
    """Name and aliases, longest first (ties keep their listed order)."""
    return sorted([skill.name, *skill.aliases], key=lambda v: -len(v))


def taxonomy_df(spark: SparkSession, skills: tuple[Skill, ...] = SKILLS) -> DataFrame:
    """The taxonomy as a (small, fixed-size) dimension table."""
    return spark.createDataFrame(
        [(i, s.name, s.category, list(s.aliases)) for i, s in enumerate(skills)], TAXONOMY_SCHEMA)
