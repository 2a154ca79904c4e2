r"""Merkle fingerprints over sections, paragraphs and sentences, in built-in functions only.

A text is cut into sections (at empty lines), paragraphs (lines) and sentences
(at blanks after punctuation).  Leaves are hashes of sentences; a paragraph's
hash is that of its leaves, a section's that of its paragraphs, the root's that
of its sections.  The fingerprint writes the tree as
``root/section(paragraph:leaf.leaf,paragraph:leaf)section(...)`` in hexadecimal
digits, so it can be compared without the text: equal roots mean equal texts;
otherwise only branches whose hashes differ are opened, down to the leaves that
were edited.

Likeness is the share of leaves in equal branches: whole sections that both
trees hold, then whole paragraphs of the other sections, then leaves of the
other paragraphs, as twice the shared leaves over the leaves of both (0 without
a common leaf).  The root counts as one more leaf on each side, so that only
equal texts reach 1 and moved lines do not.  A branch that occurs n times in one tree
and m times in the other is shared min(n, m) times; for that, the occurrences
of equal branches are numbered after a sort, so the time stays that of a sort.

Each document is compared with its edited text and with the next document.
Documents are dealt into ranges of ``doc_id`` at quantiles of the ids, so each
text is shuffled once, and a window in each range finds the next one; the first
document of every range also goes to the end of the range before it.

Defined cases: null and empty texts are one empty leaf; rows with the same
``doc_id`` follow each other by text, null ids come first; the last document is
followed by the first, a single one by itself; an empty table gives an empty
result; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, whole_text

#: Hexadecimal digits of a root, an inner node and a leaf.
ROOT, NODE, LEAF = 32, 12, 8
#: Where a line is cut into sentences: a blank after punctuation.
SENTENCE_END = r"(?<=[.!?;:,|])[ \t]"


def tree(text: str) -> str:
    """SQL for the tree of a text: array of sections {hash, paragraphs: array of {hash, leaves: array of string}}."""
    leaves = f"transform(split(line, r'{SENTENCE_END}', -1), x -> substring(sha2(x, 256), 1, {LEAF}))"
    paragraphs = (f"transform(transform(split(part, '\\\\n', -1), line -> {leaves}), ls -> named_struct('hash', "
                  f"substring(sha2(array_join(ls, '.'), 256), 1, {NODE}), 'leaves', ls))")
    return (f"transform(transform(split({text}, '\\\\n\\\\n', -1), part -> {paragraphs}), ps -> named_struct('hash', "
            f"substring(sha2(array_join(transform(ps, p -> p.hash), '.'), 256), 1, {NODE}), 'paragraphs', ps))")


def written(tree: str, text: str) -> str:
    """SQL for the fingerprint of a tree; the root covers the text itself, so equal roots are equal texts."""
    paragraph = "concat(p.hash, ':', array_join(p.leaves, '.'))"
    section = f"concat(s.hash, '(', array_join(transform(s.paragraphs, p -> {paragraph}), ','), ')')"
    return f"concat(substring(sha2({text}, 256), 1, {ROOT}), '/', array_join(transform({tree}, s -> {section}), ''))"


def occurrences(branches: str) -> str:
    """SQL for the branches of an array with ``#1``, ``#2``, ... behind equal ones, in order of their names."""
    begins = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> s[i - 1])"
    run = "transform(sequence(1, coalesce(get(begins, j + 1), size(s)) - at), n -> concat(s[at], '#', n))"
    return (f"transform(array(array_sort({branches})), s -> if(size(s) = 0, s, flatten(transform(array({begins}), begins -> "
            f"flatten(transform(begins, (at, j) -> {run}))))))[0]")


def likeness(a: str, b: str) -> str:
    """SQL for the likeness of two fingerprints: 0 to 1, opening only branches that differ."""
    sections = occurrences("filter(split(split_part({}, '/', 2), r'\\)'), x -> x <> '')")
    opened = occurrences("flatten(transform({}, x -> split(split_part(split_part(x, '#', 1), '(', 2), ',')))")
    leaves = occurrences("flatten(transform({}, x -> split(split_part(split_part(x, '#', 1), ':', 2), r'\\.')))")
    count = "aggregate({}, 0, (n, x) -> n + length(x) - length(replace(replace(x, ':', ''), '.', '')))"
    return f"""if({a} = {b}, 1D, transform(array(named_struct('a', {sections.format(a)}, 'b', {sections.format(b)})), s ->
        transform(array(named_struct('same', {count.format('array_intersect(s.a, s.b)')},
            'a', {opened.format('array_except(s.a, s.b)')}, 'b', {opened.format('array_except(s.b, s.a)')})), p ->
        transform(array(named_struct('same', p.same + {count.format('array_intersect(p.a, p.b)')},
            'a', {leaves.format('array_except(p.a, p.b)')}, 'b', {leaves.format('array_except(p.b, p.a)')})), l ->
        2D * (l.same + size(array_intersect(l.a, l.b))) / (2 * l.same + size(l.a) + size(l.b) + 2))[0])[0])[0])"""


def edited_paragraphs(a: str, b: str) -> str:
    """SQL for the paragraph hashes of fingerprint a that b does not have: where a was edited."""
    paragraphs = "flatten(transform(filter(split(split_part({}, '/', 2), r'\\)'), x -> x <> ''), x -> transform(split(split_part(x, '(', 2), ','), p -> split_part(p, ':', 1))))"
    return f"array_except({paragraphs.format(a)}, {paragraphs.format(b)})"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document; nothing is shuffled."""
    return docs.select("doc_id", whole_text().alias("text")).withColumn("tree", F.expr(tree("text"))).selectExpr(
        "doc_id", f"{written('tree', 'text')} as fingerprint")


def with_next(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (key, text, fingerprint and more) with next_text and next_fingerprint of the row that follows by (key, text), cyclically."""
    spark = rows.sparkSession
    at = sorted(set(rows.approxQuantile("key", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)))) if ranges > 1 else []
    steps = max(1, len(at).bit_length())
    cuts = "array(" + ", ".join([f"{int(x)}L" for x in at] + ["null"] * ((1 << steps) - 1 - len(at))) + ")"
    bisect = f"aggregate(array({', '.join(str(1 << k) for k in range(steps - 1, -1, -1))}), 0, (lo, k) -> if(coalesce(cuts[lo + k - 1] <= key, false), lo + k, lo))"
    spread = rows.withColumn("cuts", F.expr(cuts).cast("array<long>")).withColumn("range", F.expr(bisect)).drop("cuts")
    first = spread.groupBy("range").agg(F.min("key").alias("key")).orderBy("range").collect()  # at most one row per range
    if not first:
        return spread.selectExpr("*", "text as next_text", "fingerprint as next_fingerprint")
    to = spark.createDataFrame([(f["key"], first[i - 1]["range"]) for i, f in enumerate(first)], "key long, range int")
    again = rows.filter(F.col("key").isin([f["key"] for f in first])).join(F.broadcast(to), "key").select(*spread.columns)
    both = spread.withColumn("again", F.lit(False)).unionAll(again.withColumn("again", F.lit(True)))
    over = "over (partition by range order by again, key, text)"
    return both.selectExpr("*", f"lead(text) {over} as next_text", f"lead(fingerprint) {over} as next_fingerprint").filter("not again")


def compared(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    ranges: default four times the session's shuffle partitions, so that ranges which hash to the same partition even out.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), whole_text().alias("text"))
    rows = rows.withColumn("tree", F.expr(tree("text"))).selectExpr("doc_id", "key", "text", f"{written('tree', 'text')} as fingerprint")
    pairs = with_next(rows, ranges or 4 * partitions(docs.sparkSession, None)).withColumn("n_chars", F.length("text"))
    edited = pairs.withColumn("edited", F.expr("concat(left(text, n_chars - n_chars div 2), left(next_text, n_chars div 2))"))
    edited = edited.withColumn("tree", F.expr(tree("edited"))).withColumn("edited_fingerprint", F.expr(written("tree", "edited")))
    return edited.selectExpr("doc_id", "cast(n_chars as long) as n_chars", "sha2(edited, 256) as edited_sha256", "fingerprint", "edited_fingerprint",
                             f"{likeness('fingerprint', 'edited_fingerprint')} as near_edited", f"{likeness('fingerprint', 'next_fingerprint')} as near_next")


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """DuckDB SQL for the query."""

    def fingerprint(text: str) -> str:
        leaves = f"list_transform(string_split(regexp_replace(line, '([.!?;:,|])[ \\t]', '\\1' || chr(1), 'g'), chr(1)), lambda x: sha256(x)[1:{LEAF}])"
        paragraph = f"list_transform(list_transform(string_split(part, chr(10)), lambda line: array_to_string({leaves}, '.')), lambda l: sha256(l)[1:{NODE}] || ':' || l)"
        section = (f"list_transform(list_transform(string_split({text}, chr(10) || chr(10)), lambda part: {paragraph}), lambda ps: "
                   f"sha256(array_to_string(list_transform(ps, lambda p: string_split(p, ':')[1]), '.'))[1:{NODE}] || '(' || array_to_string(ps, ',') || ')')")
        return f"sha256({text})[1:{ROOT}] || '/' || array_to_string({section}, '')"

    leaves = "length({0}) - length(replace(replace({0}, ':', ''), '.', ''))"

    def level(name: str, of: str, cut: str) -> str:
        """How often each branch below what is left of a level occurs on both sides, and how often in both."""
        return (f"{name} AS (SELECT id, kind, x, sum(na) AS na, sum(nb) AS nb, least(sum(na), sum(nb)) AS n FROM "
                f"(SELECT id, kind, unnest({cut}) AS x, na, nb FROM {of}) WHERE x <> '' GROUP BY id, kind, x)")

    left = "(SELECT id, kind, x, na - n AS na, nb - n AS nb FROM {} WHERE na <> nb)"
    return f"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS id, doc_id, text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
f AS (SELECT id, doc_id, text, length(text) AS n_chars, {fingerprint('text')} AS fingerprint FROM t),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(fingerprint) OVER w, first_value(fingerprint) OVER w) AS next_fingerprint
 FROM f WINDOW w AS (ORDER BY id)),
e AS (SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited FROM n),
g AS MATERIALIZED (SELECT *, {fingerprint('edited')} AS edited_fingerprint FROM e),
pairs AS MATERIALIZED (SELECT id, 'edited' AS kind, fingerprint AS a, edited_fingerprint AS b FROM g UNION ALL SELECT id, 'next', fingerprint, next_fingerprint FROM g),
sides AS (SELECT id, kind, split_part(a, '/', 2) AS part, 1 AS na, 0 AS nb FROM pairs UNION ALL SELECT id, kind, split_part(b, '/', 2), 0, 1 FROM pairs),
{level('s', 'sides', "string_split(part, ')')")},
{level('p', left.format('s'), "string_split(split_part(x, '(', 2), ',')")},
{level('l', left.format('p'), "string_split(split_part(x, ':', 2), '.')")},
shared AS (SELECT id, kind, sum(n) AS n FROM (SELECT id, kind, n * ({leaves.format('x')}) AS n FROM s UNION ALL SELECT id, kind, n * ({leaves.format('x')}) FROM p
 UNION ALL SELECT id, kind, n FROM l) GROUP BY id, kind),
near AS (SELECT id, kind, CASE WHEN a = b THEN 1.0 ELSE 2.0 * n / ({leaves.format("split_part(a, '/', 2)")} + {leaves.format("split_part(b, '/', 2)")} + 2) END::DOUBLE AS near FROM pairs JOIN shared USING (id, kind))
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, x.near AS near_edited, y.near AS near_next
FROM g JOIN near x ON x.id = g.id AND x.kind = 'edited' JOIN near y ON y.id = g.id AND y.kind = 'next'"""


QUERIES = {"op10_merkle_fingerprints": op10_merkle_fingerprints}
ORACLES = {"op10_merkle_fingerprints": _oracle()}
