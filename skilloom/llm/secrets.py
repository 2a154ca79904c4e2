r"""Secret scans by corpus-wide ownership frequency, in built-in functions only.

One pass over the texts finds the spans of the base patterns and of further
candidates (provider keys, and mixed strings outside base spans).  Every
candidate's value is hashed; over the whole corpus the hashes are counted by
distinct owners and by distinct repositories.  A value that many owners hold
is an example that was copied around; one that few hold looks live.  Base
spans always stay; of the further candidates only live-looking ones become
spans (kind ``owned``).

A value may occur in a third of all rows: distinct (value, owner, repository)
rows are formed in the map tasks first, so what meets in one task is a row
per repository and map task.  The candidates' join with the verdicts is an ordinary join that
Spark may split.

Positions come from splitting a text at its matches: the lengths of the parts
and the matches add up to code-point offsets, in running sums over chunks, so
that a text with many matches takes little more than time in proportion.

Defined cases: null texts are empty and have no spans; repeated rows are each
reported, and count once per repository; a null owner is an owner of its own;
an empty table gives an empty one; texts of any length are searched whole; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, materialize, table, whole_text

# The base patterns, in the order of their kinds, with the group whose length counts and the least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # as AKIA[A-Z0-9]+ of 16 or more: a shorter run holds no other match
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # as [0-9a-f]+ of 32 or more, likewise
)
#: Further candidates: keys with a provider's prefix, signed tokens, and words of 20 or more letters and digits with three digits or more.
OWNED = (r"(?:gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}"
         r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
         r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9][A-Za-z+/_-]*[0-9][A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,})")
#: A value of this many owners or more, or of this many repositories, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 5, 12
#: Elements that are folded at once where an array is built by a fold.
CHUNK = 128


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _running(numbers: str, joined: str) -> str:
    """SQL for the running ``joined`` ({a}, {b}; the first {a} is null) of an int array.

    An array that grows by one element a step is copied at every step, so the
    array is worked through in chunks, and their ends in a second pass.
    """
    last = "get({0}, size({0}) - 1)"
    step = lambda acc, x: f"array_append({acc}, {joined.format(a=last.format(acc), b=x)})"
    chunks = (f"transform(sequence(0, greatest(size(__a) - 1, 0) div {CHUNK}), __i -> aggregate(slice(__a, __i * {CHUNK} + 1, {CHUNK}), "
              f"cast(array() as array<int>), (__p, __x) -> {step('__p', '__x')}))")
    before = f"slice(aggregate(__c, array(cast(null as int)), (__q, __y) -> {step('__q', last.format('__y'))}), 1, size(__c))"
    shifted = f"flatten(zip_with(__c, {before}, (__z, __b) -> transform(__z, __v -> {joined.format(a='__b', b='__v')})))"
    return f"transform(array({numbers}), __a -> transform(array({chunks}), __c -> {shifted})[0])[0]"


SUM, LARGEST, SMALLEST = "coalesce({a}, 0) + {b}", "greatest({a}, {b})", "least({a}, {b})"
SPAN = "struct<start:int, kind_order:int, `end`:int, kind:string, value:string>"


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Array of (start, kind_order, end, kind, value) of the leftmost matches, shorter values dropped afterwards."""
    p = _quoted(pattern)
    cut = f"""zip_with(split(__text, {p}, -1), zip_with(regexp_extract_all(__text, {p}, 0), regexp_extract_all(__text, {p}, {group}), (m, v) -> struct(m, v)),
        (part, hit) -> struct(length(part) + coalesce(length(hit.m), 0) as wide, length(hit.m) as n, hit.v as v))"""
    placed = f"""zip_with(cut, {_running('transform(cut, x -> x.wide)', SUM)}, (x, at) -> if(length(x.v) >= {least},
        named_struct('start', at - x.n, 'kind_order', {order}, 'end', at, 'kind', '{kind}', 'value', x.v), null))"""
    return f"if(__text rlike {p}, transform(array({cut}), cut -> filter({placed}, x -> x is not null))[0], cast(array() as array<{SPAN}>))"


def _outside(more: str, base: str, order: int) -> str:
    """The spans of ``more`` (kind ``order``, the last) that overlap none of ``base``.

    In the order of starts (base first), a base span overlaps if one up to
    here ends behind the start, or the next one starts before the end.
    """
    is_base = f"x.kind_order < {order}"
    ends = _running(f"transform(every, x -> if({is_base}, x.`end`, null))", LARGEST)
    starts = f"reverse({_running(f'reverse(transform(every, x -> if({is_base}, x.start, null)))', SMALLEST)})"
    free = f"{is_base} or coalesce(upto > x.start, false) or coalesce(get(starts, i) < x.`end`, false)"
    kept = f"""transform(array({starts}), starts -> filter(transform(zip_with(every, {ends}, (x, upto) -> struct(x, upto)), (s, i) ->
        if({free.replace('x.', 's.x.').replace('upto', 's.upto')}, null, s.x)), x -> x is not null))[0]"""
    return f"if(size({base}) = 0 or size({more}) = 0, {more}, transform(array(array_sort(concat({base}, {more}))), every -> {kept})[0])"


def found(docs: DataFrame, owner: Column, repository: Column, keep: tuple[str, ...]) -> DataFrame:
    """row, ``keep``, owner, repository, n_<kind>, base spans and further candidates (more) of every document, written once."""
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("__row"), F.coalesce(owner.cast("string"), F.lit("")).alias("__owner"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("__repository"), whole_text().alias("__text"))
    for i, (kind, pattern, group, least) in enumerate(BASE):
        rows = rows.withColumn(f"__{kind}", F.expr(_spans(kind, i, pattern, group, least)))
    hashed = "transform({}, x -> named_struct('start', x.start, 'kind_order', x.kind_order, 'end', x.end, 'kind', x.kind, 'hash', sha2(x.value, 256)))"
    rows = rows.withColumn("__base", F.expr("array_sort(concat(" + ", ".join(f"__{k}" for k, *_ in BASE) + "))"))
    rows = rows.withColumn("__owned", F.expr(_spans("owned", len(BASE), OWNED, 0, 1)))
    return materialize(rows.withColumn("__more", F.expr(_outside("__owned", "__base", len(BASE)))).selectExpr(
        *keep, "__row", "__owner", "__repository", *(f"cast(size(__{k}) as long) as __n_{k}" for k, *_ in BASE),
        f"{hashed.format('__base')} as __base", f"{hashed.format('__more')} as __more"), "secrets")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories, live of the values in ``candidates`` (hash, owner, repository)."""
    once = candidates.select("hash", "owner", "repository").distinct()
    owners = once.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories")).withColumn(
        "live", (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repositories") < EXAMPLE_REPOSITORIES))


def judged(seen: DataFrame) -> DataFrame:
    """__row and spans (by start, each with n_owners, n_repositories, live) of the documents in ``found`` that have any."""
    each = seen.filter("size(__base) + size(__more) > 0").selectExpr(
        "__row", "__owner as owner", "__repository as repository", "explode(concat(__base, __more)) as s").withColumn("hash", F.col("s.hash"))
    verdict = ownership(each)
    return each.join(verdict, "hash").filter("s.kind <> 'owned' or live").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(
        "s.start", "s.kind_order", "s.end", "s.kind", "n_owners", "n_repositories", "live"))).alias("spans"))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, n_<kind> (long), base and spans (arrays by start; spans with n_owners, n_repositories, live) of every document."""
    seen = found(docs, owner, repository, ("doc_id",))
    return seen.join(judged(seen), "__row", "left").select(
        "doc_id", *(F.col(f"__n_{k}").alias(f"n_{k}") for k, *_ in BASE), F.col("__base").alias("base"), "spans")


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, F.col("source"), F.concat_ws("/", "source", "lang")).selectExpr(
        "doc_id", *(f"n_{k}" for k, *_ in BASE), f"sha2({_listed('base')}, 256) as base_sha256", f"coalesce({_listed('spans')}, '') as spans",
        "cast(coalesce(size(filter(spans, x -> x.live)), 0) as long) as n_live",
        "cast(coalesce(size(filter(spans, x -> not x.live)), 0) as long) as n_copied")


def masked(docs: DataFrame, owner: Column, repository: Column, mask: str = "<secret>") -> DataFrame:
    """The documents (their standard columns) with every live-looking span replaced by the mask, overlapping spans by one.

    Copied examples stay, and so does every text without a live-looking span; n_chars is kept in step.
    """
    seen = found(docs, owner, repository, DOCUMENT_COLUMNS)
    live = judged(seen).selectExpr("__row", "filter(spans, x -> x.live) as spans")
    before = "coalesce(get(upto, {0} - 1), 0)".format
    block_end = f"least(block * {CHUNK} + {CHUNK - 1}, size(upto) - 1)"
    block_start = before(f"block * {CHUNK}")
    piece = f"""if(spans[i].start < {before('i')}, '', concat(substring(part, {before('i')} - {block_start} + 1, spans[i].start - {before('i')}), '{mask}'))"""
    blocks = f"""transform(sequence(0, (size(upto) - 1) div {CHUNK}), block -> transform(
        array(substring(text, {block_start} + 1, get(upto, {block_end}) - {block_start})), part -> array_join(transform(sequence(block * {CHUNK}, {block_end}), i -> {piece}), ''))[0])"""
    cut = f"""transform(array({_running('transform(spans, x -> x.`end`)', LARGEST)}), upto ->
        concat(array_join({blocks}, ''), substring(text, get(upto, size(upto) - 1) + 1)))[0]"""
    some = seen.filter("size(__base) + size(__more) > 0").join(live, "__row", "left").withColumn(
        "text", F.expr(f"if(coalesce(size(spans), 0) = 0, text, {cut})")).withColumn(
        "n_chars", F.expr("if(coalesce(size(spans), 0) = 0, n_chars, length(text))").cast(docs.schema["n_chars"].dataType))
    return seen.filter("size(__base) + size(__more) = 0").select(*DOCUMENT_COLUMNS).unionAll(some.select(*DOCUMENT_COLUMNS))


QUERIES = {"op8_secret_ownership": op8_secret_ownership}
ORACLES: dict[str, str] = {}
