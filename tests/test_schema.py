"""Shapes of records: violations, stored form, one write for accepted and rejected rows."""

import json

from pyspark.sql import functions as F

from skilloom.operators import schema, validation
from skilloom.operators.schema import Many, OneOf, Record, Text

SHAPE = Record({
    "name": Text(2, 5), "kind": OneOf(("A", "B"), "A"), "need": OneOf(("X",)), "note": Text(0, 3, optional=True, trim=False),
    "inner": Record({"t": Text(1)}, optional=True), "rows": Many(Record({"v": Text(1, 2), "deep": Many(Text(0, 1))}), 1, 2)},
    {"name.equal": lambda r: r["name"] == r["note"]})
GOOD = {"name": " ab ", "need": "X", "rows": [{"v": "z"}]}


def found(spark, records):
    d = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "k int, r string")
    return {r.k: r.violations for r in schema.checked(d, "r", SHAPE).collect()}


def test_paths(spark):
    records = [GOOD, {}, None, "", "{oops", "null", GOOD | {"name": "a"}, GOOD | {"name": "abcdef"}, GOOD | {"name": "a😀😀"}, GOOD | {"name": "😀😀😀"}, GOOD | {"kind": "C", "need": "Y"},
               GOOD | {"inner": {}}, GOOD | {"inner": {"t": ""}}, GOOD | {"rows": []}, GOOD | {"rows": [None, {"v": "abc"}, {"deep": ["", None, "ab"]}]},
               GOOD | {"name": "abc", "note": "abc"}, GOOD | {"unknown": [1]}, "[1]"]
    got = found(spark, records)
    assert got[0] == [] and got[16] == []
    assert got[1] == ["name.missing", "need.missing"]
    assert got[2] == got[3] == got[4] == ["json.invalid"]
    assert got[6] == ["name.min"] and got[7] == ["name.max"] and got[8] == [] and got[9] == ["name.max"]
    assert got[10] == ["kind.enum", "need.enum"] and got[11] == ["inner.t.missing"] and got[12] == ["inner.t.min"] and got[13] == ["rows.min_items"]
    assert got[14] == ["rows.max_items", "rows[0].missing", "rows[1].v.max", "rows[2].v.missing", "rows[2].deep[1].missing", "rows[2].deep[2].max"]
    assert got[15] == ["name.equal"]
    assert found(spark, []) == {}


def test_stored_form_and_split(spark, tmp_path):
    records = [json.dumps(r) for r in (GOOD, GOOD | {"name": "a"}, GOOD | {"kind": "B", "note": " n ", "rows": [{"v": " ", "deep": [" "]}]})]
    judged = schema.checked(spark.createDataFrame(list(enumerate(records)), "k int, r string"), "r", SHAPE)
    good, bad = schema.split(spark, judged, str(tmp_path / "records"))
    assert good.columns == ["k", "r"] and bad.columns == ["k", "r", "violations"]
    assert [(r.k, r.violations) for r in bad.collect()] == [(1, ["name.min"])]
    assert {r.k for r in good.collect()} == {0, 2}
    plan = good._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "accepted" in plan
    stored = {r.k: r.s.asDict(recursive=True) for r in good.select("k", schema.accepted(F.col("r"), SHAPE).alias("s")).collect()}
    assert stored[0] == {"name": "ab", "kind": "A", "need": "X", "note": None, "inner": None, "rows": [{"v": "z", "deep": []}]}
    assert stored[2] == {"name": "ab", "kind": "B", "need": "X", "note": " n ", "inner": None, "rows": [{"v": "", "deep": [""]}]}


def test_record_without_items(spark):
    texts = ['{"overall_strategy":{"summary":"s"},"recommendations":[]}', '{"overall_strategy":{"summary":"s"}}', '{"recommendations":[]}']
    d = spark.createDataFrame(list(enumerate(texts)), "k int, r string")
    got = {r.k: r.violations for r in validation.recommendations_violations(d, "r").collect()}
    assert got == {0: ["recommendations.min_items"], 1: ["recommendations.missing"], 2: ["overall_strategy.missing", "recommendations.min_items"]}
