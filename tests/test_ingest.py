import io
import json
import zipfile

from pyspark.sql import functions as F

from skilloom.functions.taxonomy import taxonomy_df
from skilloom.operators import maintenance as mt, scoring
from skilloom.sources import files, store

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx(body: str, extra: dict[str, str] | None = None, main="word/document.xml", root="w:document", head="") -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr(main, f"{head}<{root} {NS}><w:body>{body}</w:body></{root}>")
        for k, v in (extra or {}).items():
            z.writestr(k, v)
    return buf.getvalue()


def _p(t: str) -> str:
    return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


LONG = "enough readable text for a document"


def test_docx_text(spark):
    rich = (_p(LONG) + "<w:p><w:r><w:t>a</w:t><w:tab/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
            f"<w:tbl><w:tr><w:tc>{_p('x')}{_p('y')}</w:tc><w:tc>{_p('z')}</w:tc></w:tr></w:tbl>"
            f"<w:sdt><w:sdtContent>{_p('inside')}</w:sdtContent></w:sdt>")
    cases = {"rich": _docx(rich), "short": _docx(_p("hi")), "zip": b"PK\x03\x04broken", "empty": b"", "part": _docx(_p(LONG), main="word/document2.xml"),
             "path": _docx(_p(LONG), {"../evil": "x"}), "many": _docx(_p(LONG), {f"f{i}": "" for i in range(1000)}), "root": _docx(_p(LONG), root="w:other"),
             "xxe": _docx(_p(LONG), head='<!DOCTYPE x [<!ENTITY e "v">]>'), "bomb": _docx(_p("a" * (10 * 1024 * 1024 + 5)))}
    d = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    got = {r.path: (r.text, r.error_code) for r in files.docx_text(d).collect()}
    assert got["rich"] == (f"{LONG}\n\na\tlink\n\nx y\tz\n\ninside", None)
    assert {k: v[1] for k, v in got.items() if k != "rich"} == {
        "short": "NO_READABLE_TEXT", "zip": "CORRUPTED_DOCUMENT", "empty": "INVALID_BUFFER", "part": "CORRUPTED_DOCUMENT", "path": "CORRUPTED_DOCUMENT",
        "many": "CORRUPTED_DOCUMENT", "root": "CORRUPTED_DOCUMENT", "xxe": "UNSAFE_XML_DECLARATION", "bomb": "DECOMPRESSION_LIMIT_EXCEEDED"}


def test_admission_names_and_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx(_p(LONG)))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    docx, pdf = files.MIME_BY_EXTENSION[".docx"], files.MIME_BY_EXTENSION[".pdf"]
    d = files.read_files(spark, str(tmp_path)).unionByName(
        spark.createDataFrame([("up/c.pdf", 0, bytearray())], "path string, length long, content binary"))
    d = d.withColumn("mime", F.when(F.col("path").endswith("docx"), docx).otherwise(pdf))
    got = {r.path.rsplit("/", 1)[1]: r.code for r in d.select("path", files.admission_code(F.col("path"), F.col("content"), F.col("mime")).alias("code")).collect()}
    assert got == {"a.docx": None, "b.pdf": None, "c.pdf": "EMPTY_FILE"}
    names = {"../x/my  cv?.pdf": "my_cv_.pdf", ".hidden": "resume.pdf", "": "resume.pdf", "a" * 300 + ".docx": "a" * 250 + ".docx", None: "resume.pdf"}
    n = spark.createDataFrame([(k, v) for k, v in names.items()], "n string, want string").withColumn("got", files.display_name(F.col("n")))
    for r in n.collect():
        assert r.got == r.want, r


def test_store_roundtrip(spark, tmp_path):
    a = spark.createDataFrame([("x", 1.0, [("Python", "MATCHED")])], "analysis_id string, overall_score double, items array<struct<skill_name:string,status:string>>")
    path = str(tmp_path / "store")
    assert store.read_analyses(spark, path, a.schema).count() == 0
    assert store.write_analyses(a, path, "b1") and store.write_analyses(a, path, "b2")
    fails = a.withColumn("overall_score", F.raise_error(F.lit("lost")).cast("double"))
    assert not store.write_analyses(fails, path, "b1")  # a committed batch is left as it is
    try:
        store.write_analyses(fails, path, "b3")
    except Exception as e:  # the job fails; nothing of it is read
        assert "lost" in str(e)
    a.write.parquet(f"{path}/data/attempt=half")  # written but never committed
    assert sorted(r.batch_id for r in store.read_analyses(spark, path).collect()) == ["b1", "b2"]
    assert store.read_items(spark, path, a.schema).select("analysis_id", "skill_name").collect() == [("x", "Python")] * 2


def test_docx_encodings_cannot_hide_a_declaration(spark):
    evil = '<?xml version="1.0" encoding="UTF-16"?><!DOCTYPE d [<!ENTITY e "EXPANDED">]>'
    parts = []
    for encoding in ("utf-16", "utf-8"):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("word/document.xml", f"{evil}<w:document {NS}><w:body>{_p('&e; hello')}</w:body></w:document>".encode(encoding))
        parts.append(buf.getvalue())
    got = files.docx_text(spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "path int, content binary"))
    assert [r.error_code for r in got.orderBy("path").collect()] == ["CORRUPTED_DOCUMENT", "UNSAFE_XML_DECLARATION"]


def test_json_set_keeps_what_is_no_object(spark):
    d = spark.createDataFrame([('{"a": 1, broken',), ("[1]",)], "doc string")
    got = d.select(mt.json_set(F.col("doc"), "k", F.lit("1")).alias("x"), mt.json_error(F.col("doc")).alias("e")).collect()
    assert [(r.x, r.e) for r in got] == [('{"a": 1, broken', "INVALID_JSON"), ("[1]", "INVALID_JSON")]


def test_json_set(spark):
    d = spark.createDataFrame([('{"a":1,"m":{"7":{"v":0},"8":2}}',), (None,)], "doc string")
    d = d.select(mt.json_set_nested(mt.json_set(F.col("doc"), "p", F.lit('{"n":[1]}')), "m", F.lit("7"), F.lit('{"v":9}')).alias("x"))
    assert [json.loads(r.x) for r in d.collect()] == [{"a": 1, "p": {"n": [1]}, "m": {"7": {"v": 9}, "8": 2}}, {"p": {"n": [1]}, "m": {"7": {"v": 9}}}]


def test_catalog_and_audit(spark):
    base = taxonomy_df(spark).select("skill_name", "category")
    out = mt.catalog_insert_missing(base, spark.createDataFrame([("PYTHON", "x"), ("Zig", "b"), ("zig", "a")], "skill_name string, category string"))
    assert out.count() == 57 and out.filter(F.lower("skill_name") == "zig").first().skill_name == "Zig"
    items = spark.createDataFrame([("MATCHED", 50.0, 1.0), ("ODD", 101.0, 2.0), ("MISSING", None, 0.0)], "status string, similarity_score double, confidence double")
    assert {r.rule: r.violations for r in mt.audit(items, mt.item_rules()).collect()} == {"status_enum": 1, "similarity_0_100": 1, "confidence_0_1": 1}


def test_top_applicants_plan_limits_before_shuffle(spark):
    d = spark.createDataFrame([(1, i, float(i % 7)) for i in range(100)], "job_id int, resume_id int, overall_score double")
    top = scoring.top_applicants(d, 5)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert [(r.resume_id, r.rank) for r in top.orderBy("rank").collect()] == [(6, 1), (13, 2), (20, 3), (27, 4), (34, 5)]


def test_every_admitted_file_is_hashed(spark):
    from skilloom.plans import operations
    d = operations.file_admission(spark, "/root/testdata/sf0.001")
    assert d.columns == ["doc_id", "code", "display_name", "hashed"]
    assert d.filter("hashed").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
