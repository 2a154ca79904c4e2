"""File ingest: admission checks, fingerprints, display names and DOCX text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skilloom.functions import text as text_fn

# --- fixed values: accepted formats and limits -------------------------------
MIME_BY_EXTENSION = {".pdf": "application/pdf",
                     ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
MAGIC_BY_EXTENSION = {".pdf": "25504446", ".docx": "504B0304"}
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_ENTRIES, MAX_ENTRY_NAME = 1000, 255
MAX_XML_BYTES = MAX_ARCHIVE_BYTES = 10 * 1024 * 1024
DISPLAY_NAME_MAX = 255


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of every non-empty file under ``path``.

    Spark's file scan gives zero-byte files no split, so they do not appear;
    uploads kept as table rows do get the EMPTY_FILE code.
    """
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .load(path).select("path", "length", "content"))


def extension(name: Column) -> Column:
    """Last dot suffix in lower case; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)\z", 1))


def admission_code(name: Column, content: Column, mime: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """First failing check, or null when the file may be processed (archives are checked by the reader)."""
    ext, size = extension(name), F.octet_length(content)
    magic = F.hex(F.substring(content, 1, 4))
    want_mime, want_magic = F.lit(None).cast("string"), F.lit(None).cast("string")
    for e in MIME_BY_EXTENSION:
        want_mime = F.when(ext == e, MIME_BY_EXTENSION[e]).otherwise(want_mime)
        want_magic = F.when(ext == e, MAGIC_BY_EXTENSION[e]).otherwise(want_magic)
    return (F.when(size > max_bytes, "FILE_TOO_LARGE")
            .when(content.isNull() | (size == 0), "EMPTY_FILE")
            .when(~ext.isin(*MIME_BY_EXTENSION), "UNSUPPORTED_EXTENSION")
            .when(~F.lower(F.coalesce(mime, F.lit(""))).eqNullSafe(want_mime), "MIME_MISMATCH")
            .when(~magic.eqNullSafe(want_magic), "MAGIC_MISMATCH"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def display_name(name: Column, fallback: str = ".pdf") -> Column:
    """Base name with control and hazardous characters as ``_``, runs collapsed, at most 255 long."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*\z", 1)
    base = F.regexp_replace(base, r"""[\x00-\x1F\x7F<>:"'/\\|?*]""", "_")
    base = F.trim(F.regexp_replace(base, r"[_\s]+", "_"))
    ext = F.regexp_extract(base, r".(\.[^.]*)\z", 1)
    cut = F.concat(F.substr(base, F.lit(1), F.lit(DISPLAY_NAME_MAX) - F.length(ext)), ext)
    base = F.when(F.length(base) > DISPLAY_NAME_MAX, cut).otherwise(base)
    return F.when((base == "") | base.startswith("."), F.lit(f"resume{fallback}")).otherwise(base)


# How the parts of a document read, by kind: the child elements in output order with the kind each is read as, what joins them, and
# whether empty ones are left out.  Fixed behaviour: within a part the output follows this grouping (a paragraph's own runs, then its links,
# then its content controls; a body's paragraphs, then its tables, then its content controls), not the order of the elements.
PARTS = {
    "body": ((("p", "paragraph"), ("tbl", "table"), ("sdt/sdtContent", "body")), "\n\n", True),
    "paragraph": ((("r", "run"), ("hyperlink", "runs"), ("sdt/sdtContent", "runs")), "", False),
    "runs": ((("r", "run"),), "", False),
    "table": ((("tr", "row"),), "\n", False),
    "row": ((("tc", "cell"),), "\t", False),
    "cell": ((("p", "paragraph"),), " ", False),
}
# A run's texts, then one mark for each of these groups of elements that it holds.
RUN_TEXT, RUN_MARKS = "t", ((("tab",), "\t"), (("br", "cr"), "\n"))


def _docx_reader():
    """Small per-file helper, built as a closure so it ships to executors by value."""
    limits = (MAX_ENTRIES, MAX_ENTRY_NAME, MAX_XML_BYTES)
    parts, run_text, run_marks = PARTS, RUN_TEXT, RUN_MARKS

    def read(data: bytes) -> tuple[str | None, str | None]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree
        max_entries, max_name, max_xml = limits
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        if not data:
            return None, "INVALID_BUFFER"
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError):
            return None, "CORRUPTED_DOCUMENT"
        names = archive.namelist()
        unsafe = any(not n or len(n) > max_name or ".." in n or n.startswith("/") or "\\" in n for n in names)
        if len(names) > max_entries or unsafe or not {"[Content_Types].xml", "word/document.xml"} <= set(names):
            return None, "CORRUPTED_DOCUMENT"
        try:
            with archive.open("word/document.xml") as part:
                data = part.read(max_xml + 1)
        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError):
            return None, "CORRUPTED_DOCUMENT"
        if len(data) > max_xml:
            return None, "DECOMPRESSION_LIMIT_EXCEEDED"
        try:
            xml = data.decode("utf-8-sig")  # what is checked is what is parsed: other encodings could hide a declaration
        except UnicodeDecodeError:
            return None, "CORRUPTED_DOCUMENT"
        if re.search(r"<!(?:doctype|entity)\b", xml, re.I):
            return None, "UNSAFE_XML_DECLARATION"
        try:
            root = ElementTree.fromstring(xml)
        except (ElementTree.ParseError, ValueError):
            return None, "CORRUPTED_DOCUMENT"
        if root.tag != w + "document":
            return None, "CORRUPTED_DOCUMENT"

        def reading(node, kind: str) -> str:
            if kind == "run":
                held = {child.tag for child in node}
                texts = [child.text or "" for child in node if child.tag == w + run_text]
                return "".join(texts + [mark for tags, mark in run_marks if any(w + t in held for t in tags)])
            groups, joiner, skip_empty = parts[kind]
            read = [reading(child, inner) for steps, inner in groups for child in node.findall("/".join(w + s for s in steps.split("/")))]
            text = joiner.join(x for x in read if x or not skip_empty)
            return text.strip() if kind == "cell" else text

        body = root.find(w + "body")
        return reading(root if body is None else body, "body"), None

    return read


def docx_text(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, text, error_code: raw DOCX body text, cleaned and checked for readability.

    Python only opens the archives (Arrow batches); clean-up and the readability
    rule run in the JVM.  One bad file gives one error row, never a failed job.
    """
    read = _docx_reader()
    schema = f"{files.select(key).schema.simpleString()[7:-1].replace(':', ' ', 1)}, raw string, error_code string"

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [read(bytes(c) if c is not None else b"") for c in pdf[content]]
            yield pd.DataFrame({key: pdf[key], "raw": [t for t, _ in done], "error_code": [e for _, e in done]})

    d = files.select(key, content).mapInPandas(extract, schema)
    d = d.withColumn("text", F.when(F.col("error_code").isNull(), text_fn.clean_text("raw")))
    code = F.when(F.col("error_code").isNull(), text_fn.readability_code("text")).otherwise(F.col("error_code"))
    return d.select(key, "text", code.alias("error_code")).withColumn("text", F.when(F.col("error_code").isNull(), F.col("text")))
