import random

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with what operators compute or use inside.
CLASHES = ("fingerprint", "component_id", "row", "block", "words", "key", "range", "tree", "s", "t", "lengths", "quality", "__text", "id")


def edge_rows():
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma,", "délta", "x.\ny", "<|endoftext|>", "it's"]) for _ in range(20_000))
    texts = [None, "", " \n\t ", "one", "two words", "a b c", "A B C", long, long + " tail", "x" * 5000, "Licensed under CC BY-NC 4.0.\n\nReleased under the MIT License.",
             "line one. two, three\nline one. two, three\n\nsection; two | x", "cc by cc by\x00cc BY", "😀 emoji ²½ Ⅷ   \x1c z"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "one", None, None, None), (None, None, None, None, None), (900, "two words", "fr", None, 9)]


@pytest.fixture(scope="session")
def edges(spark):
    """Null and empty texts, a null id, repeated rows, long texts, with extra columns that clash."""
    from pyspark.sql import functions as F

    rows = [(a, None if b is None else b.encode("utf-16", "surrogatepass").decode("utf-16"), *c) for a, b, *c in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def duck():
    """Runs DuckDB SQL with a DataFrame as the table ``documents``."""

    def run(sql, docs):
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        if rows:
            con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
        got = con.execute(sql)
        return [d[0] for d in got.description], got.fetchall()

    return run
