"""Pages by key against pages by offset, and what a deep page reads."""

import uuid

import pytest
from pyspark.sql import functions as F

from skilloom.operators import pages, reports
from skilloom.session import shared_dir

ORDER = pages.Order()


@pytest.fixture(scope="module")
def analyses(spark):
    """6000 rows; tenant 0 has more than half of them, many share their time."""
    d = spark.range(6000).selectExpr("if(id % 5 < 3, 0L, id % 7) as user_id", "timestamp_seconds(id * 7919 % 1500) as created_at",
                                     "concat('a', lpad(id, 5, '0')) as analysis_id", "repeat('x', 100) as payload")
    odd = spark.sql("SELECT 0L AS user_id, cast(null as timestamp) AS created_at, 'none' AS analysis_id, '' AS payload")
    return d.unionAll(odd)


@pytest.fixture(scope="module")
def laid(spark, analyses):
    return pages.lay_out(analyses, f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", ORDER, files=12)


def _rows(df):
    return sorted((r.user_id, r.row_no, r.analysis_id, r.total, r.total_pages) for r in df.collect())


@pytest.mark.parametrize("page", [1, 2, 60, 10 ** 6])
def test_page_by_key_is_page_by_offset(analyses, laid, page):
    starts = pages.page_starts(laid, ORDER, 10)
    got = pages.seek_all(laid, ORDER, starts.filter(F.col("page") == page), 10)
    assert _rows(got) == _rows(reports.history_page(analyses.dropna(), page, 10))


def test_walk_by_cursor_meets_every_row_once(analyses, laid):
    want = [r.analysis_id for r in analyses.dropna().filter("user_id = 3").orderBy(F.desc("created_at"), "analysis_id").collect()]
    got, cursor = [], None
    while rows := pages.seek(laid, ORDER, 3, cursor, 50).collect():
        got += [r.analysis_id for r in rows]
        cursor = (rows[-1].created_at, rows[-1].analysis_id)
    assert got == want


def _scan(df):
    """(files, rows) that the scan of an executed frame read."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    while leaf.getClass().getSimpleName() != "FileSourceScanExec":
        leaf = leaf.executedPlan() if leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else leaf.children().apply(0)
    return leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("numOutputRows").value()


def test_deep_page_opens_few_files(laid):
    start = pages.page_starts(laid, ORDER, 10).filter("user_id = 0 AND page = 300").first()
    cursor = (start.after_newest, start.after_tiebreak)
    deep = pages.seek(laid, ORDER, 0, cursor, 10, (start.first_file, start.last_file))
    files, rows = _scan(deep)
    assert files <= 2 and rows <= 2 * 6000 / 12 * 1.5
    assert _scan(laid)[0] == 12
    assert [r.analysis_id for r in deep.collect()] == [r.analysis_id for r in pages.seek(laid, ORDER, 0, cursor, 10).collect()]
    assert "LessThanOrEqual(created_at" in deep._jdf.queryExecution().toString()


def test_large_tenant_is_cut_over_files(laid):
    assert laid.filter("user_id = 0").select(F.col("_metadata.file_name")).distinct().count() > 5


def test_rows_added_before_a_cursor_do_not_move_its_page(spark, analyses, laid):
    start = pages.page_starts(laid, ORDER, 10).filter("user_id = 2 AND page = 5").first()
    new = spark.sql("SELECT 2L AS user_id, timestamp'2030-01-01' AS created_at, 'zz' AS analysis_id, '' AS payload")
    more = pages.lay_out(analyses.unionAll(new), f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", ORDER, files=3)
    cursor = (start.after_newest, start.after_tiebreak)
    assert pages.seek(more, ORDER, 2, cursor).collect() == pages.seek(laid, ORDER, 2, cursor).collect()


def test_empty_table_and_bounds(spark, analyses, laid):
    none = pages.lay_out(analyses.limit(0), f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", ORDER)
    assert pages.page_starts(none, ORDER).count() == 0
    assert pages.seek_all(none, ORDER, pages.page_starts(none, ORDER)).count() == 0
    for limit in (0, reports.MAX_PAGE_SIZE + 1):
        with pytest.raises(ValueError):
            pages.seek(laid, ORDER, 1, None, limit)
