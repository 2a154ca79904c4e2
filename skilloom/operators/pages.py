"""Pages by key: seek to a cursor in a sorted layout instead of counting off the rows before it.

``lay_out`` writes a table in ranges of (tenant, newest first, tiebreak), so a
tenant of any size is cut over many files and each file covers a narrow range.
``page_starts`` numbers the rows of every tenant without bringing a tenant
into one task (a window inside each file, a running sum over the files' counts)
and keeps the last row of every page: the cursor of the next one.  A page is
then read from its cursor: rows before it are skipped by file and by row group,
and only ``limit`` rows a task go on.

A cursor is the (newest, tiebreak) of the last row that a reader has seen; it
stays right when rows are added before it, which page numbers do not.
Rows need a tenant, a sort value and a unique tiebreak: those with a null in
one of them are on no page and are left out of the layout.  An empty table has
no pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skilloom.operators.reports import MAX_PAGE_SIZE, total_pages


@dataclass(frozen=True)
class Order:
    """The columns that rows are filed by: of one tenant, newest first, ties by ascending id."""

    tenant: str = "user_id"
    newest: str = "created_at"
    tiebreak: str = "analysis_id"

    def keys(self) -> list[Column]:
        return [F.asc(self.tenant), F.desc(self.newest), F.asc(self.tiebreak)]

    def names(self) -> list[str]:
        return list(dict.fromkeys([self.tenant, self.newest, self.tiebreak]))

    def after(self, newest: Column, tiebreak: Column) -> Column:
        """Whether a row comes after a cursor.  The first part alone reaches the scan, where row groups are skipped by it."""
        return (F.col(self.newest) <= newest) & ((F.col(self.newest) < newest) | (F.col(self.tiebreak) > tiebreak))


def _check(limit: int) -> None:
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError(f"limit is 1..{MAX_PAGE_SIZE}")


def lay_out(df: DataFrame, path: str, order: Order, files: int | None = None) -> DataFrame:
    """Write ``df`` in sorted ranges (``files`` of them, by default one per shuffle partition) and read it back."""
    spark = df.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = df.dropna(subset=order.names())
    whole.repartitionByRange(n, *order.keys()).sortWithinPartitions(*order.keys()).write.parquet(path)
    return read(spark, path, df)


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The laid-out table, with the schema of the frame it came from."""
    return spark.read.schema(like.schema).parquet(path)


def numbered(laid: DataFrame, order: Order) -> DataFrame:
    """The key columns of a laid-out table with ``file``, ``row_no`` (from 1) and ``total`` per tenant."""
    tenant = order.tenant
    rows = laid.select(*order.names(), F.col("_metadata.file_name").alias("file"))
    held = rows.groupBy(tenant, "file").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(tenant).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(tenant, "file", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"),
                         F.sum("n").over(Window.partitionBy(tenant)).alias("total"))
    inside = Window.partitionBy(tenant, "file").orderBy(F.desc(order.newest), F.asc(order.tiebreak))
    local = rows.withColumn("local", F.row_number().over(inside))
    return (local.join(before, [tenant, "file"])
            .withColumn("row_no", (F.col("before") + F.col("local")).cast("long")).drop("before", "local"))


def page_starts(laid: DataFrame, order: Order, limit: int = 10) -> DataFrame:
    """One row per page of every tenant: tenant, page, total, total_pages, the cursor (``after_newest``, ``after_tiebreak``; null before the
    first page) and the names of the files that hold the page's first and last row."""
    _check(limit)
    tenant, last = order.tenant, (F.col("row_no") % limit == 0) | (F.col("row_no") == F.col("total"))
    ends = numbered(laid, order).filter(last | (F.col("row_no") % limit == 1 % limit)).withColumn("page", F.ceil(F.col("row_no") / limit))
    page = ends.groupBy(tenant, "page", "total").agg(
        F.min("file").alias("first_file"), F.max("file").alias("last_file"),
        F.max_by(F.struct(F.col(order.newest).alias("n"), F.col(order.tiebreak).alias("t")), "row_no").alias("end"))
    cursor = page.select(tenant, (F.col("page") + 1).alias("page"), F.col("end.n").alias("after_newest"), F.col("end.t").alias("after_tiebreak"))
    return (page.drop("end").join(cursor, [tenant, "page"], "left")
            .withColumn("total_pages", total_pages(F.col("total"), limit)))


def seek(laid: DataFrame, order: Order, tenant, cursor: tuple | None = None, limit: int = 10, files: tuple[str, str] | None = None) -> DataFrame:
    """One tenant's next ``limit`` rows after ``cursor`` (from the first row without one), newest first.

    ``files`` (first and last, as ``page_starts`` names them) leaves out all
    other files before any of them is opened.
    """
    _check(limit)
    d = laid.filter(F.col(order.tenant) == tenant)
    if files:
        d = d.filter(F.col("_metadata.file_name").between(*map(F.lit, files)))
    if cursor:
        d = d.filter(order.after(*map(F.lit, cursor)))
    return d.orderBy(F.desc(order.newest), F.asc(order.tiebreak)).limit(limit)


def seek_all(laid: DataFrame, order: Order, starts: DataFrame, limit: int = 10) -> DataFrame:
    """The next ``limit`` rows of every tenant in ``starts`` (at most one row per tenant, as ``page_starts`` gives them), with ``row_no``,
    ``total`` and ``total_pages``.  Rows meet their tenant's cursor first; of those after it each task passes on ``limit`` per tenant."""
    _check(limit)
    about = [order.tenant, "page", "total", "total_pages", "after_newest", "after_tiebreak", "first_file", "last_file"]
    d = laid.withColumn("_file", F.col("_metadata.file_name")).join(starts.select(*about), order.tenant)
    d = d.filter(F.col("_file").between(F.col("first_file"), F.col("last_file")))
    d = d.filter(F.col("after_newest").isNull() | order.after(F.col("after_newest"), F.col("after_tiebreak")))
    w = Window.partitionBy(order.tenant).orderBy(F.desc(order.newest), F.asc(order.tiebreak))
    return (d.withColumn("row_no", F.row_number().over(w)).filter(F.col("row_no") <= limit)
            .withColumn("row_no", F.col("row_no") + (F.col("page") - 1) * limit)
            .drop("_file", "page", "after_newest", "after_tiebreak", "first_file", "last_file"))
